"""Exact top-k by inner product with a KD-tree per shard.

Rows are dealt to shards of bounded size by a hash of their id. Each shard's tree is built once,
by median splits of the widest dimension, keeps per node the tight box of its points, and is
written as one row. A box bounds every inner product inside it from above by
sum(max(q * low, q * high)), so nodes are visited best first and a search ends when the best
bound left is below the kth score. First every query searches one home shard; its kth score
then travels with it to the other shards, where most subtrees, or whole shards, fall under it.
Ties go to the smaller id: nodes that could still tie are visited.

Queries are copied to the shards (a stated query set against all rows); vectors are not copied
to queries: a task reads a shard's tree and then streams the queries past it, so it holds one
tree and one batch whatever the number of queries. Nothing is collected but the row counts.

Defined results: vectors that are NULL, empty or hold NULL or non-finite components
take no part, on either side; vectors of another length than a query's are no
candidates of it; rows with equal ids are all kept, and a query never meets a row with
its own id; queries repeated with one id and vector are one query, each of several vectors
under one id is searched and the best of all are kept; scores are exact whole numbers of any
size and ranked as such, those beyond a long are given as the nearest long; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import copy
import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialize

LEAF = 256
SHARD_ROWS = 16_384
LEAST_ROWS = 1_024  # of a shard, if more shards than ``SHARD_ROWS`` asks for keep all cores busy
LOW, HIGH = -(2**63), 2**63 - 1


class KDTree:
    """Points with their ids; boxes of a balanced tree, leaves of at most ``LEAF`` points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.arange(len(points))
        self.low, self.high, self.kids, self.span = [], [], [], []
        self._build(points, order, 0, len(order))
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.largest = float(np.abs(self.points).max(initial=0)) if self.points.dtype != object else float("inf")
        self._whole: KDTree | None = None

    def exact(self) -> KDTree:
        """The same tree over Python's whole numbers, for products that doubles do not hold."""
        if self._whole is None:
            self._whole = copy.copy(self)
            for name in ("points", "low", "high"):
                old = getattr(self, name)
                setattr(self._whole, name, old if old.dtype == object else np.array([[int(x) for x in v] for v in old.tolist()], object).reshape(old.shape))
        return self._whole

    def _build(self, points, order, a, b) -> int:
        me, mine = len(self.low), points[order[a:b]]
        low, high = mine.min(0), mine.max(0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.span.append((a, b))
        if b - a > LEAF and (high > low).any():
            mid, axis = (b - a) // 2, int(np.argmax(high - low))
            order[a:b] = order[a:b][np.argpartition(mine[:, axis], mid)]
            self.kids[me] = (self._build(points, order, a, a + mid), self._build(points, order, a + mid, b))
        return me

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) with score >= floor; the point with id ``own`` is left out."""
        floor = float("-inf") if floor is None else floor
        bound = np.maximum(query * self.low, query * self.high).sum(1).tolist()
        heap, found = [(-bound[0], 0)], []  # found: a heap whose top is the worst kept
        while heap:
            best, node = heapq.heappop(heap)
            if -best < floor:
                break
            if self.kids[node]:
                for child in self.kids[node]:
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.span[node]
            scores = self.points[a:b] @ query
            for i in np.nonzero(scores >= floor)[0].tolist():
                item = (int(scores[i]), -int(self.ids[a + i]))  # whole numbers in either type
                if -item[1] == own:
                    continue
                if len(found) < k:
                    heapq.heappush(found, item)
                elif item > found[0]:
                    heapq.heapreplace(found, item)
            if len(found) == k:
                floor = max(floor, found[0][0])
        return [(s, -i) for s, i in found]


def _matrix(column: pd.Series) -> np.ndarray:
    """Whole-number vectors as float64 where products are exact in it, else as Python integers."""
    out = np.array(column.tolist(), np.float64)
    exact = out.size == 0 or float(np.abs(out).max()) ** 2 * out.shape[1] < 2**52
    return out if exact else np.array([[int(x) for x in v] for v in column], object)


def _rank_key(score: int) -> bytes:
    """Bytes whose order is that of whole numbers of any size, largest first."""
    size = (abs(score).bit_length() + 8) // 8
    body = abs(score).to_bytes(size, "big")
    if score < 0:
        return b"\x01" + size.to_bytes(4, "big") + body
    return b"\x00" + bytes(255 - x for x in size.to_bytes(4, "big") + body)


def _build(key, shard: pd.DataFrame) -> pd.DataFrame:
    """One row with the tree of the vectors of one length in a shard."""
    tree = KDTree(_matrix(shard.v), shard.id.to_numpy(np.int64))
    return pd.DataFrame([(int(key[0]), int(key[1]), pickle.dumps(tree, 5))], columns=["shard", "size", "tree"])


def _stream(k: int):
    """Trees and queries, each tree before its queries, to the queries' best in it."""

    def run(batches):
        at, tree = None, None
        for batch in batches:
            rows = []
            for shard, size, blob, own, v, floor in batch[["shard", "size", "tree", "id", "v", "floor"]].itertuples(index=False):
                if blob is not None:
                    at, tree = (shard, size), pickle.loads(blob)
                    continue
                if at != (shard, size):
                    continue  # no vector of this length in the shard
                q = np.asarray(v, np.float64)
                exact = tree.points.dtype != object and float(np.abs(q).max()) * max(1.0, tree.largest) * len(q) < 2**52
                points = tree if exact else tree.exact()
                q = q if exact else np.array([int(x) for x in v], object)
                low = None if pd.isna(floor) else int(floor)
                rows += [(int(own), i, min(max(s, LOW), HIGH), _rank_key(s)) for s, i in points.search(q, int(own), k, low)]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "place"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of whole-number vectors given as (id, v array<double>)."""
    spark = rows.sparkSession
    points = materialize(rows.select("id", "v"))
    asked = materialize(queries.select("id", "v").distinct())
    n = points.count()
    shards = max(1, -(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    dealt = points.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.size("v").alias("size"), "id", "v")
    trees = materialize(dealt.groupBy("shard", "size").applyInPandas(_build, "shard bigint, size int, tree binary"))
    home = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards))

    def meet(some: DataFrame) -> DataFrame:
        """``some``: (shard, id, v, floor)."""
        left = trees.select("shard", "size", "tree", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("long").alias("floor"))
        right = some.select("shard", F.size("v").alias("size"), F.lit(None).cast("binary").alias("tree"), "id", "v", "floor")
        both = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "size", F.col("tree").isNull())
        return both.mapInPandas(_stream(k), "query_id bigint, vec_id bigint, score bigint, place binary")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("place", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = materialize(meet(asked.select(home.alias("shard"), "id", "v", F.lit(None).cast("long").alias("floor"))))
    # The kth score of a query in its home shard; none where it lies at an end of what a long holds.
    kth = best(first).groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= k) & (F.col("floor") > LOW))
    floors = kth.select(F.col("query_id").alias("id"), "floor")
    other = asked.select("id", "v", home.alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    others = other.where("shard <> home").join(floors, "id", "left")
    found = first if shards == 1 else first.unionByName(meet(others))
    return best(found).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): components floor(scale * x) in double; unusable vectors left out."""
    x = F.col(vec_col).cast("array<double>")
    usable = F.size(x) > 0
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * float(scale)) < float("inf")))
    # doubles of 2^53 and more are whole; the function floor would end at the largest long
    scaled = F.transform(x, lambda c: F.when(F.abs(c * float(scale)) < 2.0**53, F.floor(c * float(scale)).cast("double")).otherwise(c * float(scale)))
    return vectors.where(F.col(vec_col).isNotNull() & usable & finite & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), scaled.alias("v")
    )
