"""Vector operators: normalisation, exact neighbours by pruned blocks, thresholds, pooling.

Neighbour searches deal the searched vectors to cells around pivots, a bounded sample of them, and
keep for each cell its radius, the largest angle to its pivot. By the triangle inequality of angles no vector
of a cell is nearer to a query than the query's angle to the pivot less the radius. Queries of the same and
of small cells form chunks of bounded size, one a partition; the vectors, packed by the dozen into binary rows,
are sent to each chunk that one of their cell can pass the threshold for. A task streams them past its
chunk, those of the queries' own cells first: it multiplies a strip of queries that the cell can still hold
better ones for with a slice of vectors in numpy and carries each query's kth score on, so its memory
depends on neither table's size and only results leave it. Without structure every chunk
meets every vector: rows sent are the searched vectors times the chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialize, release

BLOCK = 2048
PIVOTS = 512
CHUNK, CHUNKS = 16384, 48  # most queries of a chunk; chunks at least, to keep many tasks busy
PACKED = 8192  # bytes of a packed row: ten thousand of them, a batch, are 80 MB
STRIP, HELD = 1 << 20, 1 << 21  # scores computed at once, results held before the best are kept
TIED = 1.1e-9  # scores that agree to 9 places differ by less
MARGIN = 1e-6  # of an angle, more than arc cosines of doubles can be off by


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Divided by its norm; a zero vector stays as it is."""
    norms = F.array(F.sqrt(dot(v, v)))  # bound to a name below, so that it is computed once and not for each component

    def divided(norm: Column) -> Column:
        return F.transform(v.cast("array<double>"), lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))

    return F.element_at(F.transform(norms, divided), 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def _units(col: pd.Series) -> np.ndarray:
    m = np.array(col.tolist(), np.float64)
    return _unit_rows(m.reshape(len(m), -1))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def _reach(u: np.ndarray, cell: int, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """No vector of the cell has a score over this with the queries."""
    if cell == len(pivots):
        return np.ones(len(u))
    angle = np.arccos(np.clip(u @ pivots[cell], -1, 1))
    angle[~u.any(1)] = 0
    return np.cos(np.clip(angle - radius[cell] - MARGIN, 0, np.pi))


class Cells:
    """The searched vectors in cells around pivots. Zero vectors, which have no angle, are in a cell that everyone visits."""

    def __init__(self, rows: DataFrame, block: int = BLOCK):
        self.block = block
        known = _asked(rows)
        n = known.count()
        chosen = known.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, -(-n // block)))).collect()  # a bounded sample
        pivots = self.pivots = _units(pd.Series([r.v for r in chosen])) if chosen else np.zeros((1, 1))

        def place(batches):
            for batch in batches:
                if len(batch):
                    u = _units(batch.v)
                    near = u @ pivots.T
                    cell = near.argmax(1)
                    angle = np.arccos(np.clip(near[np.arange(len(u)), cell], -1, 1))
                    zero = ~u.any(1)
                    yield batch.assign(cell=np.where(zero, len(pivots), cell), angle=np.where(zero, np.pi, angle))

        self.rows = materialize(known.mapInPandas(place, f"id {known.schema['id'].dataType.simpleString()}, v {known.schema['v'].dataType.simpleString()}, part bigint, cell int, angle double"))
        self.radius, self.sizes = np.full(len(pivots) + 1, -np.inf), np.zeros(len(pivots) + 1, int)
        for r in self.rows.groupBy("cell").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # one row a pivot
            self.radius[r.cell], self.sizes[r.cell] = r.r, r.n

    def visits(self, queries: DataFrame, home: bool, min_score: float | None, by: str = "id") -> DataFrame:
        """(cell, ``by``) once a batch: queries or their chunks, with their home cells or with the other cells that can hold scores over the least."""
        pivots, radius = self.pivots, self.radius
        lowest = -np.inf if min_score is None else min_score - 1e-12

        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                u = _units(batch.v)
                first, here = (u @ pivots.T).argmax(1), np.zeros((len(u), len(radius)), bool)
                if home:
                    here[np.arange(len(u)), first] = True
                else:
                    for cell in range(len(radius)):
                        here[:, cell] = _reach(u, cell, pivots, radius) >= lowest - 1e-12
                    here[np.arange(len(u)), first] = False
                here &= radius > -np.inf  # cells that hold something
                row, cell = np.nonzero(here)
                yield pd.DataFrame({"cell": cell.astype("int32"), by: batch[by].to_numpy()[row]}).drop_duplicates()

        return queries.mapInPandas(run, f"cell int, {by} {queries.schema[by].dataType.simpleString()}")

    def _chunked(self, queries: DataFrame) -> DataFrame:
        """(chunk, id, v, part): queries of one cell, or of several small ones, in chunks of bounded size."""
        pivots = self.pivots

        def place(batches):
            for batch in batches:
                if len(batch):
                    yield batch.assign(cell=(_units(batch.v) @ pivots.T).argmax(1).astype("int32"))

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        placed = materialize(queries.mapInPandas(place, f"{kinds}, cell int"))
        sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # one row a pivot
        most = min(CHUNK, max(self.block // 4, -(-sum(sizes.values()) // CHUNKS)))
        at, full, plan = 0, 0, []
        for cell, n in sorted(sizes.items()):
            if full and full + n > most:
                at, full = at + 1, 0
            parts = -(-n // most)
            plan.append((cell, at, parts))
            at, full = (at + parts, 0) if parts > 1 else (at, full + n)
        self.chunks = at + 1
        dealt = placed.sparkSession.createDataFrame(plan, "cell int, _at int, _parts int")
        chunk = F.col("_at") + F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
        return materialize(placed.join(F.broadcast(dealt), "cell").select(chunk.alias("chunk"), "id", "v", "part"))

    def _packed(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, ids, parts, vs) of rows (key, id, v, part): some vectors of one key as the bytes of their components."""
        kind = "float32" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "float64"

        def pack(batches):
            for batch in batches:
                for k, g in batch.groupby(key, sort=False):
                    m = np.array(g.v.tolist(), kind)
                    each = max(1, PACKED // max(1, m[0].nbytes))
                    cuts = range(0, len(g), each)
                    ids, parts = g.id.to_numpy(), g.part.to_numpy()
                    yield pd.DataFrame({
                        key: np.full(len(cuts), k, "int32"), "ids": [ids[i : i + each] for i in cuts],
                        "parts": [parts[i : i + each] for i in cuts], "vs": [m[i : i + each].tobytes() for i in cuts],
                    })

        dealt = rows.repartition(key, F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions(key)  # a cell is not one task
        return dealt.mapInPandas(pack, f"{key} int, ids array<{rows.schema['id'].dataType.simpleString()}>, parts array<bigint>, vs binary")

    def search(self, queries: DataFrame, k: int | None, min_score: float | None) -> DataFrame:
        """(source, target, score, rank): of each query (id, v, part) the k best of its part at the least score or over it, or all pairs of smaller and larger id."""
        kind = self.rows.schema["id"].dataType.simpleString()
        told = f"source {kind}, target {kind}, score double, rank int"
        if not self.sizes.any():
            return self.rows.sparkSession.createDataFrame([], told)
        asked = self._chunked(queries)
        pairs = self.visits(asked, True, min_score, "chunk").distinct().withColumn("turn", F.lit(1))
        pairs = materialize(pairs.unionByName(self.visits(asked, False, min_score, "chunk").distinct().withColumn("turn", F.lit(2))))
        pairs = pairs.groupBy("cell", "chunk").agg(F.min("turn").alias("turn"))
        if pairs.count() < 1 << 20:
            pairs = F.broadcast(pairs)
        packed = materialize(self._packed(self.rows, "cell"))
        names = ("chunk", "turn", "cell", "ids", "parts", "vs")
        ask = materialize(self._packed(asked, "chunk")).withColumns({"turn": F.lit(0), "cell": F.lit(-1)})
        dealt = ask.select(*names).unionByName(packed.join(pairs, "cell").select(*names))
        dealt = dealt.repartitionById(self.chunks, F.col("chunk")).sortWithinPartitions("chunk", "turn", "cell")
        dtypes = [np.float32 if d.schema["v"].dataType.elementType.simpleString() == "float" else np.float64 for d in (queries, self.rows)]
        pivots, radius, block = self.pivots, self.radius, self.block
        lowest = -np.inf if min_score is None else min_score - 1e-12

        def unpacked(rows: pd.DataFrame, dtype):
            ids = np.concatenate(rows.ids.to_list())
            return ids, np.concatenate(rows.parts.to_list()), _unit_rows(np.frombuffer(b"".join(rows.vs), dtype).reshape(len(ids), -1))

        def run(batches):
            chunk, waiting, best = None, [], None
            for batch in batches:
                turns = batch[["chunk", "turn", "cell"]].to_numpy()
                cuts = [0, *(np.flatnonzero((turns[1:] != turns[:-1]).any(1)) + 1), len(batch)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi:
                        continue
                    at, turn, cell = turns[lo]
                    if at != chunk:
                        if best is not None:
                            yield from best.rows()
                        chunk, waiting, best = at, [], None
                    if turn == 0:
                        waiting.append(unpacked(batch[lo:hi], dtypes[0]))
                        continue
                    if best is None:
                        if not waiting:
                            continue
                        best = _Best(*(np.concatenate(x) for x in zip(*waiting)), k, lowest)
                        waiting = []
                    bound = _reach(best.u, cell, pivots, radius)
                    ids, parts, u = unpacked(batch[lo:hi], dtypes[1])
                    for i in range(0, len(ids), block):
                        yield from best.meet(ids[i : i + block], parts[i : i + block], u[i : i + block], bound)
            if best is not None:
                yield from best.rows()

        return dealt.mapInPandas(run, told)


class _Best:
    """The best found so far for the queries of a chunk."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray, u: np.ndarray, k: int | None, lowest: float):
        self.ids, self.parts, self.u, self.k = ids, parts, u, k
        self.floor = np.full(len(ids), lowest)
        self.found, self.held, self.kept = [], 0, 0
        self.whole = not (parts != parts[0]).any()

    def meet(self, ids: np.ndarray, parts: np.ndarray, u: np.ndarray, bound: np.ndarray):
        """Scores a slice of vectors; without k, yields what passes."""
        k, asked = self.k, np.flatnonzero(bound >= self.floor - 1e-12)
        step = max(1, STRIP // max(1, len(ids)))
        for i in range(0, len(asked), step):
            q = asked[i : i + step]
            s = self.u[q] @ u.T
            there = s >= self.floor[q, None]
            if k is not None and k < len(ids) and np.count_nonzero(there) > 4 * k * len(q):  # no more than the k best of this slice
                s[(self.ids[q, None] == ids) | np.isnan(s)] = -np.inf
                kth = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                there &= s >= kth[:, None] - TIED
            row, col = np.nonzero(there)
            score = s[row, col]
            row = q[row]
            own, other = self.ids[row], ids[col]
            ok = (own < other if k is None else own != other) & (score > -np.inf)
            if not self.whole or (parts != self.parts[0]).any():
                ok &= self.parts[row] == parts[col]
            if k is None:
                yield pd.DataFrame({"source": own[ok], "target": other[ok], "score": score[ok], "rank": np.zeros(ok.sum(), "int32")})
                continue
            self.found.append((row[ok], other[ok], score[ok]))
            self.held += len(self.found[-1][0])
            if self.held > self.kept + HELD:
                self.keep()

    def keep(self):
        """Of each query the k best, scores that agree to 9 places by the smaller id."""
        row, other, score = (np.concatenate(x) for x in zip(*self.found))
        by_id = other if other.dtype != object else np.unique(other, return_inverse=True)[1]
        order = np.lexsort((by_id, -np.round(score, 9), row))
        row = row[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        first = place < self.k
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[order[last]] - TIED)
        order = order[first]
        self.found = [(row[first], other[order], score[order])]
        self.held = self.kept = len(order)
        return place[first]

    def rows(self):
        if self.found:
            rank = self.keep() + 1
            row, other, score = self.found[0]
            for i in range(0, len(row), STRIP // 8):
                cut = slice(i, i + STRIP // 8)
                yield pd.DataFrame({"source": self.ids[row[cut]], "target": other[cut], "score": score[cut], "rank": rank[cut].astype("int32")})


def _asked(rows: DataFrame) -> DataFrame:
    known = rows.where(F.col("v").isNotNull() & F.col("id").isNotNull())
    return known.select("id", "v", F.col("part").cast("bigint") if "part" in rows.columns else F.lit(0).cast("bigint").alias("part"))


def neighbours(left: DataFrame, right: DataFrame, k: int, min_score: float | None = None, block: int = BLOCK) -> DataFrame:
    """(source, target, score, rank): the k nearest of ``right`` by cosine for each of ``left``, without itself; ties to the smaller id.

    Both sides are (id, v), vectors of one length; NULL ids and vectors take no part. Scores that agree to 9
    places tie; the threshold holds before any rounding.
    """
    asked = materialize(_asked(left))
    found = Cells(right, block).search(asked, k, min_score)
    rows, ids = asked.agg(F.count("id"), F.count_distinct("id")).first()
    if rows == ids:
        return found
    w = Window.partitionBy("source").orderBy(F.desc(F.round("score", 9)), "target")  # rows that share an id are ranked together
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(i, j, score), i < j: all pairs whose cosine is ``threshold`` or more. Rows are (id, v), as in :func:`neighbours`,

    or (id, v, part), where only pairs that agree in the whole number ``part`` count.
    """
    cells = Cells(rows, block)
    found = cells.search(_asked(cells.rows), None, threshold)
    return found.select(F.col("source").alias("i"), F.col("target").alias("j"), "score")


def knn_self_join(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """(i, j, score), i < j: pairs at or over the threshold that either end has among its k nearest."""
    # Scores under the threshold may tie with one at it and take its place.
    found = neighbours(rows, rows, k, threshold - TIED).where(F.col("score") >= threshold)
    pairs = found.select(F.least("source", "target").alias("i"), F.greatest("source", "target").alias("j"), "score")
    return pairs.groupBy("i", "j").agg(F.round(F.max("score"), 6).alias("score"))


def mean_pool(chunks: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, v): the mean of the normalised chunk vectors of each key, one vector of sums a key and map task."""
    units = chunks.where(F.col(vec).isNotNull()).select(key, array_to_vector(l2_normalize(F.col(vec))).alias("_u"))
    return units.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_u"))).alias("v"))


def dedup_clusters(pairs: DataFrame, rows: DataFrame, threshold: float, *rank: Column | str) -> DataFrame:
    """(id, cluster_id, representative, score, outcome) of every row (id, v, what ranks).

    Linked rows are one cluster; the first by ``rank``, then id, represents it and is kept, members whose cosine to it is
    ``threshold`` or more are dropped, others are neither. Clusters are numbered from 1 by their smallest id; a row on its
    own is kept and has no number.
    """
    from weft.operators.components import connected_components
    from weft.operators.graph import with_dense_id

    label = connected_components(pairs, "i", "j")
    keyed = rows.withColumn("_rank", F.struct(*rank, "id")).select("id", "v", "_rank")
    placed = keyed.join(label, keyed.id == label.node, "left").withColumn("root", F.coalesce("root", "id"))
    best = placed.groupBy("root").agg(F.min_by(F.struct("id", "v"), "_rank").alias("_best"), F.count(F.lit(1)).alias("_n"))
    numbers = with_dense_id(best.where("_n > 1").select("root"), "cluster_id", "root")
    scored = placed.join(best.where("_n > 1"), "root").join(numbers, "root")
    score = F.when(F.col("id") == F.col("_best.id"), 1.0).otherwise(cosine(F.col("v"), F.col("_best.v")))
    outcome = F.when(F.col("id") == F.col("_best.id"), "keep").when(score >= threshold, "drop").otherwise("neither")
    linked = scored.select("id", "cluster_id", F.col("_best.id").alias("representative"), F.round(score, 6).alias("score"), outcome.alias("outcome"))
    alone = best.where("_n = 1").select(F.col("root").alias("id"), F.lit(None).cast("bigint").alias("cluster_id"), F.col("root").alias("representative"), F.lit(1.0).alias("score"), F.lit("keep").alias("outcome"))
    return linked.unionByName(alone)
