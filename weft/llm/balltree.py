"""Exact ranked lexical search with sparse ball trees.

A document's score for an item is an inner product of whole numbers: the item counts its
terms, the document holds for each term its weight times its saturated frequency. Documents are
reduced once to the terms that items have, then every task takes the documents it reads in
runs of bounded size and builds a ball tree over each run: nodes split at the median along a
direction in which their rows spread, and keep their centroid and the radius around it. By
Cauchy-Schwarz no document of a node scores above q * centroid + |q| * radius; the radius and
the bound are rounded up by more than floating point can lose. Nodes are visited best bound
first, until the best bound left is below the kth score that the task has found; leaves are
scored in whole numbers. A node that could tie is visited, so ties are exact.

No vector is shuffled and nothing depends on the ids, so a hot id or group of copies is dealt
like other rows. A task sends its k best for each item. Items are a stated query set: they go
to the tasks in parts of at most ``ITEM_BYTES`` of text (one item at least), each part with its
own pass over the documents; the driver holds a part's terms with their document counts.

Defined results: NULL and termless documents have no terms and are never returned; NULL and
termless items have no rows; a NULL doc_id counts as a document and comes last among equal
scores; documents that repeat an id are documents of their own; items that repeat id and text
are one item, each text of a repeated id is ranked on its own; an empty table on either side
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialize, release

LEAF = 128  # documents of a leaf at most
RUN = 1 << 20  # entries of the documents of one tree, about
ITEM_BYTES = 16 << 20
_PIECE = 1 << 22  # bytes of a text that are split into words at once
_WORD = "0123456789abcdefghijklmnopqrstuvwxyz".encode()
#: A-Z to lower case; what is no part of a term to a space. Bytes over 127 are parts of letters.
_CLASSES = bytes(b if b > 127 or b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes):
    """Lists of the terms of a text, in order, a bounded piece of it at a time."""
    at = 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        piece = text[at:end].translate(_CLASSES)
        while end < len(text) and piece[-1:] != b" ":  # up to the end of the term
            more = text[end : end + 256].translate(_CLASSES)
            cut = more.find(b" ") + 1 or len(more)
            piece, end = piece + more[:cut], end + cut
        yield piece.split()
        at = end


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs): the length in terms of each document with its counts of known terms."""

    def run(batches):
        known = vocabulary.get
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                n, found = 0, Counter()
                for words in terms_of(text.as_py() or b""):
                    n += len(words)
                    found.update(map(known, words))
                found.pop(None, None)
                sizes.append(n)
                terms.extend(found.keys())
                tfs.extend(found.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return slim.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of several ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class BallTree:
    """Sparse rows of whole numbers: row i has ``values[edges[i]:edges[i+1]]`` at ``terms[...]``."""

    def __init__(self, edges: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int = LEAF):
        self.known, terms = np.unique(terms, return_inverse=True)
        self.width, reals = len(self.known), values.astype(np.float64)
        sizes = np.diff(edges)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        norms = np.bincount(rows, reals * reals, len(sizes))
        order = np.arange(len(sizes))
        self.kids, self.spans, self.radius, centroids = [], [], [], []
        todo = [(0, len(order), None)]
        while todo:
            a, b, parent = todo.pop()
            me, mine = len(self.kids), order[a:b]
            if parent is not None:
                self.kids[parent].append(me)
            at, row = _spread(edges[mine], sizes[mine]), np.repeat(np.arange(b - a), sizes[mine])
            t, v = terms[at], reals[at]
            centre = np.bincount(t, v, self.width) / (b - a)
            far = norms[mine] - 2 * np.bincount(row, v * centre[t], b - a) + centre @ centre
            # What the sums above can be off by is far below a 1e-9th of their parts.
            self.radius.append(math.sqrt(max(0.0, far.max()) + 1e-9 * (norms[mine].max() + centre @ centre)))
            at_terms = np.flatnonzero(centre)
            centroids.append((at_terms, centre[at_terms], np.full(len(at_terms), me)))
            self.kids.append([])
            self.spans.append((a, b))
            if b - a > leaf:
                # From a random direction two steps towards that in which the rows spread most.
                along = np.random.default_rng(me).standard_normal(self.width)
                for _ in range(2):
                    by = np.bincount(row, v * along[t], b - a)
                    along = np.bincount(t, v * (by - by.mean())[row], self.width)
                    along /= np.abs(along).max() or 1.0
                by = np.bincount(row, v * along[t], b - a)
                half = (b - a) // 2
                order[a:b] = mine[np.argpartition(by, half)]
                todo += [(a + half, b, me), (a, a + half, me)]
        self.order, self.radius = order, np.array(self.radius)
        # Centroids by term, and the rows' entries by leaf and term.
        ct, cv, cn = (np.concatenate(x) for x in zip(*centroids, strict=True))
        by = np.argsort(ct, kind="stable")
        self.c_edges, self.c_value, self.c_node = np.searchsorted(ct[by], np.arange(self.width + 1)), cv[by], cn[by]
        leaf_of = np.empty(len(order), np.int64)
        for node, (a, b) in enumerate(self.spans):
            if not self.kids[node]:
                leaf_of[order[a:b]] = node
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key = leaf_of[rows] * self.width + terms
        by = np.argsort(key, kind="stable")
        self.key, self.value, self.place = key[by], values[by], place[rows[by]]

    def bounds(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each node, no less than the inner product of the query with any of its rows."""
        sizes = self.c_edges[terms + 1] - self.c_edges[terms]
        at = _spread(self.c_edges[terms], sizes)
        inner = np.bincount(self.c_node[at], self.c_value[at] * np.repeat(counts, sizes), len(self.radius))
        return (inner + math.sqrt(float(counts @ counts)) * self.radius) * (1 + 1e-9)

    def scores(self, node: int, terms: np.ndarray, counts: np.ndarray, exact_in_doubles: bool) -> np.ndarray:
        """Whole-number inner products with the rows of a leaf, in their order."""
        a, b = self.spans[node]
        low = np.searchsorted(self.key, node * self.width + terms)
        sizes = np.searchsorted(self.key, node * self.width + terms, "right") - low
        at = _spread(low, sizes)
        products, rows = self.value[at] * np.repeat(counts, sizes), self.place[at] - a
        if exact_in_doubles:
            return np.bincount(rows, products, b - a).astype(np.int64)
        out = np.zeros(b - a, np.int64)
        np.add.at(out, rows, products)
        return out

    def search(self, terms: np.ndarray, counts: np.ndarray, floor: int):
        """Rows and scores of leaves, best bound first; send back the score below which nothing is wanted any more."""
        at = np.searchsorted(self.known, terms)
        here = (at < self.width) & (self.known[np.minimum(at, self.width - 1)] == terms)
        terms, counts = at[here], counts[here]
        if not len(terms):
            return
        exact = float(counts.sum()) * float(self.value.max()) < 2**52
        bound = self.bounds(terms, counts)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= floor:
            node = heapq.heappop(heap)[1]
            if self.kids[node]:
                for child in self.kids[node]:
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.spans[node]
            floor = yield self.order[a:b], self.scores(node, terms, counts, exact)


class Best:
    """The k best documents of one item: higher score, then smaller id, NULL last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> int:
        good = scores >= self.floor
        if good.any():
            score, own, null = (np.concatenate(x) for x in ((self.score, scores[good]), (self.id, ids[good]), (self.null, nulls[good])))
            by = np.lexsort((own, null, -score))[: self.k]
            self.score, self.id, self.null = score[by], own[by], null[by]
            if len(by) == self.k:
                self.floor = max(1, int(self.score[-1]))
        return self.floor


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _parts(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple]]:
    """Reads of the items (id, text), each of at most ``ITEM_BYTES`` of text or one item, as functions."""
    slim = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    size, n = slim.agg(F.sum(F.octet_length("t")), F.count(F.lit(1))).first()
    parts = -(-(size or 0) // ITEM_BYTES)
    part = lambda p: F.pmod(F.xxhash64("id", "t"), F.lit(p))
    while 1 < parts < n and slim.groupBy(part(parts)).agg(F.sum(F.octet_length("t")).alias("s"), F.count(F.lit(1)).alias("c")).where(f"c > 1 AND s > {ITEM_BYTES}").limit(1).count():
        parts *= 2
    return [lambda p=p: [(r.id, r.t) for r in slim.where(part(parts) == p).collect()] for p in range(parts)]


def _search(docs: DataFrame, asked: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(item, item_id, doc_id, score): every task's k best for each item of a part."""
    counted = [(i, Counter(w for words in terms_of(t.encode()) for w in words)) for i, t in asked]
    counted = [(i, c) for i, c in counted if c]
    vocabulary = {w: v for v, w in enumerate(sorted({w for _, c in counted for w in c}))}
    if not vocabulary:
        return None
    rows = materialize(vectors(docs, vocabulary, id_col, text_col))
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("v")).groupBy("v").count().toLocalIterator():
        df[r.v] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    items = [(i, np.array([vocabulary[w] for w in c]), np.array(list(c.values()), np.int64)) for i, c in counted]

    def run(batches):
        best = [Best(k) for _ in items]

        def search(ids, nulls, sizes, terms, values):
            tree = BallTree(np.concatenate(([0], np.cumsum(sizes))), terms, values)
            for (_, t, c), top in zip(items, best, strict=True):
                visits = tree.search(t, c, top.floor)
                found = next(visits, None)
                while found:
                    mine, scores = found
                    try:
                        found = visits.send(top.add(scores, ids[mine], nulls[mine]))
                    except StopIteration:
                        break

        held, entries = [], 0
        for batch in batches:
            ids, n, terms, tfs = batch.columns
            sizes = np.diff(np.asarray(terms.offsets))
            t, tf = np.asarray(terms.flatten()), np.asarray(tfs.flatten()).astype(np.int64)
            m = 25 + (75 * np.asarray(n) * n_docs) // n_terms
            y = weight[t] * saturated(tf, np.repeat(m, sizes))
            keep = y > 0  # entries of weight zero add nothing
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
            t, y = t[keep], y[keep]
            nulls, own = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
            edges, a = np.concatenate(([0], np.cumsum(sizes))), 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(edges, edges[a] + RUN - entries, "right")) - 1)
                some = np.flatnonzero(sizes[a:b]) + a  # rows without entries score nothing
                held.append((own[some], nulls[some], sizes[some], t[edges[a] : edges[b]], y[edges[a] : edges[b]]))
                entries, a = entries + int(edges[b] - edges[a]), b
                if entries >= RUN or a < len(sizes):
                    if entries:
                        search(*map(np.concatenate, zip(*held, strict=True)))
                    held, entries = [], 0
        if entries:
            search(*map(np.concatenate, zip(*held, strict=True)))
        number = np.repeat(np.arange(len(items)), [len(b.score) for b in best])
        if len(number):
            columns = [pa.array(number, pa.int32()), pa.array([items[i][0] for i in number.tolist()], pa.int64())]
            own, null, score = (np.concatenate([getattr(b, x) for b in best]) for x in ("id", "null", "score"))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, mask=null), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    found = rows.where(F.size("terms") > 0).mapInArrow(run, "item int, item_id bigint, doc_id bigint, score bigint")
    found._behind = rows
    return found


def top_k(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k highest-scoring documents of each item with a score above 0."""
    found = []
    for n, part in enumerate(_parts(items, item_id_col, item_text_col)):
        some = _search(docs, part(), k, id_col, text_col)
        if some is not None:
            found.append(materialize(some.select(F.lit(n).alias("part"), "*")))
            release(some._behind)
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("part", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
