"""Byte-balanced sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the id). The splitters between shards
are found by counting: each round lays probes into the interval that still holds a
splitter, counts the exact bytes below every probe in one pass with map-side sums,
and keeps the two neighbours of the target. It ends when every splitter is within
tolerance. A splitter falls inside a group of equal texts only if no boundary between
groups is within tolerance (the group is then cut by the second hash). Rows move once,
after the splitters are known.

Law: ``bytes``. Every shard's bytes are within ``tolerance`` of an equal share, as far
as the largest row allows. Defined results: NULL text counts 0 bytes plus the row's
overhead and hashes like any value; NULL ids are allowed; rows equal in id and text
stay together; an empty table gives an empty result; other columns are kept by
``split`` and ignored by ``assign``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialize

LOW, HIGH = -(2**63), 2**63 - 1
OVERHEAD = 8  # bytes of a row besides its text
PROBES = 63  # new probes per open splitter and round
ROWS_PER_PART = 100_000


@dataclass(frozen=True)
class Splitters:
    """Cuts (h, k): rows with (hash, second hash) >= cut lie above it. In ascending order."""

    cuts: tuple[tuple[int, int], ...]
    total_bytes: int
    rows: int
    rounds: int

    def shard(self, h: Column, k: Column) -> Column:
        """The shard number as a balanced tree of comparisons."""

        def tree(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            ch, ck = self.cuts[mid]
            return F.when((h < ch) | ((h == ch) & (k < ck)), tree(low, mid)).otherwise(tree(mid + 1, high))

        return tree(0, len(self.cuts))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.col(id_col)).alias("k"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("rid"),
    )


def _below(keys: DataFrame, probes: dict[int | None, list[int]]) -> dict[int | None, np.ndarray]:
    """Exact bytes below each probe. Probes under None are on h over all rows; under a value of h, on k among its rows."""
    groups = [(g, np.array(p, np.int64)) for g, p in sorted(probes.items(), key=lambda x: (x[0] is not None, x[0] or 0))]

    def run(batches):
        sums = [np.zeros(len(p) + 1, np.int64) for _, p in groups]
        for batch in batches:
            h, k, size = (np.asarray(batch.column(i), dtype=np.int64) for i in range(3))
            for (g, p), s in zip(groups, sums, strict=True):
                on, w = (h, size) if g is None else (k[h == g], size[h == g])
                np.add.at(s, np.searchsorted(p, on, side="right"), w)
        at = [(i, j, int(v)) for i, s in enumerate(sums) for j, v in enumerate(s) if v]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*at, strict=True)], ["g", "b", "n"])

    counted = keys.select("h", "k", "size").mapInArrow(run, "g bigint, b bigint, n bigint")
    out = [np.zeros(len(p) + 1, np.int64) for _, p in groups]
    for r in counted.groupBy("g", "b").agg(F.sum("n").alias("n")).collect():  # at most the number of probes
        out[r.g][r.b] = r.n
    return {g: np.cumsum(s)[:-1] for (g, _), s in zip(groups, out, strict=True)}


@dataclass(frozen=True)
class _Open:
    """A splitter not yet found: between keys ``lo`` and ``hi``, on h, or on k inside the group of hash ``group``."""

    group: int | None
    base: int  # bytes below the group
    lo: int
    below_lo: int
    hi: int
    below_hi: int

    def probes(self) -> list[int]:
        n = min(PROBES, self.hi - self.lo - 1)
        return [self.lo + (self.hi - self.lo) * j // (n + 1) for j in range(1, n + 1)]

    def refine(self, counted: list[tuple[int, int]], target: float, slack: float) -> _Open | tuple[int, int]:
        """The narrower interval after counting (key, bytes below it), or the cut if it is found."""
        known = [(self.lo, self.below_lo)]
        known += [(p, b + self.base) for p, b in counted if self.lo < p < self.hi]
        known.append((self.hi, self.below_hi))
        nearest = min(known, key=lambda x: abs(x[1] - target))
        if abs(nearest[1] - target) <= slack:
            return (nearest[0], LOW) if self.group is None else (self.group, nearest[0])
        i = max(j for j, x in enumerate(known[:-1]) if j == 0 or x[1] <= target)
        (lo, below_lo), (hi, below_hi) = known[i], known[i + 1]
        if hi - lo > 1:
            return _Open(self.group, self.base, lo, below_lo, hi, below_hi)
        if self.group is None:  # one hash value straddles the target: go on inside its group
            return _Open(lo, below_lo, LOW, below_lo, HIGH, below_hi)
        return self.group, nearest[0]


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float) -> Splitters:
    """Refine probes until each of the ``n_shards`` - 1 splitters meets the tolerance."""
    head = keys.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, rounds = int(head.b or 0), 0
    slack = tolerance * total / n_shards / 2
    state: dict[int, _Open] = {i: _Open(None, 0, LOW, 0, HIGH, total) for i in range(1, n_shards)}
    cuts: dict[int, tuple[int, int]] = {}
    if not total:
        return Splitters(((HIGH, HIGH),) * (n_shards - 1), 0, 0, 0)
    while state:
        rounds += 1
        asked: dict[int | None, list[int]] = {}
        for s in state.values():
            asked.setdefault(s.group, []).extend(s.probes())
        asked = {g: sorted(set(p)) for g, p in asked.items()}
        found = _below(keys, asked)
        counted = {g: list(zip(asked[g], map(int, found[g]), strict=True)) for g in asked}
        after = {i: s.refine(counted[s.group], total * i / n_shards, slack) for i, s in state.items()}
        cuts |= {i: x for i, x in after.items() if isinstance(x, tuple)}
        state = {i: x for i, x in after.items() if isinstance(x, _Open)}
    return Splitters(tuple(sorted(cuts.values())), total, int(head.n), rounds)


def assign(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01
) -> DataFrame:
    """Rows (id, size, crc, shard, slot): where every row goes; slots are gapless from 0 in each shard."""
    keys = materialize(_keys(docs, id_col, text_col))
    splitters = find_splitters(keys, n_shards, tolerance)
    parts = max(64, -(-splitters.rows // (n_shards * ROWS_PER_PART)))
    placed = keys.select(
        "id", "size", "crc", "rid",
        splitters.shard(F.col("h"), F.col("k")).alias("shard"),
        F.pmod(F.xxhash64("rid"), F.lit(parts)).alias("part"),
    )
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("rid")
    return (
        placed.withColumn("nth", F.row_number().over(within) - 1)
        .join(base, ["shard", "part"])
        .select("id", "size", "crc", "shard", (F.col("base") + F.col("nth")).alias("slot"))
    )


def split(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01,
    shard_col: str = "shard",
) -> DataFrame:
    """``docs`` with a shard column, for ``write.partitionBy(shard_col)``."""
    splitters = find_splitters(materialize(_keys(docs, id_col, text_col)), n_shards, tolerance)
    text = F.col(text_col).cast("string")
    return docs.withColumn(shard_col, splitters.shard(F.xxhash64(text), F.xxhash64(F.col(id_col))))
