"""Best-fit-decreasing packing of token sequences at corpus scale.

Lengths are whole numbers of at most ``capacity``, so all that best fit decreasing
needs to know of the corpus is how many pieces have each length. These counts are
summed by Spark; the packing itself runs over them with a segment tree over remaining
capacities, which finds the tightest open bin in logarithmic time and places a whole
run of equal pieces into a whole run of equal bins at once. Its cost and its plan are
bounded by the capacity, not by the corpus: each length splits at most one run of bins
and opens at most two, and a bin's free space more than halves whenever it takes all
it can of a length, so there are at most 3 * capacity * (log2 capacity + 1) runs. The
plan says for each length which bin and offset its r-th piece takes; pieces get their
rank from counts per partition and look their place up.

Defined results: NULL or empty text is one piece holding the end id; longer documents
are cut into full pieces from the end, so the first may be shorter; repeated rows and
NULL ids are packed like any other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.tokenize import encoder, runs_of
from weft.session import materialize


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which have an open bin."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = np.zeros(2 * self.leaves, bool).tolist()

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need with an open bin."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


@dataclass(frozen=True)
class Plan:
    """Runs of places: pieces of ``length`` ranked from ``rank`` fill ``per`` places in each bin from ``bin`` at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of pieces given by length and rank among pieces of that length."""
        order = np.lexsort((rank, length))
        key = np.rec.fromarrays((self.length, self.rank))
        at = np.searchsorted(key, np.rec.fromarrays((length[order], rank[order])), side="right") - 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        at = at[back]
        nth = rank - self.rank[at]
        return self.bin[at] + nth // self.per[at], self.offset[at] + nth % self.per[at] * length


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Pack ``counts`` pieces of each length into bins of ``capacity``."""
    tree, open_bins = CapacityTree(capacity), {}  # remaining capacity -> runs (first bin, number)
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        put_back: list[tuple[int, int, int]] = []
        while left:
            free = tree.tightest(length)
            if free is None:
                fit = capacity // length
                number = -(-left // fit)
                first, bins, free = bins, bins + number, capacity
            else:
                first, number = open_bins[free].pop()
                if not open_bins[free]:
                    tree.set(free, False)
            fit = free // length
            whole = min(number, left // fit)
            if whole:
                runs.append((length, rank, first, fit, capacity - free))
                put_back.append((free - fit * length, first, whole))
                rank, left = rank + whole * fit, left - whole * fit
            used = whole
            if left and used < number:  # the last pieces of this length share one bin
                runs.append((length, rank, first + used, left, capacity - free))
                put_back.append((free - left * length, first + used, 1))
                rank, left, used = rank + left, 0, used + 1
            if used < number:
                put_back.append((free, first + used, number - used))
        for free, first, number in put_back:
            open_bins.setdefault(free, []).append((first, number))
            tree.set(free, True)
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return Plan(*columns, bins)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for a shorter first."""
    head = total % capacity
    starts = [0] * bool(head) + list(range(head, total, capacity))
    return [(s, (head if s == 0 and head else capacity)) for s in starts]


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Rows (id, piece, start, length, crc) of every document's tokens, cut; ``ids``, little-endian uint32, if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, whole, enc = batch.column(0), batch.column(1), encoder(tokenizer)
            for a, b in runs_of(whole):
                ids, edges = enc.encode_flat(whole[a:b], end_id)
                at, rows = [], []
                for i, (left, right) in enumerate(pairwise(edges.tolist()), a):
                    for n, (s, size) in enumerate(cut(right - left, capacity)):
                        data = ids[left + s : left + s + size]
                        at.append(i)
                        rows.append((n, s, size, zlib.crc32(data), *([data.tobytes()] if with_ids else [])))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=False)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *columns], NAMES[: len(columns) + 1])

    NAMES = ["id", "piece", "start", "length", "crc", "ids"]
    TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return slim.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, crc bigint" + ", ids binary" * with_ids)


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Add (sequence_id, offset) to rows with a ``length`` of 1 to ``capacity``."""
    stored = materialize(parts.withColumn("pid", F.spark_partition_id()).withColumn("rid", F.monotonically_increasing_id()))
    per_part = stored.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    per_part = materialize(per_part)
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = best_fit_decreasing(counts, capacity)
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("pid", "length").orderBy("rid")
    ranked = (
        stored.withColumn("nth", F.row_number().over(within) - 1)
        .join(base.hint("merge"), ["pid", "length"])  # both sides are dealt alike; base grows with the partitions
        .withColumn("rank", F.col("base") + F.col("nth"))
        .drop("base", "nth", "pid", "rid")
    )
    fields = [f.name for f in ranked.schema if f.name != "rank"]

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), dtype=np.int64) for c in ("length", "rank"))
            bins, offset = plan.place(length, rank)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(offset)], [*fields, "sequence_id", "offset"])

    schema = ranked.select(*fields, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(run, schema)
