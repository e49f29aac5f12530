"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints have 64 bits. Two that differ in at most 3 bits differ in at most one
bit of one of their 32-bit halves. The anchors of a half are the words of a covering
code: the perfect Hamming code of length 31 (covering radius 1) with the 32nd bit
free. Each fingerprint has one home anchor per half (at distance 0 or 1) and visits
every anchor within covering radius plus threshold (1 + 1), at most 17 of 2^27, so
every linked pair meets where one of them is at home. Pairs are compared there by
their full distance, and links are joined into components.

Copies share a fingerprint and are folded together before anything is replicated;
a group of a third of all rows costs one row per map task.

Defined results: NULL or word-less text has fingerprint zero and is linked like any
other; NULL ids keep their row and take no part in the choice of the smallest id;
repeated rows give repeated output rows; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.components import connected_components
from weft.session import materialize, release, shuffled

SEED = 42
_PART = 1 << 20  # hashes held at once while the bits of one text are counted


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the ``shingle``-word shingles of UTF-8 ``text``."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return int(np.uint64(digest(b" ".join(words), SEED)).view(np.int64))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    total, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for left in range(0, total, _PART):
        size = min(_PART, total - left)
        part = np.fromiter((digest(joined[a:b], SEED) for (a, b), _ in zip(spans, range(size))), np.uint64, size)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp long), one per input row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return slim.mapInArrow(run, f"id {kind}, fp bigint")


_BITS = np.arange(1, 32, dtype=np.int64)
_MASKS = [int(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)) for j in range(5)]


def _home(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest anchor of each 32-bit half, and the syndrome (0: it is an anchor itself)."""
    syndrome = np.zeros(len(half), np.int64)
    for j, mask in enumerate(_MASKS):
        syndrome |= (np.bitwise_count(half & mask).astype(np.int64) & 1) << j
    return half ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0), syndrome


def anchors(fps: np.ndarray, home_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys of fingerprints and the index of the fingerprint of each."""
    keys, rows = [], []
    words = fps.view(np.uint64) if fps.dtype == np.int64 else fps
    for side in (0, 1):
        half = ((words >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        home, syndrome = _home(half)
        base, index = np.int64(side) << 32, np.arange(len(half))
        keys.append(home + base)
        rows.append(index)
        if home_only:
            continue
        keys.append((home ^ (1 << 31)) + base)  # the free bit differs
        rows.append(index)
        for p in range(1, 32):  # the two-bit changes p < q with p ^ q = syndrome
            q = syndrome ^ p
            at = np.nonzero(q > p)[0]
            at = at[syndrome[at] > 0]
            keys.append((half[at] ^ (1 << (p - 1)) ^ (1 << (q[at] - 1))) + base)
            rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


def _replicate(fps: DataFrame, home_only: bool, name: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            values = np.asarray(batch.column(0), dtype=np.int64)
            if len(values):
                keys, rows = anchors(values, home_only)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], ["anchor", name])

    return fps.select("fp").mapInArrow(run, f"anchor bigint, {name} bigint")


def links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """Pairs (src, dst) of different fingerprints within ``max_distance`` (0 to 3) bits."""
    if not 0 <= max_distance <= 3:
        raise ValueError("two halves with one differing bit each cover distances up to 3")
    home, visit = _replicate(fps, True, "src"), _replicate(fps, False, "dst")
    near = (F.col("src") != F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_distance)
    return shuffled(home).join(visit, "anchor").where(near).select("src", "dst")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3
) -> DataFrame:
    """Rows (id, fp, component_id): the smallest id reachable over links, for every input row."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")))
    label = connected_components(links(distinct, max_distance))
    rooted = distinct.join(label, distinct.fp == label.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    group = materialize(rooted.join(smallest, "root").select("fp", "component_id"))
    release(distinct, label)
    return rows.join(group, "fp").select("id", "fp", "component_id")
