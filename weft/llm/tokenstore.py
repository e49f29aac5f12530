"""Token ids in Simple-8b blocks.

A word of 64 bits holds a selector in its top four bits and up to 60 ids below, all of
the same width; the selector with the most ids that fit is taken at each place. An id
too wide for 60 bits, which only other producers could write, is escaped: selector 15
and then the value as a plain word. Words are grouped in blocks of ``BLOCK`` words;
per block the file holds where its ids start, so any block can be decoded alone and a
run of words is decoded for each selector at once.

The files are the rows that Spark commits, one per run of documents in ascending
order: the words, the block offsets, the documents' ids and where each starts. A
document is never split between rows, and rows are cut by size, so memory is bounded by
the row size or the longest document. Lost tasks are redone before anything is
committed.

Defined results: NULL or empty text is the end id alone; NULL document ids come first;
documents of one id follow each other by a hash of their text, repeated rows are written as
often as they occur; an empty table gives an empty file;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.tokenize import encoder, runs_of

#: Fixed values of the format: ids in a word and their width in bits, by selector; 15 escapes.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 1024
ROW_IDS = 1 << 18  # ids after which a row is closed


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, for each block the number of ids before it) of unsigned values."""
    values = np.asarray(values, "<u8")
    n = len(values)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4")
    width = np.zeros(n, np.uint8)
    for w in WIDTHS:
        width += values >> np.uint64(w) != 0  # the first selector whose width suffices
    # take[i]: the selector used if a word starts at i; widest first, so that the last that fits has most ids
    take = np.full(n, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        c = COUNTS[s]
        if c > n:
            continue
        bad = np.concatenate(([0], np.cumsum(width > s)))
        take[: n - c + 1][bad[c:] == bad[:-c]] = s
    step = np.array([*COUNTS, 0, 1])[take].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    selector = take[at]
    places = 1 + (selector == ESCAPE)
    to = np.cumsum(places) - places
    words = np.zeros(int(places.sum()), "<u8")
    for s in np.unique(selector).tolist():
        mine, here = at[selector == s], to[selector == s]
        if s == ESCAPE:
            words[here] = np.uint64(ESCAPE) << np.uint64(60)
            words[here + 1] = values[mine]
            continue
        word = np.full(len(mine), s, "<u8") << np.uint64(60)
        for k in range(COUNTS[s]):
            word |= values[mine + k] << np.uint64(k * WIDTHS[s])
        words[here] = word
    before = np.zeros(len(words), "<u4")
    before[to] = at
    before[to[selector == ESCAPE] + 1] = at[selector == ESCAPE] + 1
    return words, before[::BLOCK].copy()


def decode(words: np.ndarray) -> np.ndarray:
    """The values of words that start at a word start."""
    words = np.asarray(words, "<u8")
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == ESCAPE).any():  # the word after an escape is a value, whatever it looks like
        i, marks = 0, np.nonzero(selector == ESCAPE)[0].tolist()
        for m in marks:
            if m >= i:
                raw[m + 1] = True
                i = m + 2
    count = np.array([*COUNTS, 0, 0])[selector]
    count[raw] = 1
    to = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), "<u8")
    for s in range(len(COUNTS)):
        mine = np.nonzero((selector == s) & ~raw)[0]
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s] if len(mine) else 0):
            out[to[mine] + k] = words[mine] >> np.uint64(k * WIDTHS[s]) & mask
    out[to[raw]] = words[raw]
    return out


def decode_block(words: np.ndarray, before: np.ndarray, block: int) -> tuple[int, np.ndarray]:
    """(ids before it, ids) of one block. An escaped value belongs to the block of its selector."""
    words = np.asarray(words, "<u8")
    left, right = block * BLOCK, min((block + 1) * BLOCK, len(words))
    if left and _is_escape(words, left - 1):
        left += 1
    if right > left and _is_escape(words, right - 1):
        right += 1
    return int(before[block]), decode(words[left:right])


def _is_escape(words: np.ndarray, at: int) -> bool:
    if int(words[at] >> np.uint64(60)) != ESCAPE:
        return False
    run = 0  # in a run of such words the first is a selector, the next a value, and so on
    while at - run - 1 >= 0 and int(words[at - run - 1] >> np.uint64(60)) == ESCAPE:
        run += 1
    return run % 2 == 0


ROW = "part int, nth bigint, before bigint, docs bigint, ids bigint, keys binary, starts binary, words binary, blocks binary"


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode whole texts in ascending ``id_col`` and write the files."""

    def row(part, nth, before, keys, ids, sizes):
        words, blocks = encode(ids)
        nulls = np.array([k is None for k in keys])
        names = np.array([0 if k is None else k for k in keys], "<i8").tobytes() + np.packbits(nulls).tobytes()
        starts = np.concatenate(([0], np.cumsum(sizes))).astype("<u8").tobytes()
        return part, nth, before, len(keys), len(ids), names, starts, words.tobytes(), blocks.tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, nth, before = TaskContext.get().partitionId(), 0, 0
        keys, ids, sizes, held = [], [], [], 0
        for batch in batches:
            names, whole = batch.column(0).to_pylist(), batch.column(1)
            for a, b in runs_of(whole):
                flat, edges = encoder(tokenizer).encode_flat(whole[a:b], end_id)
                done = a
                while done < b:  # as many documents as fill the row
                    over = int(np.searchsorted(edges, edges[done - a] + ROW_IDS - held)) + a
                    upto = min(b, max(done + 1, over))
                    keys += names[done:upto]
                    ids.append(flat[edges[done - a] : edges[upto - a]])
                    sizes.append(np.diff(edges[done - a : upto - a + 1]))
                    held, done = held + len(ids[-1]), upto
                    if held >= ROW_IDS:
                        yield to_batch([row(part, nth, before, keys, np.concatenate(ids), np.concatenate(sizes))])
                        nth, before, keys, ids, sizes, held = nth + 1, before + held, [], [], [], 0
        if keys:
            yield to_batch([row(part, nth, before, keys, np.concatenate(ids), np.concatenate(sizes))])

    def to_batch(rows):
        kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 4]
        names = [x.split()[0] for x in ROW.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id, or of none, are parted too: by their text's hash, and equal rows by their place.
    keyed = slim.withColumns({"h": F.xxhash64("t"), "m": F.monotonically_increasing_id()})
    first = F.col("id").asc_nulls_first()
    ordered = keyed.repartitionByRange(parts, first, "h", "m").sortWithinPartitions(first, "h", "t").select("id", "t")
    ordered.mapInArrow(run, ROW).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Rows (id, start, n_tokens, ids): every document of the files, decoded. ``ids`` is little-endian uint32."""
    rows = spark.read.schema(ROW).parquet(path)
    # Rows know the ids before them in their partition; the partitions' sizes are one small row each.
    sizes = rows.groupBy("part").agg(F.sum("ids").alias("ids"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("ids").over(across), F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(base), "part").withColumn("first", F.col("base") + F.col("before"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = r["docs"]
                keys = np.frombuffer(r["keys"][: 8 * n], "<i8")
                null = np.unpackbits(np.frombuffer(r["keys"][8 * n :], np.uint8))[:n].astype(bool)
                starts = np.frombuffer(r["starts"], "<u8").astype(np.int64)
                ids = decode(np.frombuffer(r["words"], "<u8")).astype("<u4")
                data = [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                columns = [pa.array(keys, mask=null), pa.array(starts[:-1] + r["first"]), pa.array(np.diff(starts)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids"])

    slim = placed.select("docs", "keys", "starts", "words", "first")
    return slim.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids binary")



def round_trip(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into the shared folder and read them back."""
    import uuid

    from weft.session import shared_dir

    path = f"{shared_dir(docs.sparkSession)}/weft-tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id, id_col, text_col)
    return read(docs.sparkSession, path)


__all__ = ["encode", "decode", "decode_block", "write", "read", "round_trip"]
