"""Benchmark decontamination: BM25 with block-max WAND, then exact overlap.

Test items are indexed: per term a posting list in order of items, and the largest impact in
each block of ``BLOCK_ITEMS`` items that the list meets (others are not stored). Impacts are
divided by the item's score against itself, so that one threshold holds for all items. Every
document is cut into overlapping passages of twice the longest item's words, a stride of one
such length apart, so that each stretch as long as an item lies whole in some passage. Each
passage is a query, and every item at or over the threshold is retrieved. For many passages at
a time, the sum of the terms' largest impacts, then the sums of their block maxima, tell which
passages can reach the threshold at all; each of these is searched with block-max WAND: lists
are kept in order of their next item, the pivot is where the largest impacts add up to the
threshold, a pivot whose block maxima do not is skipped with the rest of its block, and only
items that pass both are scored. A retrieved item is verified: its question and its answer (its
last sentence, or what follows an answer mark) must each have at least ``overlap`` of their
word shingles in the passage.

An index of more than ``INDEX_BYTES`` of text is dealt by a hash of id and text into parts of
half that size on average, with statistics of all items, taken with the same splitter. The
documents are scanned once per part, whose matches are written before the next part is made,
so that one part at a time is in memory; matches are united by row. Long documents are read in
stretches of passages.

Defined results: NULL or word-less text matches nothing; items that are NULL or without
words are ignored; an item shorter than a shingle is one shingle; items repeated under several
ids are reported under each id, repeated rows of items once; repeated rows of documents give
repeated rows; empty tables on either side give no match; other columns are kept by ``clean``
and ignored by ``matches``, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weft.llm.tokenize import batches_of
from weft.session import materialize, release

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of an item's score against itself
OVERLAP = 0.8
SHINGLE = 5
BLOCK_ITEMS = 4
INDEX_BYTES = 4 << 20
_CELLS = 1 << 22  # bounds held at once
SEARCHED = 1_000_000  # characters searched at once, or one text: some fifty times as many bytes are held meanwhile
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_ANSWER = re.compile(r"(?:^|\n)\s*(?:answer|a)\s*[:.]\s*", re.I)


def split_words(texts: list[str | None] | pa.Array) -> pa.LargeListArray:
    """Lower-cased runs of letters, digits and underscores; texts start and end with an empty one."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), r"[^\pL\pN_]+", " ")
    return pc.split_pattern(pc.fill_null(spaced, ""), " ")


def words_of(texts: list[str | None]) -> list[list[str]]:
    """The words of each text, all split in one call."""
    return [[w for w in ws if w] for ws in split_words(texts).to_pylist()]


def words(text: str | None) -> list[str]:
    return words_of([text])[0]


def _has_word(text: str) -> bool:
    return any(c.isalnum() or c == "_" for c in text)


def question_and_answer(text: str) -> tuple[str, str]:
    """The two parts of an item: at an answer mark, else before its last sentence."""
    m = None
    for m in _ANSWER.finditer(text):
        pass
    if m and _has_word(text[: m.start()]) and _has_word(text[m.end() :]):
        return text[: m.start()], text[m.end() :]
    parts = _SENTENCE.split(text.strip())
    if len(parts) > 1 and _has_word(parts[-1]):
        return text.strip()[: -len(parts[-1])], parts[-1]
    return text, text


def shingles(w: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


class Index:
    """Block-max inverted index of test items.

    ``df`` and ``n_items`` and ``mean_words`` are those of all items, if these are a part of them.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int] | None = None, n_items: int = 0, mean_words: float = 0.0, longest: int = 0):
        listed = words_of([t for _, t in items])
        items = [x for x, ws in zip(items, listed, strict=True) if ws]
        listed = [ws for ws in listed if ws]
        self.ids = [i for i, _ in items]
        halves = [question_and_answer(t) for _, t in items]
        questions, answers = words_of([q for q, _ in halves]), words_of([a for _, a in halves])
        self.parts = [(shingles(q), shingles(a)) for q, a in zip(questions, answers, strict=True)]
        sizes = np.array([len(ws) for ws in listed], np.int64)
        self.window = max(longest, int(sizes.max(initial=1)), SHINGLE) + 1  # the empty word at an end
        vocabulary, code = np.unique(np.array([w for ws in listed for w in ws], object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
        self.lookup = pa.array(vocabulary.tolist(), pa.large_string())
        pair, tf = np.unique(code.reshape(-1).astype(np.int64) * max(1, len(items)) + np.repeat(np.arange(len(items)), sizes), return_counts=True)
        term, self.item = pair // max(1, len(items)), pair % max(1, len(items))  # by term, then item
        n = n_items or len(items)
        mean = mean_words or (float(sizes.mean()) if items else 1.0)
        count = np.bincount(term, minlength=len(vocabulary)) if df is None else np.array([df[w] for w in vocabulary.tolist()], np.float64)
        idf = np.log(1 + (n - count + 0.5) / (count + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.item] / mean))
        own = np.bincount(self.item, weights=impact, minlength=len(items))
        self.impact = impact / own[self.item]
        self.pointer = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        # Block maxima, one entry for each block that a term's list meets.
        self.n_blocks = max(1, -(-len(items) // BLOCK_ITEMS))
        key = term * self.n_blocks + self.item // BLOCK_ITEMS
        first = np.nonzero(np.diff(key, prepend=-1))[0]
        self.block = key[first] % self.n_blocks
        self.block_max = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.block_pointer = np.searchsorted(term[first], np.arange(len(vocabulary) + 1))
        self.term_max = np.array([self.block_max[a:b].max() for a, b in zip(self.block_pointer[:-1], self.block_pointer[1:], strict=True)])
        self.scored = 0  # postings read by ``retrieve``

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[int]:
        """Items whose score over the given distinct terms is at least the threshold, by block-max WAND."""
        lists = []  # [next item, place of it, items, impacts, largest impact, its block maxima]
        for t in terms.tolist():
            a, b = self.pointer[t], self.pointer[t + 1]
            c, d = self.block_pointer[t], self.block_pointer[t + 1]
            maxima = dict(zip(self.block[c:d].tolist(), self.block_max[c:d].tolist(), strict=True))
            items = self.item[a:b].tolist()
            lists.append([items[0], 0, items, self.impact[a:b].tolist(), float(self.term_max[t]), maxima])
        found, end = [], len(self.ids)

        def move(entry: list, item: int) -> None:
            """To the first posting at or after ``item``, passing over those between."""
            entry[1] = bisect_left(entry[2], item, entry[1])
            entry[0] = entry[2][entry[1]] if entry[1] < len(entry[2]) else end

        while True:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, -1
            for p, entry in enumerate(lists):
                if entry[0] == end:
                    break
                bound += entry[4]
                if bound >= threshold:
                    pivot = p
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(entry[5].get(block, 0.0) for entry in lists[: pivot + 1]) < threshold:
                after = min((block + 1) * BLOCK_ITEMS, lists[pivot + 1][0] if pivot + 1 < len(lists) else end)
                for entry in lists[: pivot + 1]:
                    move(entry, after)
                continue
            for entry in lists[: pivot + 1]:
                move(entry, item)
            at = [entry for entry in lists[: pivot + 1] if entry[0] == item]
            self.scored += len(at)
            if sum(entry[3][entry[1]] for entry in at) >= threshold:
                found.append(item)
            for entry in at:
                move(entry, item + 1)

    def _reach(self, term: np.ndarray, first: np.ndarray, threshold: float) -> np.ndarray:
        """Which passages, whose terms start at ``first``, have a block whose maxima add up to the threshold."""
        out = np.zeros(len(first), bool)
        step, ends = max(1, _CELLS // self.n_blocks), np.append(first[1:], len(term))
        for a in range(0, len(first), step):
            b = min(len(first), a + step)
            mine = term[first[a] : ends[b - 1]]
            n = self.block_pointer[mine + 1] - self.block_pointer[mine]
            stop = np.cumsum(n)
            at = np.arange(stop[-1]) + np.repeat(self.block_pointer[mine] - stop + n, n)
            passage = np.repeat(np.repeat(np.arange(b - a), ends[a:b] - first[a:b]), n)
            sums = np.bincount(passage * self.n_blocks + self.block[at], weights=self.block_max[at], minlength=(b - a) * self.n_blocks)
            out[a:b] = sums.reshape(b - a, self.n_blocks).max(1) >= threshold
        return out

    def search(self, texts: list[str | None], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[dict[int, float]]:
        """For each whole text, {item place: smaller share of its two parts' shingles} of verified items."""
        found: list[dict[int, float]] = [{} for _ in texts]
        if not self.ids:
            return found
        lists = split_words(texts)
        offsets = np.asarray(lists.offsets)
        term = pc.index_in(lists.values, self.lookup).to_numpy(zero_copy_only=False)
        hit = np.nonzero(term == term)[0] if term.dtype.kind == "f" else np.arange(len(term))
        if not len(hit):
            return found
        term = term[hit].astype(np.int64)
        # Half-windows are numbered through all texts; passage k is half-windows k and k + 1 of the same text.
        doc = np.searchsorted(offsets, hit, side="right") - 1
        halves = -(-np.diff(offsets) // self.window) + 1
        before = np.cumsum(halves) - halves
        size = len(self.lookup)
        half = before[doc] + (hit - offsets[doc]) // self.window
        bound = np.bincount(half, weights=self.term_max[term], minlength=int(halves.sum()) + 1)
        slack = threshold - 1e-9
        likely = bound[:-1] + bound[1:] >= slack  # the bound over all blocks, repeated words and all
        late, early = likely[half], np.maximum(half - 1, 0)
        key = np.concatenate((half[late] * size + term[late], early[likely[early]] * size + term[likely[early]]))
        key.sort()
        key = key[np.diff(key, prepend=-1) > 0]
        passages, terms = key // size, key % size
        first = np.nonzero(np.diff(passages, prepend=-1))[0]
        if not len(first):
            return found
        ends = np.append(first[1:], len(key))
        for p in np.nonzero(self._reach(terms, first, slack))[0].tolist():
            k = int(passages[first[p]])
            items = self.retrieve(terms[first[p] : ends[p]], slack)
            if not items:
                continue
            d = int(np.searchsorted(before, k, side="right")) - 1
            left = int(offsets[d]) + (k - int(before[d])) * self.window
            right = min(left + 2 * self.window, int(offsets[d + 1]))
            ws = [w for w in lists.values[left:right].to_pylist() if w]
            there = shingles(ws)
            for i in items:
                share = min(_share(p, there, ws) for p in self.parts[i])
                if share >= overlap:
                    found[d][i] = max(found[d].get(i, 0.0), share)
        return found


def _share(part: set, there: set, ws: list[str]) -> float:
    one = next(iter(part))
    n = len(one)
    if n < SHINGLE:
        return float(any(tuple(ws[i : i + n]) == one for i in range(len(ws) - n + 1)))
    return len(part & there) / len(part)


def _distinct_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return items.where(text.isNotNull()).select(F.col(id_col).alias("id"), text.alias("t")).distinct()


def _worded(items: DataFrame) -> DataFrame:
    """(part, n, w): the part, number of words and distinct words of each item with words."""

    def run(batches):
        for batch in batches:
            listed = words_of(batch.column(1).to_pylist())
            keep = [i for i, ws in enumerate(listed) if ws]
            columns = [pa.array([len(listed[i]) for i in keep], pa.int64()), pa.array([sorted(set(listed[i])) for i in keep], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *columns], ["part", "n", "w"])

    return items.select("part", "t").mapInArrow(run, "part bigint, n bigint, w array<string>")


def _collected(items: DataFrame) -> list[tuple]:
    return sorted(((r.id, r.t) for r in items.select("id", "t").collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Index parts of bounded size, one at a time, with statistics of all items."""
    slim = _distinct_items(items, id_col, text_col)
    total = slim.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first().b
    parts = 2 * -(-int(total) // INDEX_BYTES)
    if parts <= 2:
        yield Index(_collected(slim))  # at most INDEX_BYTES
        return
    dealt = materialize(slim.withColumn("part", F.pmod(F.xxhash64("id", "t"), F.lit(parts))))
    worded = materialize(_worded(dealt))
    stats = worded.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("m"), F.max("n").alias("x")).first()
    each = worded.select("part", F.explode("w").alias("w"))
    df = materialize(each.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    for p in range(parts):
        own = df.join(each.where(F.col("part") == p).select("w").distinct(), "w")
        known = {r.w: r.n for r in own.collect()}  # words of a part
        yield Index(_collected(dealt.where(F.col("part") == p)), known, stats.n, stats.m, stats.x)
    release(dealt, worded, df)


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """Rows (id, row, item_ids, overlap): one per input row; item_ids ascending, empty if clean."""
    return _with_matches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), items, "t", item_col, threshold, overlap).drop("t")


def _runs(texts: pa.Array):
    """Lists of texts, in order, of at most ``SEARCHED`` characters or one text; few of a batch are copied at once."""
    for at in range(0, len(texts), 512):
        for _, run in batches_of(texts.slice(at, 512).to_pylist(), SEARCHED):
            yield run


def _found(docs: DataFrame, index: Index, text_col: str, item_kind: str, threshold: float, overlap: float, only_hits: bool) -> DataFrame:
    """``docs`` without the text column but with ``item_ids`` and ``overlap``; ``only_hits``: without rows that match nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches):
        index = shared.value
        for batch in batches:
            found = []
            for texts in _runs(batch.column(at)):
                found += index.search(texts, threshold, overlap)
            ids = [sorted({index.ids[i] for i in f}, key=lambda x: (x is None, x)) for f in found]
            best = [max([0.0, *f.values()]) for f in found]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(ids, kind), pa.array(best, pa.float64())], [*rest, "item_ids", "overlap"])
            yield out.filter(pa.array([bool(f) for f in found], pa.bool_())) if only_hits else out

    schema = docs.select(*rest, F.array().cast(f"array<{item_kind}>").alias("item_ids"), F.lit(0.0).alias("overlap")).schema
    kind = to_arrow_type(schema["item_ids"].dataType)
    return docs.mapInArrow(run, schema)


def _with_matches(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, threshold: float, overlap: float) -> DataFrame:
    """``docs`` (columns without the names used here) with ``item_ids`` and ``overlap``."""
    kind = items.schema[item_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    made = indexes(items, item_col)
    index, more = next(made), next(made, None)
    if more is None:
        out = _found(docs.withColumn("text_", text), index, "text_", kind, threshold, overlap, False)
        return out.select(*docs.columns, "item_ids", "overlap")
    rows = materialize(docs.withColumn("row_", F.monotonically_increasing_id()))
    slim, hits = rows.select("row_", text.alias("text_")), None
    while index is not None:
        found = materialize(_found(slim, index, "text_", kind, threshold, overlap, True))
        hits = found if hits is None else hits.unionByName(found)
        index, more = more, next(made, None)
    by_row = hits.groupBy("row_").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max("overlap").alias("overlap"))
    out = rows.join(by_row, "row_", "left")
    none = F.array().cast(f"array<{kind}>")
    return out.select(*docs.columns, F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows that hold a test item, columns unchanged."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = _with_matches(plain, items, f"c{names.index(text_col)}", item_col, THRESHOLD, OVERLAP)
    return found.where(F.size("item_ids") == 0).drop("item_ids", "overlap").toDF(*names)
