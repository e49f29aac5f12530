"""Language identification: averaged hashed subword embeddings and a linear softmax.

Each character n-gram (1 to 4, within words and with word ends) of the lower-cased text
hashes to a bucket with a learned vector; a text is the mean of its n-grams' vectors,
and a linear softmax over it gives the language. Vectors and weights are trained by
stochastic gradient descent in numpy on a sample of at most ``PER_LANGUAGE`` different
labelled rows a language, those with the smallest hashes of id and text. The bound holds for
any number of rows, repeated ones too: different hashes are counted about, and only those below
a share of their range that holds a few times the bound are ranked. The sample's bucket counts are made on the executors and are bounded by the number
of buckets whatever the length of a text.

Every fifth row of a language is kept out of training and calibrates, whole and thinned to as few n-grams
as short texts have: one temperature for the softmax, the score below which at most ``REJECT`` of the
rightly labelled ones fall, and the share of n-grams that training met fewer than ``RARE`` times. A text
is rejected below that score, or if it holds more rare n-grams than that share and chance explain: texts
of other languages or of random letters do, while a word or two is too little to tell. (Languages of fewer than five rows
calibrate nothing; without any such row the temperature is 1 and only texts without a letter are
rejected.) Since the mean and the softmax's linear part commute, prediction needs only one number per
bucket and language.

Defined results: NULL text or text without a letter is ``und`` with score 0 and is
rejected; with no labelled row at all every text is ``und``; ties between languages go
to the first in order of name; NULL ids are allowed and never used for training;
repeated rows are predicted alike and learned from once; ids, labels and texts alone decide
what is learned, in whatever order rows lie; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 14
DIM = 16
PER_LANGUAGE = 400
EPOCHS = 8
REJECT = 0.001
THIN = (8, 16, 32, 64, 128)  # n-grams of a text that is thinned in training
RARE = 4  # occurrences in training below which an n-gram is rare
LEAST_SHARE = 0.02  # of rare n-grams, that any text may have
DEVIATIONS = 5  # of a count of rare n-grams from its mean, that chance explains
LETTER = r"\p{L}"
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18  # characters hashed at once
KEPT = 512  # rows whose texts are copied at once


def _buckets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, start) of every n-gram of code points in which only the ends may be blank."""
    blank = codes == 32
    value, inner = codes.astype(np.uint64), np.zeros(len(codes), bool)
    buckets, starts = [], []
    state = value * _MULTIPLY
    for n in range(1, 5):
        if n > 1:
            if len(codes) < n:
                break
            state = ((state[:-1] ^ (state[:-1] >> np.uint64(29))) + value[n - 1 :]) * _MULTIPLY
            inner = inner[:-1] | blank[n - 2 : len(codes) - 1] if n > 2 else np.zeros(len(codes) - 1, bool)
        end = codes[n - 1 :]
        good = ~inner & ~((blank[: len(end)]) & (end == 32)) if n > 1 else ~blank
        at = np.nonzero(good)[0]
        buckets.append((state[at] >> np.uint64(50)).astype(np.int64) & (BUCKETS - 1))
        starts.append(at)
    return np.concatenate(buckets), np.concatenate(starts)


_SPACES = {i: " " for i in range(0x80) if not chr(i).isalpha()}


def _pieces(text: str):
    """Code points of a whole text, lower-cased, ASCII non-letters as blanks, in overlapping pieces."""
    codes = np.frombuffer(f" {text.lower().translate(_SPACES)} ".encode("utf-32-le", "replace"), "<u4")
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    for a in range(0, len(codes), _PIECE):
        yield codes[max(0, a - 3) : a + _PIECE], min(a, 3)


def bucket_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the n-grams of a whole text."""
    out = np.zeros(BUCKETS, np.int64)
    for codes, seen in _pieces(text):
        bucket, start = _buckets(codes)
        if seen:  # n-grams wholly inside the overlap were counted before
            bucket = bucket[start + _lengths(codes, start) > seen]
        out += np.bincount(bucket, minlength=BUCKETS)
    return out


def _lengths(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length of each n-gram given in order of length: starts begin anew for each."""
    return 1 + np.concatenate(([0], np.cumsum(np.diff(starts) <= 0)))


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    table: np.ndarray  # logits per bucket and label, before averaging
    bias: np.ndarray
    temperature: float
    threshold: float
    rare: np.ndarray  # buckets of rare n-grams
    share: float  # of rare n-grams in texts of the languages

    def odd(self, rare: int, n: int) -> bool:
        """Whether so many rare n-grams of ``n`` are more than chance explains."""
        return rare > n * self.share + DEVIATIONS * (n * self.share) ** 0.5 + 1


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Fit on (label, bucket ids, counts) rows by SGD; every fifth row of a label calibrates."""
    labels = tuple(sorted({r[0] for r in rows}))
    if not labels:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0, np.zeros(BUCKETS, bool), 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([labels.index(r[0]) for r in rows])
    nth = np.zeros(len(rows), np.int64)  # place among the rows of its label, which lie in order of their hashes
    for c in range(len(labels)):
        nth[y == c] = np.arange((y == c).sum())
    held, fit = np.nonzero(nth % 5 == 4)[0], np.nonzero(nth % 5 != 4)[0]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, len(labels))), np.zeros(len(labels))
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit).tolist():
            _, ids, n = rows[i]
            if not len(ids):
                continue
            w = n / n.sum()
            if rng.random() < 0.7:  # thinned to a few n-grams, as a short text has
                w = rng.multinomial(int(rng.choice(THIN)), w)
                ids, w = ids[w > 0], w[w > 0] / w.sum()
            mean = w @ emb[ids]
            z = mean @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = out @ g
            back /= max(1.0, np.sqrt(back @ back))  # no step of the vectors is long enough to run away
            out -= rate * np.outer(mean, g)
            bias -= 0.01 * rate * g
            emb[ids] -= rate * 10 * w[:, None] * back
    table = emb @ out
    met = np.zeros(BUCKETS, np.int64)
    for i in fit.tolist():
        met[rows[i][1]] += rows[i][2]
    rare = met < RARE
    if not len(held):
        return Model(labels, table, bias, 1.0, 0.0, rare, 1.0)
    some = [(y[i], rows[i][1], rows[i][2]) for i in held.tolist() if len(rows[i][1])]
    some += [(c, ids, rng.multinomial(t, n / n.sum())) for c, ids, n in some for t in THIN]
    z = np.array([n @ table[ids] / max(1, n.sum()) + bias for _, ids, n in some]).reshape(-1, len(labels))
    truth = np.array([c for c, _, _ in some], np.int64)
    temperatures = np.geomspace(0.02, 50, 120)
    p = [_softmax(z / t) for t in temperatures]
    loss = [-np.log(q[np.arange(len(truth)), truth] + 1e-12).mean() for q in p]
    best = int(np.argmin(loss))
    score, right = p[best].max(1), p[best].argmax(1) == truth
    threshold = float(np.quantile(score[right], REJECT)) if right.any() else 0.0
    shares = [n[rare[ids]].sum() / n.sum() for _, ids, n in some[: len(held)]]
    share = max(LEAST_SHARE, float(np.quantile(shares, 1 - REJECT))) if shares else 1.0
    return Model(labels, table, bias, float(temperatures[best]), threshold, rare, share)


def sample(rows: DataFrame, per_label: int) -> DataFrame:
    """Of rows (l, t, h), at most ``per_label`` different (l, h), the smallest h of each l, once each.

    Only hashes below a share of their range are ranked, four times what is expected to be needed;
    where that holds too few, the share grows.
    """
    spark = rows.sparkSession
    share = {r.l: 4 * per_label / max(1, r.n) for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row a label
    while True:
        shares = spark.createDataFrame(list(share.items()), "label string, share double")
        low = rows.join(F.broadcast(shares), F.col("l") == F.col("label")).where(F.col("h") / 2.0**64 + 0.5 < F.col("share"))
        ranked = low.select("l", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("n") <= per_label)
        found = {r.l: (r.last, r.n) for r in ranked.groupBy("l").agg(F.max("h").alias("last"), F.count(F.lit(1)).alias("n")).collect()}
        short = [x for x in share if share[x] < 1 and found.get(x, (0, 0))[1] < per_label]
        if not short:
            break
        share |= {x: 4 * share[x] for x in short}
    last = spark.createDataFrame([(x, h) for x, (h, _) in found.items()], "label string, last bigint")
    chosen = rows.join(F.broadcast(last), (F.col("l") == F.col("label")) & (F.col("h") <= F.col("last")))
    return chosen.select("l", "t", "h").dropDuplicates(["l", "h"])


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, where: Column) -> Model:
    """Learn from labelled rows that satisfy ``where``: a bounded sample of each label."""
    usable = docs.where(where & F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    text = F.col(text_col).cast("string")
    rows = usable.select(F.col(label_col).cast("string").alias("l"), text.alias("t"), F.xxhash64(F.col(id_col), text).alias("h"))

    def run(batches):
        for batch in batches:
            ids, counts = [], []
            for t in batch.column(1):
                c = bucket_counts(t.as_py())
                at = np.nonzero(c)[0]
                ids.append(at.astype(np.int32))
                counts.append(c[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                ["l", "h", "ids", "counts"],
            )

    made = sample(rows, PER_LANGUAGE).mapInArrow(run, "l string, h bigint, ids array<int>, counts array<int>")
    got = made.toArrow().combine_chunks()  # numpy views of it below: no Python number per entry
    order = sorted(range(got.num_rows), key=lambda i: (got["l"][i].as_py(), got["h"][i].as_py()))
    ids, counts = ([x.values.to_numpy() for x in got[c]] for c in ("ids", "counts"))
    return train([(got["l"][i].as_py(), ids[i], counts[i]) for i in order])


def _predictor(model: Model):
    """(text, whether it has a letter) -> (label, score, whether it is rejected)."""
    labels, table = model.labels, model.table.astype(np.float64)
    columns = [np.ascontiguousarray(table[:, i]) for i in range(len(labels))]

    def one(text: str | None, letters: bool) -> tuple[str, float, bool]:
        if not letters or not labels:
            return "und", 0.0, True
        z, n, rare = np.zeros(len(labels)), 0, 0
        for codes, seen in _pieces(text):
            bucket, start = _buckets(codes)
            if seen:
                bucket = bucket[start + _lengths(codes, start) > seen]
            z += [c[bucket].sum() for c in columns]
            n += len(bucket)
            rare += int(np.count_nonzero(model.rare[bucket]))
        z = (z / max(1, n) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        score = min(1.0, float(p[best] / p.sum()))
        return labels[best], score, score < model.threshold or model.odd(rare, n)

    return one


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(LETTER), F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, rejected), one per input row; only the text is used."""
    one = _predictor(model)

    def run(batches):
        for batch in batches:
            got = [one(t.as_py(), known.as_py()) for t, known in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                ["id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), text.alias("t"), _has_letter(text).alias("letters"))
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected, columns unchanged."""
    one, names = _predictor(model), docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), KEPT):
                part = batch.slice(start, KEPT)
                keep = pa.array([not one(t.as_py(), known.as_py())[2] for t, known in zip(part.column(at), part.column(part.num_columns - 1), strict=True)], pa.bool_())
                yield part.filter(keep).select(range(part.num_columns - 1))

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    flagged = plain.withColumn("letters", _has_letter(F.col(f"c{at}").cast("string")))
    return flagged.mapInArrow(run, plain.schema).toDF(*names)


def training_fold(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text is not divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0
