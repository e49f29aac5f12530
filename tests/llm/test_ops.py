"""The training-data operators against brute force, round trips and held-out accuracy."""

import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from weft.llm import decontam, htmlmain, kdtree, langid, license, linededup, packing, queries, sharding, simhash, tokenize, tokenstore

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, t string, length int, line string"


def docs_of(spark, texts, ids=None):
    """Documents with clashing extra columns."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", 3, "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)


HARD = [None, "", "   ", "\n\n", "one", "two words", "a b c", "A B C", "x\ny\nx", "é" * 5000, "w " * 30000, "same text here", "same text here", "12345 !!", "\x01 \x00 odd"]


@pytest.fixture(scope="module")
def hard(spark):
    return docs_of(spark, HARD, [None, *range(1, len(HARD))])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# 1 ---------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    out = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.avg(F.col("rejected").cast("int")).alias("j"), F.max("score").alias("m")).first()
    assert r.a > 0.98 and r.j < 0.01 and r.m <= 1


def test_language_hard_cases(spark, hard, empty):
    model = langid.fit(hard, "doc_id", "text", "lang", F.lit(True))
    got = langid.predict(hard, model).collect()
    assert len(got) == len(HARD)
    assert all((r.lang_pred == "und") == (r.score == 0) for r in got)
    assert {r.id for r in got if r.lang_pred == "und"} == {None, 1, 2, 3, 13}
    nothing = langid.fit(empty, "doc_id", "text", "lang", F.lit(True))
    assert langid.predict(empty, nothing).count() == 0
    assert {r.lang_pred for r in langid.predict(hard, nothing).collect()} == {"und"}
    assert langid.keep_known(hard, model).columns == hard.columns


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    rows = [(5, "one id in thousands of rows", "en")] * 3000 + [(i, f"text {i}", "de") for i in range(900)] + [(7, f"other text {i}", "fr") for i in range(500)]
    docs = spark.createDataFrame(rows, "id long, t string, l string").repartition(7)
    docs = docs.select("l", "t", F.xxhash64("id", "t").alias("h"))
    got = langid.sample(docs, 400).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r.l, set()).add((r.h, r.t))
    assert sorted((r.l, r.h, r.t) for r in got) == sorted((k, *x) for k, v in want.items() for x in sorted(v)[:400])
    texts = [f"wort haus garten {i % 9}" if i % 2 else f"word house garden {i % 9}" for i in range(60)]
    ids = [i // 6 for i in range(60)]  # repeated ids with different texts
    one = docs_of(spark, texts, ids).withColumn("lang", F.when(F.col("text").startswith("wort"), "de").otherwise("en"))
    a, b = (langid.fit(x, "doc_id", "text", "lang", F.lit(True)) for x in (one, one.orderBy(F.rand(3)).repartition(5)))
    assert (a.table == b.table).all() and a.threshold == b.threshold  # training is repeatable


def test_language_matches_a_plain_softmax(spark):
    """Predictions are those of the mean of n-gram logits, made by hand."""
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text", "lang", langid.training_fold())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_language_id(spark, SF).collect():
        text = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        n = langid.bucket_counts(text)
        z = (n @ model.table / n.sum() + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.labels[p.argmax()] and abs(r.score - p.max()) < 1e-9
        assert r.rejected == (p.max() < model.threshold or model.odd(n[model.rare].sum(), n.sum()))


def test_long_texts_are_counted_whole(monkeypatch):
    text = "".join(random.Random(3).choice("ab é.") for _ in range(5000))
    whole = langid.bucket_counts(text)
    monkeypatch.setattr(langid, "_PIECE", 97)
    assert (langid.bucket_counts(text) == whole).all()


# 2 ---------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<aside class="sidebar"><p>Side story, long enough to matter. Really.</p></aside><div class="cookie-notice">We use cookies, as all do.</div>
<div class="post"><h2>Title &amp; more</h2><p>First   para,\nwith <a href=y>a link</a> inside. And more text.<p>Second one, also here.</p>
<script>var a = "</p><p>no";</script><!-- <p>gone</p> --><form><p>Subscribe, now!</p></form><p>Short</p></div>
<div id="comments"><p>Reader: nice article, I liked it a lot, really.</p></div><footer>&copy; Site</footer></body></html>"""


def test_main_text():
    assert htmlmain.main_text(PAGE) == "Title & more\nFirst para, with a link inside. And more text.\nSecond one, also here.\nShort"


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<p", ""), ("plain text.", "plain text."), ("<div>" * 5000 + "deep", "deep"), ("x < y &amp; z", "x < y & z")])
def test_main_text_hard_cases(page, want):
    assert htmlmain.main_text(page) == want


def test_pages_of_the_given_table(spark):
    out = queries.op2_html_main_text(spark, SF)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    for r in out.join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")].replace("<br>", " ")
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# 3 ---------------------------------------------------------------------------


def test_leaks_are_found_and_clean_texts_left(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r.item_ids for r in queries.op3_decontaminate(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r.doc_id] == sorted(i for i, t in items if t in r.text)


def test_block_max_search_is_exact():
    """Every item at or over the threshold is retrieved, as scoring each passage against each item finds."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 20))) + ".") for i in range(90)]
    index = decontam.Index(items)
    text = " ".join(rng.choices(vocabulary, k=400)) + " " + items[7][1] + " " + items[40][1]
    words, want = decontam.words(text), set()
    for k in range(0, len(words), 1):
        there = decontam.shingles(words[k : k + 2 * index.window])
        for i in range(len(items)):
            if min(decontam._share(p, there, words[k : k + 2 * index.window]) for p in index.parts[i]) >= decontam.OVERLAP:
                want.add(i)
    assert set(index.search([text])[0]) == want >= {7, 40}


def test_retrieval_is_that_of_exhaustive_scoring():
    """Block-max WAND finds exactly the items whose BM25 reaches the threshold, and passes over postings."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(5, 25)))) for i in range(400)]
    index = decontam.Index(items)
    listed = [t.split() for _, t in items]
    df = {w: sum(w in ws for ws in listed) for w in vocabulary}
    mean = sum(map(len, listed)) / len(listed)

    def weight(w, ws):
        tf = ws.count(w)
        idf = np.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5))
        return idf * tf * (decontam.K1 + 1) / (tf + decontam.K1 * (1 - decontam.B + decontam.B * len(ws) / mean))

    lookup = {w: i for i, w in enumerate(index.lookup.to_pylist())}
    read = 0
    for threshold in (0.3, 0.6, 0.9):
        for _ in range(60):
            query = set(rng.choices(vocabulary, weights, k=40)) | set(rng.choice(listed))
            scores = [sum(weight(w, ws) for w in query if w in ws) / sum(weight(w, ws) for w in set(ws)) for ws in listed]
            terms = np.array(sorted(lookup[w] for w in query if w in lookup))
            want = [i for i, x in enumerate(scores) if x >= threshold - 1e-9]
            assert sorted(index.retrieve(terms, threshold - 1e-9)) == want
            read += int(np.diff(index.pointer)[terms].sum())
    assert index.scored < read / 2


def test_decontamination_searches_bounded_runs():
    texts = [None, "a" * 700_000, "b" * 700_000, "c" * 2_000_000, *["d" * 3_000] * 1_300, None]
    runs = list(decontam._runs(pa.array(texts)))
    assert [t for run in runs for t in run] == texts
    assert all(len(run) == 1 or sum(len(t or "") for t in run) <= 1_000_000 for run in runs)


def test_decontamination_hard_cases(spark, hard, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, None), (2, "..."), (3, "same text here"), (4, "same text here")], "item_id long, text string")
    assert all(r.item_ids == [] for r in decontam.matches(hard, none).collect())
    got = {r.id: r.item_ids for r in decontam.matches(hard, some).collect()}
    assert got[11] == [3, 4] and got[1] == []
    assert decontam.clean(hard, some).count() == len(HARD) - 2 and decontam.clean(hard, some).columns == hard.columns
    assert decontam.matches(empty, some).count() == 0
    long = docs_of(spark, ["filler " * 30_000 + "same text here " + "filler " * 30_000] * 2 + ["same text here"], [1, 1, 1])
    assert sorted(len(r.item_ids) for r in decontam.matches(long, some).collect()) == [2, 2, 2]


def test_index_in_parts_finds_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {r.id: r.item_ids for r in decontam.matches(docs, items).collect()}
    monkeypatch.setattr(decontam, "INDEX_BYTES", 8_000)
    assert len(list(decontam.indexes(items))) > 2
    assert {r.id: r.item_ids for r in decontam.matches(docs, items).collect()} == whole


# 4 ---------------------------------------------------------------------------


def test_license_scan_matches_brute_force(spark, hard, empty):
    mit = license.TEMPLATES["mit"]
    texts = [*HARD, f"start {mit} end", mit.replace("charge", "cost"), " ".join(mit.split()[:30]), "Released under the MIT License.", "x " * 3000 + mit + " y" * 3000]
    docs = docs_of(spark, texts)
    got = {(r.id, r.license): r.containment for r in license.scan(docs).collect()}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    assert got == {(i, n): c for i, n, c in con.execute(license.oracle_sql()).fetchall()}
    n = len(HARD)
    assert got[n, "mit"] == 1 and (n + 1, "mit") in got and (n + 2, "mit") not in got and got[n + 3, "mit-notice"] == 1 and got[n + 4, "mit"] == 1
    assert license.scan(hard).count() == 0 and license.scan(empty).count() == 0
    with pytest.raises(ValueError):
        license.scan(docs, templates={"short": "too few"})


# 5 ---------------------------------------------------------------------------


def brute_sim(norm):
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in norm.split(" ")]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    lines, places = {}, []
    for doc, text in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            norm = re.sub(r"[\W_]+", " ", line.lower()).strip()
            if norm:
                lines.setdefault(norm, len(lines))
                places.append((doc is None, doc or 0, pos, norm))
    norms, parent = list(lines), list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sims = np.array([brute_sim(n) for n in norms], np.uint64)
    for i in range(len(norms)):
        for j in np.nonzero(np.bitwise_count(sims[i + 1 :] ^ sims[i]) <= linededup.DISTANCE)[0] + i + 1:
            longest = max(len(norms[i]), len(norms[j]))
            if abs(len(norms[i]) - len(norms[j])) <= longest // 10 and edits(norms[i], norms[j]) <= int(longest * linededup.EDITS):
                parent[find(int(j))] = find(i)
    first = {}
    for p in sorted(places):
        first.setdefault(find(lines[p[3]]), p[:3])
    gone = {p[:3] for p in places if first[find(lines[p[3]])] != p[:3]}
    out = {}
    for doc, text in rows:
        if text is not None:
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if (doc is None, doc or 0, k) not in gone)
        out[doc] = text
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(25)]
    texts = []
    for _ in range(60):
        lines = []
        for line in rng.choices(base, k=5):
            w = line.split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append(" ".join(w) + rng.choice(["", ".", "!"]))
        texts.append("\n".join(lines))
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "...\n...\nOnly. once"), (None, "nulls come last\n" + base[0])]
    got = linededup.dedup_lines(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows)
    assert sum(r.n_dropped for r in got) > 100


def test_rows_repeated_many_times_are_one_document(spark):
    text = " ".join(f"v{i}" for i in range(900)) + "\nsecond line\nsecond line"
    got = linededup.dedup_lines(docs_of(spark, [text] * 60, [5] * 60)).collect()
    assert {(r.text, r.n_dropped) for r in got} == {(text.rsplit("\n", 1)[0], 1)} and len(got) == 60


def test_line_dedup_hard_cases(spark, hard, empty):
    out = linededup.dedup_lines(hard)
    assert out.columns == [*hard.columns, "n_lines", "n_dropped"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert got[None] == (None, 0, 0) and got[8] == ("x\ny", 3, 1) and got[12] == ("", 1, 1) and got[3] == ("\n\n", 3, 0)
    assert linededup.dedup_lines(empty).count() == 0


def test_lines_of_a_text_are_split_once(spark):
    ls, gone = F.split("t", "\n"), F.col("gone")
    one = spark.createDataFrame([("c\na\nb\na", [1, 3]), ("a", [0])], "t string, gone array<int>")
    assert [r[0] for r in one.select(linededup._without(ls, gone)).collect()] == ["c\nb", ""]
    assert str(linededup._without(ls, gone)).count("split(") == 2  # for the lines and for their number
    assert str(linededup._close(F.col("a"), F.col("b"))).count("split(") == 2


@pytest.mark.parametrize("n", [1, 2, 3, 127, 128, 300, 32_767, 40_000])
def test_simhash_of_lines_counts_any_number_of_words(spark, n):
    norm = " ".join(f"v{i % 997}" for i in range(n))
    docs = spark.createDataFrame([(1, 1, norm)], "id long, k long, t string")
    got = linededup.hashed_lines(docs).collect()
    assert [r.sim & (2**64 - 1) for r in got] == [brute_sim(norm)]


# 6 ---------------------------------------------------------------------------


def brute_top(rows, k):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 120)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(500)]
    rows += [(i, [1.0] * 8) for i in range(500, 700)] + [(900, None), (901, []), (902, [None] * 8), (903, [float("nan")] * 8), (950, [1e6] * 8), (1000, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, id int, v string, shard int, size int, tree string, floor int"
    df = kdtree.whole_numbers(spark.createDataFrame([(*r, 1, "x", 2, 3, "y", 4) for r in rows], schema))
    got = kdtree.top_k(df.where("id % 50 = 0"), df, 5)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute_top(rows, 5)
    nothing = df.where("id < 0")
    assert kdtree.top_k(nothing, nothing, 5).count() == 0
    assert kdtree.top_k(df.where("id = 0"), df.where("id in (0, 7)"), 5).count() == 1


def test_top_k_of_very_large_components(spark, monkeypatch):
    """Exact in rank beyond what doubles and longs hold; scores end at the longs' ends."""
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 30)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-1, 25)).tolist()) for i in range(150)]
    rows += [(i, (rng.normal(size=4) * 1e9).tolist()) for i in range(150, 250)]
    df = kdtree.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = kdtree.top_k(df.where("id % 50 = 0"), df, 5)

    def long(x):
        return min(max(x, -(2**63)), 2**63 - 1)

    def floor(x):
        return int(np.floor(256 * x))

    want = []
    for q, v in rows[::50]:
        best = sorted((-sum(floor(a) * floor(b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:5]
        want += [(q, r, i, long(-s)) for r, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == want


# 7 and tokenizing ------------------------------------------------------------


BLANKS = [c for c in map(chr, range(0x110000)) if c.isspace()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_ids_are_the_library_ids(name, monkeypatch):
    """Against the plain library call, over all white space, added tokens and marks."""
    monkeypatch.setattr(tokenize, "MEMORY", 40_000)
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    rng, alphabet = random.Random(1), ["a", "b", "'s", "A", "1", *" \t\n\n" * 2, "\u0301", *"é.,-_—日İß²ⅷΣς", "\x01", "\x02", "<|endoftext|>", "J\u030c"]
    texts = ["".join(rng.choice([*alphabet, rng.choice(BLANKS)]) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    texts += ["".join(rng.choice("ab. \n'sS") for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    texts += ["<|endoftext|> x", "<|ENDOFTEXT|>", "x<|startoftext|>y", "  a   b ", "a" * 500, " \xa0 \xa0 x", "", None]
    enc = tokenize.ChunkEncoder(public_tokenizers.path(name))
    assert enc.kind == name.split("_")[0]
    for i in range(0, len(texts), 500):
        for t, ids in zip(texts[i : i + 500], enc.encode(texts[i : i + 500]), strict=True):
            assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_a_file_of_another_kind_is_encoded_whole(tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    tok.save(str(tmp_path / "t.json"))
    enc = tokenize.ChunkEncoder(str(tmp_path / "t.json"))
    assert enc.kind is None and [x.tolist() for x in enc.encode(["a b", None, "c\n d"], 2)] == [[*tok.encode(t).ids, 2] for t in ("a b", "", "c\n d")]


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 2, 300, 50_000, 2**31, 2**63):
        v = rng.integers(0, top, 4000).astype("<u8")
        v[::7] |= np.uint64(15) << np.uint64(60) if top == 2**63 else np.uint64(0)
        words, before = tokenstore.encode(v)
        assert (tokenstore.decode(words) == v).all()
        for b in range(len(before)):
            at, part = tokenstore.decode_block(words, before, b)
            assert at == before[b] and (part == v[at : at + len(part)]).all()
    assert len(tokenstore.decode(tokenstore.encode(np.zeros(0))[0])) == 0


def test_token_files(spark, hard, empty, monkeypatch):
    monkeypatch.setattr(tokenstore, "ROW_IDS", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = tokenstore.round_trip(hard, path, 2).orderBy("start").collect()
    assert [r.id for r in got] == [None, *range(1, len(HARD))]
    at = 0
    for r in got:
        ids = [*tok.encode(HARD[r.id or 0] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert tokenstore.round_trip(empty, path, 2).count() == 0
    same = tokenstore.round_trip(docs_of(spark, ["a b", "c"] * 200, [None, 5] * 200).repartition(6), path, 2).orderBy("start").collect()
    assert [r.id for r in same] == [None] * 200 + [5] * 200
    assert [r.start for r in same] == np.cumsum([0, *[r.n_tokens for r in same]])[:-1].tolist()


# 8 ---------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(2)
    texts = [*HARD[1:]]
    for _ in range(30):
        base = [f"t{rng.randrange(500)}" for _ in range(150)]
        for _ in range(4):
            base = [*base]
            base[rng.randrange(150)] = "changed"
            texts.append(" ".join(base))
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in np.nonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)[0]:
            a, b = sorted((find(int(j)), find(i)))
            parent[b] = a
    got = {r.id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: (int(fps[i]), find(i)) for i in range(len(texts))}
    assert len({c for _, c in got.values()}) < len(texts) - 30


def test_anchors_meet_every_pair_within_three_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64)
    y = x.copy().view(np.uint64)
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    (kv, rv), (kh, rh) = simhash.anchors(x, False), simhash.anchors(y.view(np.int64), True)
    visits, homes = set(zip(kv.tolist(), rv.tolist(), strict=True)), list(zip(kh.tolist(), rh.tolist(), strict=True))
    assert {i for k, i in homes if (k, i) in visits} == set(range(500)) and len(visits) <= 34 * 500


def test_near_duplicates_hard_cases(spark, hard, empty):
    got = simhash.near_duplicates(hard).collect()
    assert len(got) == len(HARD) and {r.component_id for r in got if r.fp == 0} == {1}
    assert simhash.near_duplicates(empty).count() == 0


# 9 ---------------------------------------------------------------------------


def test_best_fit_decreasing_is_the_plain_one():
    rng = np.random.default_rng(1)
    for t in range(60):
        cap = int(rng.choice([8, 100, 1024]))
        lengths = rng.integers(1, cap + 1, rng.integers(1, 800))
        if t % 3 == 0:
            lengths = np.minimum(lengths, rng.integers(1, 20, len(lengths)))
        values, counts = np.unique(lengths, return_counts=True)
        plan = packing.best_fit_decreasing(dict(zip(values.tolist(), counts.tolist(), strict=True)), cap)
        free = []
        for n in sorted(lengths.tolist(), reverse=True):
            at = min((i for i, f in enumerate(free) if f >= n), key=lambda i: free[i], default=None)
            if at is None:
                free.append(cap - n)
            else:
                free[at] -= n
        assert plan.bins == len(free)


def check_packing(rows, cap):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    return used


def test_packing(spark, hard, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = packing.pieces(hard, path, 2, 1024)
    rows = packing.pack(parts, 1024).collect()
    used = check_packing(rows, 1024)
    tok = Tokenizer.from_file(path)
    for i, text in enumerate(HARD):
        mine = sorted((r for r in rows if r.id == (i or None)), key=lambda r: r.piece)
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(bytes(r.ids) for r in mine) == ids.tobytes()
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine]])[:-1].tolist()
        assert all(r.crc == zlib.crc32(r.ids) for r in mine) and all(r.length == 1024 for r in mine[1:])
    assert len(used) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack(packing.pieces(empty, path, 2, 1024), 1024).count() == 0


# 10 --------------------------------------------------------------------------


def check_shards(rows, texts, n, tolerance):
    sizes, slots, total = [0] * n, [[] for _ in range(n)], 0
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        total += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    largest = max(len((t or "").encode()) + 8 for t in texts)
    assert max(abs(s - total / n) for s in sizes) <= tolerance * total / n + largest
    return sizes


def test_shards_are_even_and_groups_whole(spark):
    rng = random.Random(6)
    texts = [rng.choice("abcdef") * rng.randint(0, 40) for _ in range(3000)] + ["a third of all rows"] * 1500 + [None]
    rows = sharding.assign(docs_of(spark, texts), 24).collect()
    assert len(rows) == len(texts)
    check_shards(rows, texts, 24, 0.01)
    for r in rows:
        raw = (texts[r.id] or "").encode()
        assert r.size == len(raw) + 8 and r.crc == zlib.crc32(raw)
    few = [f"text {i} " * 5 for i in range(4000) for _ in range(2)]
    rows = sharding.assign(docs_of(spark, few), 8).collect()
    check_shards(rows, few, 8, 0.01)
    where = {}
    for r in rows:
        where.setdefault(few[r.id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_shards_hard_cases(spark, hard, empty):
    assert sorted(r.slot for r in sharding.assign(hard, 1).collect()) == list(range(len(HARD)))
    assert sharding.assign(hard, 24).count() == len(HARD) and sharding.assign(empty, 24).count() == 0
    assert sharding.split(hard, 4, shard_col="to").columns == [*hard.columns, "to"]
