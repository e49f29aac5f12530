"""The registered queries' contract columns, over a whole given table, against brute force or SQL."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_ops import SF, brute_fingerprint, brute_lines, check_packing
from tokenizers import Tokenizer

from weft.llm import queries


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.queries()[name](spark, SF).select(names).collect())) == sorted(want.fetchall())


def test_op5(spark, texts):
    got = queries.op5_line_dedup(spark, SF).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(sorted(texts.items()))
    assert all(r.n_lines == len((texts[r.doc_id] or "").split("\n")) for r in got)


def test_op7(spark, texts):
    tok, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in queries.op7_token_ids(spark, SF).collect()}
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op8(spark, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_near_duplicates(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_op9(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op9_best_fit_packing(spark, SF).collect()
    used = check_packing(rows, 1024)
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine]])[:-1].tolist() and sum(r.length for r in mine) == len(ids)
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine]
        assert len(mine) == -(-len(ids) // 1024)
    assert len(used) <= -(-sum(r.length for r in rows) // 1024) + 1


def test_op10(spark, texts):
    rows = queries.op10_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {s: sum(r.size for r in rows if r.shard == s) for s in range(24)}
    assert max(abs(v - sum(sizes.values()) / 24) for v in sizes.values()) <= 0.01 * sum(sizes.values()) / 24 + max(r.size for r in rows)
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 1
