"""WARC bundles: footers, exact round trips, revisits, hard cases."""

import hashlib
import uuid

import pytest
import zstandard
from pyspark.sql import functions as F

from weft.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, role int, page long, payload string, m long, path string"


def pages_of(spark, rows):
    """Pages with extra columns whose names are used inside."""
    return spark.createDataFrame([(i, u, h, "d", 9, 8, "p", 7, "q") for i, u, h in rows], SCHEMA)


def brute(rows):
    """{(page_id, digest): how often each (type, refers_to)}."""
    out = []
    key = lambda i: (i is None, i or 0)
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    for text, ids in by.items():
        raw = text.encode()
        ids = sorted(ids, key=key)
        for k, i in enumerate(ids):
            first = k == 0 or len(raw) < 100
            out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first else "revisit", None if first else ids[0]))
    return sorted(out, key=str)


LONG = "<p>" + "é" * 60 + "</p>"
HARD = [
    (5, "http://a/ b\r\nX: y", LONG), (3, None, LONG), (9, "u", LONG), (9, "u", LONG), (3, "v", LONG), (None, "n", LONG), (None, None, None),
    (1, "", ""), (2, "http://é/", "short"), (4, "w", "short"), (7, "big", "z" * 3_000_000), (8, "big", "z" * 3_000_000), (None, "x", "y" * 200),
    (None, "x", "y" * 200), (10, "crlf", "a\r\n\r\nWARC/1.1\r\n" * 20), (-1, "neg", "q" * 100), (0, "zero", "q" * 100), (11, "just under", "r" * 99), (12, "just under", "r" * 99),
]


def test_rows_against_brute_force(spark):
    got = warc.round_trip(pages_of(spark, HARD).repartition(5))
    rows = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == brute(HARD)


def test_same_result_when_digests_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    got = warc.round_trip(pages_of(spark, HARD * 2)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute(HARD * 2)


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(pages_of(spark, [])).count() == 0


def test_files_index_and_single_records(spark, tmp_path):
    rows = [(i, f"http://h/{i}", hashlib.sha256(str(i // 3 * 3 if i % 7 == 0 else i).encode()).hexdigest() * (1 + i % 40)) for i in range(300)]
    path = str(tmp_path / "archive")
    warc.write(pages_of(spark, rows).repartition(3), path, frame_bytes=1000, bundle_bytes=4000)
    files = list((tmp_path / "archive" / "bundles").glob("part-*"))
    assert len(files) > 3
    plain = []
    for f in files:
        data = f.read_bytes()
        bundle = warc.Bundle(data)  # by the footer alone
        assert data[-4:] == warc.SEEK_MAGIC and len(bundle.starts) > 1
        assert len(data) < 3 * 4000 + 36 * len(bundle.places) + 100
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        records = list(bundle.records())
        assert b"".join(r for _, r in records) == whole  # any reader of the format sees the records
        plain += records
    headers = [warc.parse(r)[0] for _, r in plain]
    assert {h["page-id"] for h in headers} == {str(i) for i, _, _ in rows}
    ids = [h["warc-record-id"] for h in headers]
    assert len(set(ids)) == len(rows) and {f"<urn:uuid:{uuid.UUID(bytes=i)}>" for i, _ in plain} == set(ids)
    assert {h["warc-refers-to"] for h in headers if h["warc-type"] == "revisit"} <= set(ids)
    texts = {i: h for i, _, h in rows}
    back = warc.read(spark, path).where("record_type = 'response'").collect()
    assert all(bytes(r.payload).decode() == texts[r.page_id] and r.url == f"http://h/{r.page_id}" for r in back)
    index = spark.read.parquet(f"{path}/index")
    some = index.orderBy(F.xxhash64("record_id")).limit(9)
    for most in (1000, 1):
        got = warc.fetch(spark, path, some.union(some), most).collect()
        assert sorted(r.record_id for r in got) == sorted(r.record_id for r in some.collect())
        assert all(bytes(r.payload).decode() == texts[r.page_id] for r in got if r.record_type == "response")


def test_damage_is_found():
    w = warc.BundleWriter()
    w.add(b"a" * 16, warc.record(b"a" * 16, "response", 1, "u", hashlib.sha256(b"x").hexdigest(), None, b"y"))
    with pytest.raises(ValueError):
        warc._row(next(warc.Bundle(w.close()).records())[1], True)
    with pytest.raises(ValueError):
        warc.Bundle(b"no footer here")
