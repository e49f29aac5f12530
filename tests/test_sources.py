import hashlib
import json

from pyspark.sql import functions as F

from weft.operators import records
from weft.sources import files
from weft.streaming import events


def test_query_seeds(spark, tmp_path):
    (tmp_path / "seeds.json").write_text(json.dumps({"query_seeds": ["a", "b"]}, indent=1))
    assert [tuple(r) for r in files.query_seeds(spark, str(tmp_path)).collect()] == [(0, "a"), (1, "b")]


def test_rows_from_arrays_and_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"meta": {}, "rows": [{"x": 3}]}')
    (tmp_path / "c.json").write_text('"nothing"')
    got = files.read_polymorphic(spark, str(tmp_path), "rows", "struct<x: int>")
    assert sorted(r.x for r in got.collect()) == [1, 2, 3]


def test_session_events_skip_broken_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"type": "user", "message": {"a": 1}}\n\nbroken\n{"other": 1}\n')
    assert [r.type for r in files.session_events(spark, str(tmp_path)).collect()] == ["user"]


def test_skill_files_are_numbered_by_path(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(name)
    assert [(r.skill_id, r.text) for r in files.skill_files(spark, str(tmp_path)).orderBy("skill_id").collect()] == [(1, "a"), (2, "b")]


def test_resume_does_failed_rows_again(spark, tmp_path):
    rows, store = spark.range(6).select(F.col("id")), str(tmp_path / "store")
    calls = []

    def work(todo):
        calls.append(sorted(r.id for r in todo.collect()))
        odd = F.when((F.col("id") % 2 == 1) & F.lit(len(calls) == 1), "failed")
        return todo.withColumn("error", odd)

    events.resume(rows, store, ["id"], work)
    done = events.resume(rows, store, ["id"], work)
    assert calls == [[0, 1, 2, 3, 4, 5], [1, 3, 5]]
    assert done.where("error IS NULL").count() == 6


def test_completion_and_canonical(spark):
    rows = spark.createDataFrame([(1, "X", 0), (1, "x", 1), (1, "yy", 2), (1, "yy", 3), (2, "b", 4), (2, "a", 5)], "k int, t string, n int")
    assert {r.k: r.canonical for r in records.canonical_mode(rows, "k", "t", "n").collect()} == {1: "X", 2: "a"}


def test_requirements_prefer_versions(spark):
    rows = spark.createDataFrame([(1, "Numpy"), (1, "numpy>=2"), (1, "-r x"), (1, "3"), (1, "pandas")], "k int, r string")
    got = {r.package: r.requirement for r in records.merge_requirements(rows, "k", "r").collect()}
    assert got == {"numpy": "numpy>=2", "pandas": "pandas"}


def test_entities_in_every_shape(spark):
    one = {"entity_name": "n", "url": "u"}
    payloads = [
        {"entities": [{"task_id": "a", **one}, 5, {"task_id": "", **one}, {"task_id": "b", "name": "m", "entity_url": "", "url": " v ", "keep": False}]}, {"evaluations": [{"task_id": "c", **one, "keep": None}]},
        {"tasks": [{"task_id": "d", "upstream_input_entities": [3, one, {"task_id": "own", "entity_record_id": "r", **one}]}, {"task_id": "no list"}, 4]}, {"task_id": "e", "upstream_input_entities": [one]}, {"task_id": "f", **one, "type": "t"},
        [{"task_id": "g", "upstream_input_entities": [one]}, {"task_id": "skipped", **one}], [{"task_id": "h", **one}, "x"], {"other": 1}, "text", None, {"task_id": "i", "url": ""},
    ]
    rows = spark.createDataFrame([(json.dumps(p) if p is not None else None,) for p in payloads] + [("{bad",)], "t string")
    got = sorted((r.task_id, r.entity_record_id[:12], r.entity_name, r.entity_type, r.url) for r in files.entities(rows, "t").collect())
    sha = hashlib.sha1(b"u").hexdigest()[:12]
    assert [g[0] for g in got] == ["a", "c", "d", "e", "f", "g", "h", "own"]
    by = {g[0]: g for g in got}
    assert by["a"][1] == f"a::{sha}"[:12] and by["d"][1] == "d::entity-002"[:12] and by["e"][1] == "e::entity-001"[:12] and by["own"][1] == "r" and by["f"][3] == "t"
    assert files.entities(rows, "t", require_keep=False).where("task_id = 'b'").first().asDict() == {"task_id": "b", "entity_record_id": "b::" + hashlib.sha1(b"v").hexdigest()[:12], "entity_name": "m", "entity_type": "", "url": "v", "keep": False}
