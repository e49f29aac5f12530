"""Resumed runs that break off, retry feedback in batch and stream, reviews and documented functions."""

import time

import pytest
from pyspark.sql import functions as F

from weft.functions import parsers, scanners
from weft.operators import tools
from weft.streaming import events


def test_a_broken_run_keeps_its_finished_batches(spark, tmp_path):
    rows, store = spark.range(90).select("id", (F.col("id") % 7).alias("x")), str(tmp_path / "store")
    done = []

    def breaks(todo):
        done.append(sorted(r.id for r in todo.collect()))
        if len(done) == 3:
            raise RuntimeError("executor lost")
        return todo.withColumn("error", F.when(F.col("id") == 5, "failed"))

    with pytest.raises(RuntimeError):
        events.resume(rows, store, ["id"], breaks, 20)
    assert len(done) == 3
    again = []

    def works(todo):
        again.append(sorted(r.id for r in todo.collect()))
        return todo.withColumn("error", F.lit(None).cast("string"))

    (tmp_path / "store" / "0000000099-broken").mkdir()  # a batch that was never committed
    (tmp_path / "store" / "0000000099-broken" / "part-0.parquet").write_bytes(b"torn")
    out = events.resume(rows, store, ["id"], works, 20)
    assert sorted(r.id for r in out.collect()) == list(range(90)) and out.where("error IS NOT NULL").count() == 0
    finished = set(done[0] + done[1]) - {5}
    assert set(sum(again, [])) == set(range(90)) - finished  # nothing is done twice
    assert events.resume(rows, store, ["id"], breaks, 20).count() == 90 and len(done) == 3


def test_resume_of_nothing(spark, tmp_path):
    none = spark.range(0).select("id")
    assert events.resume(none, str(tmp_path / "s"), ["id"], lambda t: t.withColumn("error", F.lit(None).cast("string"))).count() == 0


ATTEMPTS = "task string, attempt int, failures array<struct<test_name: string, error_message: string>>, error string, ts timestamp_ntz"


def feedback(rows):
    """The reference text, one attempt after another."""
    out, by = {}, {}
    for task, n, failures, error, _ in rows:
        if n is not None:
            lines = ["### Attempt 1 (Initial Execution):" if n == 0 else f"### Attempt {n + 1} (Retry {n}):", ""]
            if error:
                lines += [f"   Execution failed: {error}", ""]
            elif not failures:
                lines += ["   No test failures recorded.", ""]
            for i, (name, message) in enumerate([] if error else failures or [], 1):
                lines += [f"{i}. **{name}**", *([f"   Error: {message}"] if message else []), ""]
            text = "".join(x + "\n" for x in lines)
            by.setdefault(task, {})[n] = max(text, by.get(task, {}).get(n, ""))
    for task, blocks in by.items():
        for n in blocks:
            out[task, n] = "".join(blocks[m] for m in sorted(blocks) if m <= n)
    return out


def test_feedback_in_batch_and_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        failures = [None, [], [("t1", "bad"), ("t2", None)], [("t3", "")]][i % 4]
        rows.append((f"k{i % 9}" if i % 17 else None, i // 9, failures, "died" if i % 5 == 0 else "", start + timedelta(minutes=i)))
    rows += [("k1", 0, None, "other", start), ("k1", None, None, "x", start)]
    table = spark.createDataFrame(rows, ATTEMPTS)
    want = feedback(rows)
    got = {(r.task, r.attempt): r.history for r in events.retry_feedback(table, "task", "attempt", "failures", "error").collect()}
    assert got == want
    for k in (3, 1, 2, 0):  # later attempts come first
        table.where(f"attempt IS NULL OR attempt % 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), 1)
    out = events.run_available(events.retry_feedback_stream(stream, "task", "attempt", "failures", "error", "ts", "30 days"), "update")
    last = out.groupBy("task", "attempt").agg(F.max_by("history", F.struct("batch", F.length("history"))).alias("history"))
    assert {(r.task, r.attempt): r.history for r in last.collect()} == want
    prompt = table.limit(1).select(events.retry_prompt(F.lit("Do it"), F.lit("H"), F.lit(2)).alias("p")).first().p
    assert prompt.startswith("Do it\n\n====") and "\n\nH---\nThis is retry 2 of 3.\n\nPlease" in prompt and prompt.endswith("=\n")


def test_silent_tasks_are_forgotten(spark, tmp_path):
    from datetime import datetime

    for day, n in ((1, 0), (20, 0), (21, 1)):
        rows = [("old" if day == 1 else "new", n, None, f"day {day}", datetime(2024, 1, day))]
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("old", 1, None, "late", datetime(2024, 1, 25))], ATTEMPTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), 1)
    out = events.run_available(events.retry_feedback_stream(stream, "task", "attempt", "failures", "error", "ts", "2 days"), "update")
    texts = {(r.task, r.attempt): r.history for r in out.collect()}
    assert "day 20" in texts["new", 1] and "day 21" in texts["new", 1]
    assert "day 1\n" not in texts["old", 1]


def test_reviews(spark):
    answers = ['```json\n[1]\n``` {"is_valid": 1, "issues": "one"}', "```json\n{\"issues\": null}\n```", "is_valid: FALSE\n" + "\n".join(f"- {i}" for i in range(12)), None, 'x "is_valid": true', '{"a": {"is_valid": true}}']
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", scanners.parse_prm_result(F.col("a")).alias("r"))
    got = {r.i: tuple(r.r) for r in rows.collect()}
    assert got[0] == (True, ["one"], "") and got[1] == (False, [], "")
    assert got[2][:2] == (False, [str(i) for i in range(10)])
    assert got[3][0] and got[3][2].startswith("Could not") and got[4] == (True, [], "") and got[5][0]


def test_documented_functions(spark):
    text = "## Big\n#### Merge PDFs \n####\n\nUsage\n#### Über Ärger\n  def  load_x (a)\nPdf(x).extract_text(y).open(z).go()\n`save()` `Load_X()` Examples(1)\n#### merge pdfs"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(parsers.documented_functions(F.col("t")).alias("f"))
    assert [r.f for r in rows.collect()] == [["Merge PDFs", "Über Ärger", "load_x", "Pdf", "extract_text", "save"], [], []]


def test_first_later_result_of_a_use(spark):
    uses = spark.createDataFrame([("s", "u", 1, "a"), ("s", "u", 1, "a"), ("s", "u", 5, "b"), ("s", "w", 2, "c"), (None, "u", 1, "d"), ("s", None, 1, "e")], "s string, u string, o int, output2 string")
    results = spark.createDataFrame([("s", "u", 1, "same place"), ("s", "u", 3, "y"), ("s", "u", 3, "x"), ("s", "u", 4, "later"), ("s", "w", 3, None), ("s", "w", 4, "too late"), (None, "u", 2, "n"), ("s", None, 2, "n")], "s string, u string, o int, t string")
    got = sorted(((r.output2, r.output) for r in tools.pair_by_use(uses, results, "s", "u", "o", "t", 3).collect()), key=str)
    assert got == [("a", "x"), ("a", "x"), ("b", None), ("c", None), ("d", None), ("e", None)]


def test_documented_functions_of_a_long_document(spark):
    """Thousands of names are told apart by sorting; comparing each with a list made anew for it took minutes."""
    lines = [f"def do_{i} (x):" for i in range(4000)] + [f"`DO_{i}()` `only_{i}()`" for i in range(4000)]
    began = time.monotonic()
    got = spark.createDataFrame([("\n".join(lines),)], "t string").select(parsers.documented_functions(F.col("t")).alias("f")).first().f
    assert got == [f"do_{i}" for i in range(4000)] + [f"only_{i}" for i in range(4000)]
    assert time.monotonic() - began < 30


def test_tasks_share_states(spark, tmp_path, monkeypatch):
    """Many tasks are in one keyed state, and each is forgotten on its own."""
    from datetime import datetime

    monkeypatch.setattr(events, "BUCKETS", 1)
    big = 2**53 + 1
    for day, names in ((1, [7, big]), (20, [big, None, *range(100, 140)]), (21, [big, None]), (25, [7])):
        rows = [(t, day, None, f"day {day}", datetime(2024, 1, day)) for t in names]
        spark.createDataFrame(rows, ATTEMPTS.replace("task string", "task long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), 1)
    monkeypatch.setattr(events, "shared_dir", lambda spark: str(tmp_path / "shared"))
    out = events.run_available(events.retry_feedback_stream(stream, "task", "attempt", "failures", "error", "ts", "5 days"), "update")
    texts = {(r.task, r.attempt): r.history for r in out.collect()}
    assert all("day 20" in texts[t, n] and "day 21" in texts[t, 21] for t in (big, None) for n in (20, 21))
    assert "day 1\n" in texts[big, 20] and "day 25" in texts[7, 25] and "day 1\n" not in texts[7, 25] and len(texts) == 2 + 42 + 2 + 1
    store = next((tmp_path / "shared").glob("weft-stream-*/state"))
    assert spark.read.format("statestore").load(str(store)).count() == 2
