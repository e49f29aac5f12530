"""Structured Streaming over event files: windows, keyed exploration state, resumable runs."""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.session import materialize, release, shared_dir, table


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a folder, or a pattern of files)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, every: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """Events and values per type and tumbling window; rows later than the watermark are left out (none without one)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    return (
        timed.groupBy(F.window("ts", every), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
    )


STATE = "user_id bigint, chunks int, tested int, last_new bigint"


def exploration_state(events: DataFrame) -> DataFrame:
    """Per user: events seen, different types tried, and the event that brought the last new type.

    The keyed state holds the first event of each type, so the last row of a user is the
    same in whatever order and triggers the events come; see :func:`idle_runs`.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunks, firsts = state.get if state.exists else (0, "[]")
        first = dict(json.loads(firsts))
        for rows in batches:
            chunks += len(rows)
            for kind, event in rows.groupby("event_type", dropna=False).event_id.min().items():
                kind = None if pd.isna(kind) else kind
                first[kind] = min(first.get(kind, int(event)), int(event))
        state.update((chunks, json.dumps(list(first.items()))))
        yield pd.DataFrame({"user_id": [key[0]], "chunks": [chunks], "tested": [len(first)], "last_new": [max(first.values())]})

    slim = events.select("user_id", "event_id", "event_type")
    return slim.groupBy("user_id").applyInPandasWithState(step, STATE, "chunks int, firsts string", "update", GroupStateTimeout.NoTimeout)


def idle_runs(state: DataFrame, events: DataFrame) -> DataFrame:
    """Each user's last state with ``idle``: how many of the events came after the one of ``last_new``."""
    after = events.select(F.col("user_id").alias("u"), "event_id").join(state.select("user_id", "last_new"), F.col("u").eqNullSafe(F.col("user_id")))
    idle = after.where("event_id > last_new").groupBy("u").agg(F.count(F.lit(1)).cast("int").alias("idle"))
    return state.join(idle, F.col("user_id").eqNullSafe(F.col("u")), "left").select("user_id", "chunks", "tested", F.coalesce("idle", F.lit(0)).alias("idle"))


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now into a table in the shared folder, and read it.

    In update mode each batch's rows carry its number, for the caller to take the last.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/weft-stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/number={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{names}, batch bigint, number int").parquet(f"{base}/out").drop("number")


def committed(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows of the batches that were finished; None if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/*/_SUCCESS")
    done = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    names = [str(x.getPath().getParent()) for x in done] if done is not None else []
    return spark.read.option("mergeSchema", True).parquet(*names) if names else None


def resume(candidates: DataFrame, store: str, keys: list[str], work: Callable[[DataFrame], DataFrame], batch_rows: int = 1_000_000) -> DataFrame:
    """Do what no earlier run has finished and return the results: of each key the good one, else the last failure.

    ``work`` adds ``error`` (NULL on success); failed rows are done again next time. Work goes in batches of about
    ``batch_rows`` rows, each a folder of ``store`` that counts once Spark has committed it: what a run that
    broke off leaves is not read and its rows are done again, batches before it stay. NULL keys are keys.
    """
    spark = candidates.sparkSession
    before = committed(spark, store)
    todo = candidates
    if before is not None:
        good = before.where("error IS NULL").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        todo = candidates.join(good, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
    todo = materialize(todo)
    parts = -(-todo.count() // batch_rows)
    number = 0 if before is None else before.agg(F.max("batch")).first()[0] + 1
    for part in range(parts):
        some = todo.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == part)
        work(some).withColumn("batch", F.lit(number + part).cast("bigint")).write.parquet(f"{store}/{number + part:010d}-{uuid.uuid4().hex}")
    release(todo)
    rows = committed(spark, store)
    if rows is None:
        return work(candidates).withColumn("batch", F.lit(0).cast("bigint")).limit(0)
    best = Window.partitionBy(*keys).orderBy(F.col("error").isNotNull(), F.when(F.col("error").isNotNull(), -F.col("batch")).otherwise(F.col("batch")))
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


BUCKETS = 4096  # keyed states of the retry feedback
# The words of the feedback.
FEEDBACK_HEAD = "\n\n" + "=" * 60 + "\n## IMPORTANT: Previous Attempts Failed Verification Tests\n" + "=" * 60 + "\n\n"
FEEDBACK_TAIL = """
Please carefully review ALL the errors above and ensure your next attempt:
1. **Avoids ALL previously encountered errors** (not just the most recent ones)
2. Creates all required output files in the correct locations
3. Uses the correct output format (JSON, CSV, etc.) and field names
4. Follows the exact specifications in the instruction

Now, please re-execute the task correctly.
""" + "=" * 60 + "\n"


def attempt_block(attempt: Column, failures: Column, error: Column) -> Column:
    """What is told of one attempt, from 0: its execution error, or its failures (test_name, error_message) in order."""
    title = F.when(attempt == 0, "### Attempt 1 (Initial Execution):").otherwise(F.concat(F.lit("### Attempt "), attempt + 1, F.lit(" (Retry "), attempt, F.lit("):")))

    def line(f: Column, i: Column) -> Column:
        reason = F.when(F.coalesce(f["error_message"], F.lit("")) != "", F.concat(F.lit("\n   Error: "), f["error_message"])).otherwise("")
        return F.concat(i + 1, F.lit(". **"), F.coalesce(f["test_name"], F.lit("")), F.lit("**"), reason, F.lit("\n\n"))

    told = F.array_join(F.transform(failures, line), "")
    body = F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("   Execution failed: "), error, F.lit("\n\n"))).when(F.coalesce(F.size(failures), F.lit(0)) < 1, "   No test failures recorded.\n\n").otherwise(told)
    return F.concat(title, F.lit("\n\n"), body)


def retry_prompt(prompt: Column, history: Column, retry: Column, most: int = 3) -> Column:
    """The prompt of retry ``retry`` (from 1) with the blocks of all attempts before it."""
    return F.concat(prompt, F.lit(FEEDBACK_HEAD), history, F.lit("---\nThis is retry "), retry, F.lit(f" of {most}.\n{FEEDBACK_TAIL}"))


def retry_feedback(attempts: DataFrame, task: str, attempt: str, failures: str, error: str) -> DataFrame:
    """(task, attempt, history): after each attempt, what is told of it and of all before it, in order.

    Of repeated attempts the largest block counts; rows without an attempt are left out.
    """
    blocks = attempts.where(F.col(attempt).isNotNull()).select(task, F.col(attempt).cast("int").alias(attempt), attempt_block(F.col(attempt), F.col(failures), F.col(error)).alias("_b")).groupBy(task, attempt).agg(F.max("_b").alias("_b"))
    w = Window.partitionBy(task).orderBy(attempt).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.select(task, attempt, F.array_join(F.collect_list("_b").over(w), "").alias("history"))


def retry_feedback_stream(attempts: DataFrame, task: str, attempt: str, failures: str, error: str, at: str, keep: str = "1 day") -> DataFrame:
    """The same of a stream, as updates: the last row of a (task, attempt) is that of :func:`retry_feedback`, in whatever order attempts come.

    Tasks are dealt to ``BUCKETS`` keyed states, so that Python is called once a bucket and trigger and not once a task; a state holds
    each of its tasks' blocks and is written again by each trigger that brings one of them. By event time ``at``, a task is forgotten
    ``keep`` after its last attempt, and attempts that are later than that, or have no time, are left out.
    """
    kind = attempts.schema[task].dataType.simpleString()
    millis = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, first = (pickle.loads(state.get[0]) if state.exists else {}), {}  # task: its last time, its blocks
        for rows in batches if not state.hasTimedOut else ():
            tasks = rows.task.tolist() if key[0] >= 0 else [None] * len(rows)
            for name, n, block, at in zip(tasks, rows.attempt.tolist(), rows.block.tolist(), rows.ms.tolist(), strict=True):
                last, blocks = known.get(name, (0, {}))
                if block > blocks.get(n, ""):
                    blocks[n] = block
                known[name] = max(last, at), blocks
                first[name] = min(first.get(name, n), n)
        now = state.getCurrentWatermarkMs()
        known = {name: x for name, x in known.items() if name in first or x[0] + millis + 1 >= now}
        if known:
            state.update((pickle.dumps(known),))
            state.setTimeoutTimestamp(max(min(last for last, _ in known.values()) + millis + 1, now + 1))
        else:
            state.remove()
        out = []
        for name, least in first.items():
            told, blocks = "", known[name][1]
            for n in sorted(blocks):
                told += blocks[n]
                if n >= least:
                    out.append((name, n, told))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["task", "attempt", "history"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["task", "attempt", "history"])

    slim = attempts.where(F.col(attempt).isNotNull() & F.col(at).isNotNull()).select(
        F.col(task).alias("task"), F.col(attempt).cast("int").alias("attempt"), attempt_block(F.col(attempt), F.col(failures), F.col(error)).alias("block"), F.col(at).cast("timestamp").alias("at")
    )
    # NULL tasks have a bucket of their own: beside them pandas would hold whole numbers as floats.
    bucket = F.when(F.col("task").isNull(), -1).otherwise(F.pmod(F.xxhash64("task"), F.lit(BUCKETS)))
    timed = slim.withColumns({"ms": F.unix_millis("at"), "bucket": bucket.cast("int")}).withWatermark("at", f"{millis} milliseconds")
    return timed.groupBy("bucket").applyInPandasWithState(step, f"task {kind}, attempt int, history string", "tasks binary", "update", GroupStateTimeout.EventTimeTimeout)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stream(spark, f"{sf_dir}/events.parquet*")


__all__ = ["exploration_state", "idle_runs", "read_events", "read_stream", "resume", "retry_feedback", "retry_feedback_stream", "retry_prompt", "run_available", "table", "window_counts"]
