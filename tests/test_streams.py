"""Whole-table stream queries on several files out of order that span more than any watermark."""

import random
from datetime import datetime, timedelta

import duckdb

from weft.plans import trajectory_queries as q


def test_streams_match_sql_on_shuffled_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (i, datetime(2024, 1, 1) + timedelta(hours=4 * i), rng.randrange(12), rng.choice("abcdefgh"), float(rng.randrange(9)))
        for i in range(1200)  # 200 days
    ]
    for part in range(12):
        rng.shuffle(rows)
        some, rows = rows[:100], rows[100:]
        df = spark.createDataFrame(some, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("event_windows", "exploration_state"):
        want = sorted(con.execute(q.oracle_sql()[name]).fetchall())
        got = sorted(tuple(r) for r in q.queries()[name](spark, str(tmp_path)).collect())
        assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
