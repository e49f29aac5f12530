"""Rows multiplied by an explode or a map over batches, which Spark sizes too low, are not sent through the driver."""

from weft.llm import linededup, simhash
from weft.operators.components import connected_components


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anchors_are_joined_without_a_broadcast(spark):
    fps = spark.range(500).selectExpr("xxhash64(id % 400) AS fp").distinct()
    found = simhash.links(fps.unionByName(fps.selectExpr("fp ^ 5 AS fp")))
    assert "BroadcastHashJoin" not in plan_of(found)
    assert found.count() >= 800


def test_keys_of_lines_are_joined_without_a_broadcast(spark, monkeypatch):
    """Lines times their keys, in all joins on keys of line de-duplication."""
    plans, write = [], linededup.materialize

    def noted(df, *by):
        plans.append(plan_of(df))
        return write(df, *by)

    monkeypatch.setattr(linededup, "materialize", noted)
    monkeypatch.setattr(linededup, "connected_components", lambda links: plans.append(plan_of(links)) or connected_components(links))
    texts = [(i, " ".join(f"word{(i // 2 * 7 + j) % 50}" for j in range(30 + i % 2))) for i in range(40)]
    out = linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert out.agg({"n_dropped": "sum"}).first()[0] > 0
    sent = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line and "key#" in line]
    assert not sent


def test_words_of_equal_rows_are_not_counted_together(spark):
    docs = spark.createDataFrame([(None, 5, "a b c\nd, e")] * 3 + [(7, 6, "A-b. c!"), (8, 7, None), (9, 8, "--")], "id long, k long, t string")
    got = linededup.hashed_lines(docs).collect()
    assert len(got) == 9
    of = {(r.id, r.pos): (r.h1, r.h2, r.size, r.sim) for r in got}
    assert of[7, 0] == of[None, 0] and of[7, 0][2] == 5 and of[None, 1][2] == 3
    assert not of[8, None][2] and not of[9, 0][2]
    plan = plan_of(linededup.hashed_lines(docs))
    assert plan.count("regexp_extract_all") == 1 and "partial_sum" in plan  # summed by compiled code, words split once
