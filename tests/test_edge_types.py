"""Edge types are combined before the shuffle."""

from weft.operators import graph


def test_edge_types_are_gathered_as_sets(spark):
    rows = [(1, 2, t, 3, 0.5, True) for t in ("b", "a", "b", "", None)] * 20
    df = spark.createDataFrame(rows, "source long, target long, alignment_type string, confidence int, retrieval_score double, compatible boolean")
    out = graph.edge_aggregate(df)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.alignment_count, r.alignment_types) for r in out.collect()] == [(100, ["a", "b"])]
