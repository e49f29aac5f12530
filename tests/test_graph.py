import itertools
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import graph, ranking, trajectory, vectors
from weft.operators.components import connected_components


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(None, 3), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {x: r for x, r in brute_components(edges).items() if x != r}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "source long, target long, edge_score double, avg_confidence double, edge_id long")


@pytest.fixture(scope="module")
def small(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 3), (2, 4), (4, 1), (4, 5), (4, 6)]
    return edges_of(spark, [(a, b, 0.5 + 0.01 * i, 4.0, i) for i, (a, b) in enumerate(pairs)]), pairs


def test_chains_are_simple_paths(small):
    edges, pairs = small
    got = sorted(tuple(r.path) for r in graph.chains(edges, 3).collect())
    want = sorted((a, b, d) for a, b in pairs for c, d in pairs if b == c and len({a, b, d}) == 3)
    assert got == want


def test_fans_choose_in_rank_order(small):
    edges, pairs = small
    ranked = graph.trim_out(edges)
    order = {}
    for r in ranked.orderBy("source", "rank").collect():
        order.setdefault(r.source, []).append(r.target)
    got = sorted(tuple(r.path) for r in graph.fan_out(ranked, 3).collect())
    assert got == sorted((s, *c) for s, ts in order.items() for c in itertools.combinations(ts, 2))


def test_diamonds_and_tails(small):
    edges, _ = small
    outs = graph.trim_out(edges)
    found = graph.diamonds(outs)
    assert {tuple(r.path) for r in found.collect()} in ({(1, 2, 3, 4)}, {(1, 3, 2, 4)})
    tails = [r.path[-1] for r in graph.diamond_tails(found, outs).collect()]
    assert tails == [6]  # the better of 5 and 6, and never 1


def test_trim_in_falls_back_to_edge_order(spark):
    e = edges_of(spark, [(i, 9, 0.5, 4.0, 10 - i) for i in range(5)])
    assert [r.source for r in graph.trim_in(e, 2).orderBy("rank").collect()] == [4, 3]


def test_dense_ids(spark):
    df = spark.range(1000).select((F.pmod(F.col("id") * 37, F.lit(1000))).alias("v"))
    assert all(r.n == r.v + 1 for r in graph.with_dense_id(df, "n", "v").collect())


def test_difficulty_and_bonus(spark):
    rows = spark.createDataFrame([("chain_5",), ("fan_in_3",), ("else",)], "category string")
    got = [tuple(r) for r in rows.select(graph.difficulty_of(), graph.structure_bonus()).collect()]
    assert got == [("expert", 0.09), ("medium", 0.05), ("unknown", 0.0)]


def test_keep_reject_is_strict(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, keep boolean")
    kept, rest = ranking.keep_and_reject(df, F.col("keep"))
    assert [r.id for r in kept.collect()] == [1] and sorted(r.id for r in rest.collect()) == [2, 3]


def test_download_status(spark):
    rows = [("t", "u1", "x", 1), ("t", "u1", "x", 2), ("t", "u2", "x", 3), ("t", None, None, 4), ("t", "u3", "y", 5)]
    df = spark.createDataFrame(rows, "task string, url string, sha string, n int")
    got = {r.n: r.status for r in ranking.download_status(df, "task", "url", "sha", "n").collect()}
    assert got == {1: "downloaded", 2: "duplicate_url", 3: "duplicate_content", 4: "missing_url", 5: "downloaded"}


def test_no_progress(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1, 2, 2, 2, 2])], "s string, chunk int, tested int")
    got = [(r.no_progress, r.go_on) for r in trajectory.no_progress_run(df, "s", "chunk", "tested").orderBy("chunk").collect()]
    assert got == [(0, True), (0, True), (1, True), (2, True), (3, False)]


def test_topological_order_leaves_out_cycles(spark):
    df = spark.createDataFrame([(1, "b", "a"), (1, "b", "c"), (1, "x", "y"), (1, "y", "x")], "task long, source string, target string")
    assert [r.node for r in trajectory.topological_order(df, "task").orderBy("place").collect()] == ["b", "a", "c"]


def test_all_paths(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "b", "d"), (1, "a", "c"), (1, "c", "d")], "task long, source string, target string")
    assert sorted("".join(r.path) for r in trajectory.all_paths(df, "task").collect()) == ["abd", "acd"]


def test_pytest_summary(spark):
    df = spark.createDataFrame([("3 passed, 1 failed in 2.5s", 1), ("4 passed in 1s", 0), ("no tests ran", 5)], "t string, code int")
    got = [(r.passed, r.failed, r.success_rate, r.all_passed) for r in trajectory.pytest_summary(df, "t", "code").collect()]
    assert got == [(3, 1, 0.75, False), (4, 0, 1.0, True), (0, 0, 0.0, False)]


def test_clusters_keep_a_limbo(spark):
    import math

    def at(deg):
        return [math.cos(math.radians(deg)), math.sin(math.radians(deg))]

    rows = spark.createDataFrame([(1, at(0)), (2, at(30)), (3, at(60)), (4, at(180))], "id long, v array<double>")
    pairs = vectors.knn_self_join(rows, 3, 0.8)
    got = {r.id: r.outcome for r in vectors.dedup_clusters(pairs, rows, 0.8).collect()}
    assert got == {1: "keep", 2: "drop", 3: "neither", 4: "keep"}
