"""Tool, task and parser queries against their SQL, and operators against brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_entry import SF, TABLES

import __spark_entry__ as entry
from weft.functions import parsers
from weft.operators import graph, tasks, tools, trajectory
from weft.plans import gate_queries, task_queries


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [*task_queries.queries(), *gate_queries.queries(), "all_paths", "topological_order", "dag_coverage"])
def test_query_matches_its_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF), con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(plain, got.select(names).collect())) == sorted(map(plain, want.fetchall()))


def plain(row):
    return tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in row)


def test_paths_of_cycles_and_long_chains(spark):
    edges = [(1, i, i + 1) for i in range(15)] + [(2, 0, 1), (2, 1, 0)] + [(3, 0, 1), (3, 1, 2), (3, 2, 1), (3, 1, 3)]
    df = spark.createDataFrame(edges, "task long, source long, target long")
    lone = spark.createDataFrame([(4, 9)], "task long, node long")
    got = sorted((r.task, r.path) for r in trajectory.all_paths(df, "task", lone).collect())
    assert got == [(1, list(range(16))), (2, [0]), (2, [1]), (3, [0, 1, 3]), (4, [9])]


def test_greedy_coverage_matches_brute_force(spark):
    import random

    rng = random.Random(1)
    paths = {tuple(rng.sample(range(12), 3)) for _ in range(80)}
    scored = [(list(p), round(rng.random(), 3), round(rng.random(), 3)) for p in sorted(paths)]
    df = spark.createDataFrame(scored, "path array<long>, task_quality_score double, mean_edge_score double")
    edges, nodes, want, left = set(), set(), [], list(scored)
    for place in range(1, 11):
        def key(t):
            pairs = set(zip(t[0], t[0][1:], strict=False))
            return len(pairs - edges), len(set(t[0]) - nodes), t[1], t[2], [-x for x in t[0]]

        best = max(left, key=key)
        want.append((place, ",".join(map(str, best[0])), key(best)[0]))
        left.remove(best)
        edges |= set(zip(best[0], best[0][1:], strict=False))
        nodes |= set(best[0])
    for batch in (1000, 3, 1):  # passes over all tasks come often with small batches
        assert [tuple(r) for r in graph.greedy_coverage(df, 10, batch=batch).orderBy("place").collect()] == want


def test_review_answers(spark):
    told = [("```json\n{\"a\": 1}\n```", '{"a": 1}'), ("so {\"b\": 2} it is", '{"b": 2}'), ('{"c": 3}', '{"c": 3}'), ("none", "{}"), ("{broken}", "{}"), (None, "{}")]
    df = spark.createDataFrame(told, "r string, want string").select(parsers.review_json(F.col("r")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_values_that_are_missing(spark):
    steps = spark.createDataFrame([(1, 1, "Read", None), (1, 2, None, {"file_path": "a"}), (1, 3, "Write", {"other": "x"}), (None, 4, "Edit", {"file_path": "b.c"})], "s long, o long, tool_name string, tool_input map<string,string>")
    ops = tools.track_operations(steps, "s", "o")
    assert sorted((r.o, r.kind, r.value) for r in ops.collect()) == [(4, "edited", "b.c"), (4, "output", "b.c")]
    none = steps.where("false")
    assert tools.track_operations(none, "s", "o").count() == 0 and tools.filtered_files(tools.track_operations(none, "s", "o"), "s").count() == 0
    keys = spark.range(1).select(tasks.record_key(F.lit(None).cast("string"), F.lit("t"), F.lit("u"), F.lit("n")).alias("k")).first().k
    assert keys == "t::u::n"


def test_paths_of_small_graphs_take_no_rounds(spark, monkeypatch):
    """Small graphs are walked in their rows; larger ones, and tasks without a name, grow in rounds, with the same paths."""
    import random

    rng = random.Random(4)
    edges = [(t, *(rng.choice([None, *range(9)]) if t % 5 == 0 else rng.randrange(9) for _ in "st")) for t in range(60) for _ in range(t % 14)]
    edges += [(None, 1, 2), (99, 0, None), (99, None, 3)] + [(100, 2 * i + k, 2 * i + 2 + j) for i in range(6) for k in (0, 1) for j in (0, 1)]
    df = spark.createDataFrame(edges, "task long, source long, target long")
    lone = spark.createDataFrame([(t, n) for t in range(0, 70, 3) for n in (3, 20)] + [(None, 8), (100, 50)], "task long, node long")
    grown, rounds = trajectory._grown, []
    monkeypatch.setattr(trajectory, "_grown", lambda e, *rest: rounds.append(e.count()) or grown(e, *rest))

    def found(size):
        monkeypatch.setattr(trajectory, "WALKED", size)
        return sorted(((r.task, r.path) for r in trajectory.all_paths(df, "task", lone).collect()), key=str)

    walked, mixed, joined = found(64), found(7), found(0)
    assert walked == mixed == joined and len([p for t, p in walked if t == 100]) == 2**7
    assert rounds[0] == 1 and rounds[2] == len(edges) and 1 < rounds[1] < len(edges)
