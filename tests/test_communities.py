"""Pruned neighbours, Louvain, complete linkage and scenario de-duplication against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import communities, vectors
from weft.plans import community_queries

VECTORS = "id long, v array<double>"


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def bundles(seed, groups, each, dim=12, spread=0.08):
    """Vectors around far-apart directions."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return np.concatenate([c + spread * rng.standard_normal((each, dim)) * np.linalg.norm(c) for c in centres])


def rows_of(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], VECTORS)


@pytest.mark.parametrize("low", [None, 0.2])
def test_neighbours_with_small_blocks(spark, low):
    m = bundles(1, 9, 30)
    m[5], m[77] = 0, 0  # vectors without a direction
    m[10] = m[11]  # ties
    s = unit(m) @ unit(m).T
    got = defaultdict(list)
    for r in vectors.neighbours(rows_of(spark, m), rows_of(spark, m), 4, low, block=16).orderBy("source", "rank").collect():
        got[r.source].append(r.target)
    for i in range(len(m)):
        order = sorted((j for j in range(len(m)) if j != i and (low is None or s[i, j] >= low)), key=lambda j: (-round(s[i, j], 9), j))[:4]
        assert got[i] == order


def test_similar_pairs_and_far_cells_are_not_visited(spark):
    m = bundles(2, 12, 40, spread=0.02)
    s = unit(m) @ unit(m).T
    rows = rows_of(spark, m)
    got = {(r.i, r.j) for r in vectors.similar_pairs(rows, 0.9, block=20).collect()}
    assert got == {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if s[i, j] >= 0.9}
    cells = vectors.Cells(rows, 20)
    asked = rows.withColumn("floor", F.lit(None).cast("double"))
    others = cells.visits(asked, False, 0.9).count()
    assert others < 0.25 * len(m) * len(cells.pivots)  # only cells of the same direction are left


def test_search_is_streamed_past_chunks_of_bounded_size(spark):
    """Vectors without structure: rows sent are packed vectors times chunks, not a row for each query and cell."""
    m = np.random.default_rng(11).standard_normal((900, 8))
    m[:40] = m[40:80]  # equal scores
    s = unit(m) @ unit(m).T
    cells = vectors.Cells(rows_of(spark, m), 64)
    asked = vectors._asked(rows_of(spark, m))
    found = [tuple(r) for r in cells.search(asked, 5, None).select("source", "rank", "target").collect()]
    assert sorted(found) == [(i, r, j) for i in range(900) for r, j in enumerate(sorted((j for j in range(900) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:5], 1)]
    assert 900 / cells.chunks >= 8  # chunks, not queries, are what the vectors are sent to


def test_pairs_inside_parts_only(spark):
    m = bundles(12, 3, 20, spread=0.2)
    s = unit(m) @ unit(m).T
    rows = rows_of(spark, m).withColumn("part", F.col("id") % 3)
    got = {(r.i, r.j) for r in vectors.similar_pairs(rows, 0.7, block=16).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.7 and i % 3 == j % 3}


def test_rounded_threshold_of_similar_pairs(spark, tmp_path):
    """The query's SQL rounds before it compares: a score of 0.3499997 is one of 0.35."""
    a = 0.3499997
    rows = [(1, [1.0, 0.0], 0), (2, [a, float(np.sqrt(1 - a * a))], 0), (3, [0.3499994, float(np.sqrt(1 - 0.3499994**2))], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {tuple(r) for r in community_queries.similar_pairs(spark, str(tmp_path)).where("i = 1").collect()}
    assert got == {(1, 2, 0.35)}


def test_neighbours_of_nothing(spark):
    none = rows_of(spark, np.zeros((0, 3)))
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0])], VECTORS)
    assert vectors.neighbours(none, none, 3).count() == vectors.neighbours(some, none, 3).count() == vectors.neighbours(none, some, 3).count() == 0
    assert vectors.similar_pairs(some, 0.5).count() == 0


def modularity(edges, label):
    two = 2 * sum(w for *_, w in edges)
    inside, total = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        total[label[a]] += w
        total[label[b]] += w
        inside[label[a]] += 2 * w * (label[a] == label[b])
    return sum(inside[c] / two - (total[c] / two) ** 2 for c in total)


def local_optimum(edges, n):
    """Moves single nodes, then merges pairs of communities, as long as modularity rises."""
    label = list(range(n))
    near = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    best = modularity(edges, label)
    changed = True
    while changed:
        changed = False
        for u in range(n):
            for c in {label[v] for v in near[u]} - {label[u]}:
                old, label[u] = label[u], c
                q = modularity(edges, label)
                if q > best + 1e-12:
                    best, changed = q, True
                else:
                    label[u] = old
        for a, b in {tuple(sorted((label[x], label[y]))) for x, y, _ in edges if label[x] != label[y]}:
            tried = [a if c == b else c for c in label]
            q = modularity(edges, tried)
            if q > best + 1e-12:
                label, best, changed = tried, q, True
    return best


@pytest.mark.parametrize("seed", [1])
def test_louvain_quality_and_repeat(spark, seed):
    rng, n = random.Random(seed), 200
    edges = [(a, b, round(0.1 + rng.random(), 3)) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.3 if a // 20 == b // 20 else 0.015)]
    nodes = spark.createDataFrame([(i,) for i in range(n)] + [(777,), (None,), (3,)], "id long")
    noise = [(5, 5, 9.0), (None, 3, 1.0), (0, 4000, 1.0), (1, 2, 0.0), (1, 3, None)]
    table = spark.createDataFrame(edges + [(b, a, w / 2) for a, b, w in edges[:40]] + noise, "i long, j long, score double")
    got = {r.node: r.community for r in communities.louvain(nodes, table).collect()}
    assert set(got) == {*range(n), 777} and got[777] == 777
    members = defaultdict(list)
    for node, c in got.items():
        members[c].append(node)
    assert all(c == min(m) for c, m in members.items())
    assert modularity(edges, got) >= 0.98 * local_optimum(edges, n)
    if seed == 1:  # equal however rows are dealt
        assert got == {r.node: r.community for r in communities.louvain(nodes.repartition(3), table.repartition(7)).collect()}


def test_louvain_without_edges(spark):
    nodes = spark.createDataFrame([(4,), (2,)], "id long")
    assert sorted(map(tuple, communities.louvain(nodes, spark.createDataFrame([], "i long, j long, score double")).collect())) == [(2, 2), (4, 4)]


def agglomerate(ids, s, cut):
    """The nearest pair merges first, ties by ids, while the largest distance is under the cut."""
    parts = {i: [i] for i in ids}
    while True:
        best = min(((max(1 - s[x, y] for x in parts[a] for y in parts[b]), a, b) for a in parts for b in parts if a < b), default=None)
        if best is None or best[0] >= cut:
            return parts
        parts[best[1]] += parts.pop(best[2])


@pytest.mark.parametrize(("seed", "threshold"), [(3, 0.88), (4, 0.5), (5, 0.2)])
def test_complete_linkage_equals_agglomerative_loop(spark, seed, threshold):
    m = bundles(seed, 6, 15, dim=5, spread=0.35)
    m[4] = m[3]
    s = unit(m) @ unit(m).T
    near = [(i, j, float(1 - s[i, j])) for i in range(len(m)) for j in range(i + 1, len(m)) if s[i, j] > threshold]
    got = defaultdict(list)
    for r in communities.complete_linkage(spark.createDataFrame(near + near[:5], "i long, j long, distance double")).collect():
        got[r.cluster].append(r.node)
    want = {c: sorted(x) for c, x in agglomerate(range(len(m)), s, 1 - threshold).items() if len(x) > 1}
    assert {c: sorted(x) for c, x in got.items()} == want
    assert all(s[x, y] > threshold for c in want.values() for x in c for y in c if x != y)


def test_linkage_with_equal_distances(spark):
    pairs = [(a, b, 0.5) for a in range(6) for b in range(a + 1, 6) if (a, b) != (0, 5)]
    got = sorted(map(tuple, communities.complete_linkage(spark.createDataFrame(pairs, "i long, j long, distance double")).collect()))
    s = np.full((6, 6), 0.5)
    s[0, 5] = s[5, 0] = 0.0
    want = agglomerate(range(6), s, 0.6)
    assert got == sorted((x, c) for c, xs in want.items() for x in xs if len(xs) > 1)
    assert communities.complete_linkage(spark.createDataFrame([], "i long, j long, distance double")).count() == 0


def test_scenario_dedup_end_to_end(spark):
    m = bundles(7, 5, 9, dim=6, spread=0.12)
    texts = [f"{'State' if i % 3 else 'state'} {i // 9 if i % 4 else 'x' * (i % 5)}" for i in range(len(m))]
    records = spark.createDataFrame(
        [(i, i // 4, "pre" if i % 2 else "post", texts[i], [float(x) for x in v], "extra") for i, v in enumerate(m)] + [(None, 1, "pre", "t", [1.0] * 6, "x"), (900, 1, "pre", "t", None, "x")],
        "raw_scenario_id long, skill_id long, side string, scenario string, v array<double>, cluster string",
    )
    found, members = communities.scenario_dedup(records, 10, 0.7, 0.9)
    graph = vectors.knn_self_join(rows_of(spark, m), 10, 0.7)
    label = {r.node: r.community for r in communities.louvain(rows_of(spark, m), graph).collect()}
    s = unit(m) @ unit(m).T
    groups = defaultdict(list)
    for i, c in label.items():
        groups[c].append(i)
    want, where = [], {}
    for number, c in enumerate(sorted(groups, key=lambda c: (len(groups[c]), min(groups[c])), reverse=True), 1):
        for part in sorted(agglomerate(sorted(groups[c]), s, 1 - 0.9).values(), key=lambda x: (len(x), min(x)), reverse=True):
            part = sorted(part)
            seen = Counter(texts[i].lower() for i in part)
            text = sorted((texts[i] for i in part), key=lambda t: (-seen[t.lower()], len(t), t.lower()))[0]
            want.append((len(want) + 1, text, len(part), number, sum(i % 2 for i in part), sum(i % 2 == 0 for i in part), len({i // 4 for i in part})))
            where |= dict.fromkeys(part, len(want))
    assert sorted(map(tuple, found.collect())) == want
    assert {r.raw_scenario_id: r.scenario_id for r in members.collect()} == where


def test_rounds_of_louvain_move_no_link(spark, monkeypatch):
    """A level's links are dealt once; rounds send node states to them. More nodes than are sent take joins, with the same proposals."""
    edges = spark.createDataFrame([(a, b, 1.0 + (a * b) % 3) for a in range(60) for b in range(60) if a != b and (a + b) % 7 < 2], "a long, b long, w double")
    total = edges.agg(F.sum("w")).first()[0]
    state = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).select("node", "k", F.lit(0.0).alias("inside"), (F.col("node") % 9).alias("comm"))
    dealt = communities._dealt(edges)
    found = communities._proposals(communities.materialize(state), dealt, total, True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "REPARTITION" not in line]
    assert moved and all("hashpartitioning(comm#" in line for line in moved)
    by_join = communities._proposals(state, dealt, total)
    assert sorted((r.node, r.target, round(r.delta, 9)) for r in found.collect()) == sorted((r.node, r.target, round(r.delta, 9)) for r in by_join.collect())
    dealt.unpersist()
    nodes, table = edges.select(F.col("a").alias("id")).distinct(), edges.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("w").alias("score"))
    want = sorted(map(tuple, communities.louvain(nodes, table).collect()))
    monkeypatch.setattr(communities, "FEW", 0)
    assert sorted(map(tuple, communities.louvain(nodes, table).collect())) == want
