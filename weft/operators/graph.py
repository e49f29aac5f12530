"""Skill graph operators: alignments to scored edges, edges to workflow tasks.

Every function takes and returns DataFrames. Edges are (source, target, ...); tasks are
(category, path array<long>, edge_sum double, n_edges int), where ``path`` lists the
node ids in order. Scores are rounded to 9 places where they are means of rounded ones,
so that ranks do not hang on the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialize

# Fixed values that task scores are defined by.
STRUCTURE_BONUS = {
    "chain_2": 0.00, "chain_3": 0.03, "chain_4": 0.06, "chain_5": 0.09,
    "fan_out_3": 0.05, "fan_out_4": 0.07, "fan_out_5": 0.09,
    "fan_in_3": 0.05, "fan_in_4": 0.07, "fan_in_5": 0.09,
    "diamond_4": 0.08, "diamond_5": 0.12,
}
DIFFICULTY = {
    "easy": ["chain_2"],
    "medium": ["chain_3", "fan_out_3", "fan_in_3"],
    "hard": ["chain_4", "diamond_4", "fan_out_4", "fan_out_5", "fan_in_4", "fan_in_5"],
    "expert": ["chain_5", "diamond_5"],
}
UNUSED_TYPES = ["duplicate_or_alternative", "topical_only", "incompatible"]
TOP_OUT = TOP_IN = 12


def is_compatible_alignment() -> Column:
    """Strictly compatible, and of a type that hands work on."""
    return F.coalesce(F.col("compatible"), F.lit(False)) & ~F.coalesce(F.col("alignment_type"), F.lit("")).isin(UNUSED_TYPES)


def is_used_alignment(min_confidence: int = 3) -> Column:
    return is_compatible_alignment() & (F.coalesce("confidence", F.lit(0)) >= min_confidence)


def edge_aggregate(alignments: DataFrame) -> DataFrame:
    """One edge per (source, target) without self pairs: counts, types, means and maxima; ids in order of the pair."""
    types = F.array_sort(F.filter(F.collect_set("alignment_type"), lambda t: t != ""))  # a set: a map task sends a type once
    edges = (
        alignments.where("source <> target")
        .groupBy("source", "target")
        .agg(
            F.count(F.lit(1)).alias("alignment_count"),
            types.alias("alignment_types"),
            F.round(F.avg("confidence"), 6).alias("avg_confidence"),
            F.max("confidence").alias("max_confidence"),
            F.round(F.avg("retrieval_score"), 6).alias("avg_retrieval_score"),
            F.round(F.max("retrieval_score"), 6).alias("max_retrieval_score"),
        )
    )
    return with_dense_id(edges, "edge_id", "source", "target")


def with_dense_id(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Numbers 1.. in a global order, from sorted partitions and their sizes, without a one-partition window."""
    ordered = df.repartitionByRange(*[F.col(o) if isinstance(o, str) else o for o in order]).sortWithinPartitions(*order)
    # Written once: partition numbers read twice must be those of one run.
    marked = materialize(ordered.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    sizes = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return marked.join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_m") - F.col("_first") + 1).drop("_p", "_m", "_first", "_base")


def edge_quality(edges: DataFrame) -> DataFrame:
    """Add ``edge_score`` of confidence, retrieval and evidence, the latter relative to the most aligned raw edge."""
    most = edges.agg(F.max("alignment_count").alias("_most"))  # one row
    evidence = F.when(F.col("_most") > 0, F.log1p("alignment_count") / F.log1p("_most")).otherwise(0.0)
    score = 0.45 * F.col("avg_confidence") / 5.0 + 0.35 * F.col("avg_retrieval_score") + 0.20 * evidence
    return edges.crossJoin(F.broadcast(most)).withColumn("edge_score", F.round(score, 6)).drop("_most")


def exclude_endpoints(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose ends are both among ``nodes``."""
    known = nodes.select(F.col(key).alias("_n"))
    return edges.join(known, edges.source == known["_n"], "left_semi").join(known, edges.target == known["_n"], "left_semi")


def trim_out(edges: DataFrame, top: int = TOP_OUT) -> DataFrame:
    """The best out-edges of every source, with their rank."""
    w = Window.partitionBy("source").orderBy(F.desc("edge_score"), F.desc("avg_confidence"), "target")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def trim_in(edges: DataFrame, top: int = TOP_IN) -> DataFrame:
    """The best in-edges of every target; equal ones stay in edge order."""
    w = Window.partitionBy("target").orderBy(F.desc("edge_score"), F.desc("avg_confidence"), "edge_id")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) over all given edges, in one aggregation."""
    ends = edges.select(
        F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                          F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")
    ).select("e.*")
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def hub_weights(edges: DataFrame) -> DataFrame:
    """(node, weight): ln(1 + degree) relative to the largest degree."""
    d = degrees(edges).select("node", (F.col("out_degree") + F.col("in_degree")).alias("degree"))
    most = d.agg(F.max("degree").alias("_most"))  # one row
    return d.crossJoin(F.broadcast(most)).select("node", (F.log1p("degree") / F.log1p("_most")).alias("weight"))


def with_hub_weights(edges: DataFrame) -> DataFrame:
    """Edges with the hub weights of both ends, so that tasks made of them carry their weights along."""
    w = hub_weights(edges)
    out = edges.join(w.select(F.col("node").alias("source"), F.col("weight").alias("source_weight")), "source")
    return out.join(w.select(F.col("node").alias("target"), F.col("weight").alias("target_weight")), "target")


def _weights(edges: DataFrame) -> tuple[Column, Column]:
    """Weights of both ends, NULL where edges carry none."""
    there = "source_weight" in edges.columns
    return tuple(F.col(c) if there else F.lit(None).cast("double") for c in ("source_weight", "target_weight"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes are connected, only sources, only sinks, between others, or isolated."""
    d = degrees(edges)
    per_node = nodes.select(F.col("id").alias("node")).join(d, "node", "left").fillna(0, ["out_degree", "in_degree"])
    has_out, has_in = F.col("out_degree") > 0, F.col("in_degree") > 0
    tally = per_node.agg(
        F.count(F.lit(1)).alias("node_count"),
        F.count_if(has_out | has_in).alias("connected"),
        F.count_if(has_out & ~has_in).alias("source_only"),
        F.count_if(~has_out & has_in).alias("sink_only"),
        F.count_if(has_out & has_in).alias("bridge"),
        F.count_if(~has_out & ~has_in).alias("isolated"),
        F.max("out_degree").alias("max_out_degree"),
        F.max("in_degree").alias("max_in_degree"),
    )
    return tally.crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count")))


def chains(out_edges: DataFrame, nodes: int) -> DataFrame:
    """Paths of ``nodes`` different nodes along trimmed out-edges."""
    sw, tw = _weights(out_edges)
    steps = out_edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("edge_score").alias("_e"), sw.alias("_sw"), tw.alias("_tw"))
    found = steps.select(F.array("_s", "_t").alias("path"), F.col("_e").alias("edge_sum"), F.lit(1).alias("n_edges"), (F.col("_sw") + F.col("_tw")).alias("hub_sum"))
    for _ in range(nodes - 2):
        found = (
            found.join(steps, F.element_at("path", -1) == F.col("_s"))
            .where(~F.array_contains("path", F.col("_t")))
            .select(
                F.concat("path", F.array("_t")).alias("path"), (F.col("edge_sum") + F.col("_e")).alias("edge_sum"), (F.col("n_edges") + 1).alias("n_edges"),
                (F.col("hub_sum") + F.col("_tw")).alias("hub_sum"),
            )
        )
    return found.withColumn("category", F.lit(f"chain_{nodes}"))


def _choose(edges: DataFrame, hub: str, other: str, k: int) -> DataFrame:
    """(hub, others, edge_sum, hub_sum): each choice of ``k`` of a hub's ranked edges, in rank order."""
    weights = dict(zip(("source", "target"), _weights(edges), strict=True))
    slim = edges.select(
        F.col(hub).alias("_h"), F.col(other).alias("_o"), F.col("edge_score").alias("_e"), F.col("rank").alias("_r"),
        weights[hub].alias("_hw"), weights[other].alias("_ow"),
    )
    found = slim.select(F.col("_h").alias("hub"), F.array("_o").alias("others"), F.col("_e").alias("edge_sum"), F.col("_r").alias("last"), (F.col("_hw") + F.col("_ow")).alias("hub_sum"))
    for _ in range(k - 1):
        found = found.join(slim, (F.col("hub") == F.col("_h")) & (F.col("_r") > F.col("last"))).select(
            "hub", F.concat("others", F.array("_o")).alias("others"), (F.col("edge_sum") + F.col("_e")).alias("edge_sum"), F.col("_r").alias("last"),
            (F.col("hub_sum") + F.col("_ow")).alias("hub_sum"),
        )
    return found


def fan_out(out_edges: DataFrame, nodes: int) -> DataFrame:
    """A source with ``nodes`` - 1 of its trimmed out-edges."""
    f = _choose(out_edges, "source", "target", nodes - 1)
    return f.select(F.concat(F.array("hub"), "others").alias("path"), "edge_sum", F.lit(nodes - 1).alias("n_edges"), "hub_sum", F.lit(f"fan_out_{nodes}").alias("category"))


def fan_in(in_edges: DataFrame, nodes: int) -> DataFrame:
    """A target with ``nodes`` - 1 of its trimmed in-edges; the target comes last."""
    f = _choose(in_edges, "target", "source", nodes - 1)
    return f.select(F.concat("others", F.array("hub")).alias("path"), "edge_sum", F.lit(nodes - 1).alias("n_edges"), "hub_sum", F.lit(f"fan_in_{nodes}").alias("category"))


def diamonds(out_edges: DataFrame) -> DataFrame:
    """a to b and c, both to d: (a, b, c, d) with b ranked before c among a's out-edges."""
    sw, tw = _weights(out_edges)
    e = out_edges.select("source", "target", "edge_score", "rank", sw.alias("sw"), tw.alias("tw"))
    ab = e.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("edge_score").alias("e1"), F.col("rank").alias("rb"), F.col("sw").alias("wa"), F.col("tw").alias("wb"))
    ac = e.select(F.col("source").alias("a"), F.col("target").alias("c"), F.col("edge_score").alias("e2"), F.col("rank").alias("rc"), F.col("tw").alias("wc"))
    bd = e.select(F.col("source").alias("b"), F.col("target").alias("d"), F.col("edge_score").alias("e3"), F.col("tw").alias("wd"))
    cd = e.select(F.col("source").alias("c"), F.col("target").alias("d"), F.col("edge_score").alias("e4"))
    found = ab.join(ac, "a").where("rb < rc").join(bd, "b").where("d <> a AND d <> c").join(cd, ["c", "d"])
    return found.select(
        F.array("a", "b", "c", "d").alias("path"), F.expr("e1 + e2 + e3 + e4").alias("edge_sum"), F.lit(4).alias("n_edges"),
        F.expr("wa + wb + wc + wd").alias("hub_sum"), F.lit("diamond_4").alias("category"),
    )


def diamond_tails(found: DataFrame, out_edges: DataFrame) -> DataFrame:
    """Diamonds with the best edge from the sink to a node outside: at most one tail each."""
    _, tw = _weights(out_edges)
    e = out_edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("edge_score").alias("_e"), "rank", tw.alias("_tw"))
    tailed = found.join(e, F.element_at("path", 4) == F.col("_s")).where(~F.array_contains("path", F.col("_t")))
    first = tailed.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("rank"))).where("_n = 1")
    return first.select(
        F.concat("path", F.array("_t")).alias("path"), (F.col("edge_sum") + F.col("_e")).alias("edge_sum"), F.lit(5).alias("n_edges"),
        (F.col("hub_sum") + F.col("_tw")).alias("hub_sum"), F.lit("diamond_5").alias("category"),
    )


def _case(column: str, table: dict, default) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(F.col(column) == key, F.lit(value)).otherwise(out)
    return out


def structure_bonus(column: str = "category") -> Column:
    return _case(column, STRUCTURE_BONUS, 0.0)


def difficulty_of(column: str = "category") -> Column:
    return _case(column, {c: level for level, cs in DIFFICULTY.items() for c in cs}, "unknown")


def score_tasks(tasks: DataFrame) -> DataFrame:
    """Add mean edge score, bonus, hub penalty and quality to tasks made of edges with hub weights: no join, no shuffle."""
    mean = F.col("edge_sum") / F.col("n_edges")
    penalty = 0.05 * F.col("hub_sum") / F.size("path")
    return tasks.withColumns({
        "mean_edge_score": F.round(mean, 9),
        "structure_bonus": structure_bonus(),
        "hub_penalty": F.round(penalty, 9),
        "task_quality_score": F.round(mean + structure_bonus() - penalty, 9),
        "difficulty": difficulty_of(),
    }).drop("edge_sum", "hub_sum")


def quality_topn(tasks: DataFrame, n: int = 1000) -> DataFrame:
    """The best tasks of each category, with their rank."""
    w = Window.partitionBy("category").orderBy(F.desc("task_quality_score"), F.desc("mean_edge_score"), "path")
    return tasks.withColumn("task_rank", F.row_number().over(w)).where(F.col("task_rank") <= n)


def category_stats(tasks: DataFrame, kept: int = 1000) -> DataFrame:
    """Per category: raw and kept tasks, the best score, and how many nodes the tasks touch."""
    tally = tasks.groupBy("category").agg(
        F.count(F.lit(1)).alias("raw"), F.least(F.count(F.lit(1)), F.lit(kept).cast("long")).alias("kept"), F.max("task_quality_score").alias("best")
    )
    nodes = tasks.select("category", F.explode("path").alias("node")).groupBy("category").agg(F.count_distinct("node").alias("nodes"))
    return tally.join(nodes, "category")


def greedy_coverage(tasks: DataFrame, picks: int, target: str = "edge", batch: int = 1000) -> DataFrame:
    """Tasks picked one by one for the most uncovered edges (or ``node``s, or ``both``), ties to quality.

    ``tasks`` are stored, scored paths; equal paths are one. Lazy greedy: what a task would add only shrinks while others are
    picked, so its last known rank bounds it. One aggregation ranks all tasks and brings the ``batch`` best to the driver;
    picks are made among these while the best is not below the rank of the first left out, then all
    are ranked again against what is covered. So a pass serves many picks, and the driver holds ``batch`` paths.
    """
    spark = tasks.sparkSession
    edges = F.transform(F.slice("path", 1, F.size("path") - 1), lambda n, i: F.concat_ws(">", n, F.element_at("path", i + 2)))
    sized = tasks.select(
        F.array_distinct(edges).alias("_edges"), F.array_distinct(F.transform("path", lambda n: n.cast("string"))).alias("_nodes"), F.array_join("path", ",").alias("_key"),
        F.coalesce("task_quality_score", F.lit(float("-inf"))).alias("q"), F.coalesce("mean_edge_score", F.lit(float("-inf"))).alias("m"), F.transform("path", lambda n: -n).alias("p"),
    )
    covered: tuple[set, set] = (set(), set())
    chosen: list[tuple] = []

    def rank(new_edges: int, new_nodes: int) -> tuple[int, int]:
        first = {"edge": new_edges, "node": new_nodes, "both": new_edges + new_nodes}[target]
        return first, new_nodes if target == "edge" else new_edges

    while len(chosen) < picks:
        done = spark.createDataFrame([(sorted(covered[0]), sorted(covered[1]), [c[1] for c in chosen])], "ce array<string>, cn array<string>, ck array<string>")
        fresh = sized.crossJoin(F.broadcast(done)).where(~F.array_contains("ck", F.col("_key")))  # one row
        new_edges, new_nodes = F.size(F.array_except("_edges", "ce")), F.size(F.array_except("_nodes", "cn"))
        first = {"edge": new_edges, "node": new_nodes, "both": new_edges + new_nodes}[target]
        order = F.struct(first.alias("a"), (new_nodes if target == "edge" else new_edges).alias("b"), "q", "m", "p")
        best = fresh.select("_key", "_edges", "_nodes", "q", "m", "p", order.alias("o")).orderBy(F.desc("o")).limit(batch + 1).collect()
        if not best:
            break
        left = {r["_key"]: r for r in best[:batch]}
        bound = (best[batch].o.a, best[batch].o.b, best[batch].q, best[batch].m, list(best[batch].p)) if len(best) > batch else None
        while left and len(chosen) < picks:
            ranked = {k: (*rank(len(set(r["_edges"]) - covered[0]), len(set(r["_nodes"]) - covered[1])), r.q, r.m, list(r.p)) for k, r in left.items()}
            key = max(ranked, key=ranked.get)
            if bound is not None and ranked[key] < bound:
                break
            row = left.pop(key)
            chosen.append((len(chosen) + 1, key, ranked[key][0]))
            covered[0].update(row["_edges"])
            covered[1].update(row["_nodes"])
    return spark.createDataFrame(chosen, "place int, path string, gain int")
