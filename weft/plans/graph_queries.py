"""Registered queries of the skill graph and the workflow tasks in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import graph
from weft.plans.bindings import EDGES_SQL, TRIM_SQL, alignments, edges, weighted_edges
from weft.session import materialize, table


def _edges(spark, d):
    e = edges(spark, d)
    return e.withColumn("alignment_types", F.array_join("alignment_types", ","))


def edge_aggregate(spark, d):
    return _edges(spark, d).drop("edge_score")


def edge_quality(spark, d):
    return _edges(spark, d).select("source", "target", "edge_score")


def trim_edges(spark, d):
    e = edges(spark, d)
    out = graph.trim_out(e).select(F.lit("out").alias("side"), "source", "target", "rank")
    return out.unionByName(graph.trim_in(e).select(F.lit("in").alias("side"), "source", "target", "rank"))


def exclude_endpoints(spark, d):
    nations = table(spark, d, "nation").where("n_regionkey <> 0")
    return graph.exclude_endpoints(edges(spark, d), nations, "n_nationkey").select("source", "target", "edge_score")


def degrees(spark, d):
    return graph.degrees(edges(spark, d))


def graph_stats(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    busy = graph.trim_out(edges(spark, d), 3)
    return graph.graph_stats(nodes, busy)


def _scored(spark, d, make):
    tasks = graph.quality_topn(graph.score_tasks(make(weighted_edges(spark, d))))
    return tasks.select(
        "category", F.array_join("path", ",").alias("path"), "difficulty", "mean_edge_score", "hub_penalty", "task_quality_score", "task_rank"
    )


def _chain(n):
    return lambda spark, d: _scored(spark, d, lambda e: graph.chains(graph.trim_out(e), n))


def _fan_out(n):
    return lambda spark, d: _scored(spark, d, lambda e: graph.fan_out(graph.trim_out(e), n))


def _fan_in(n):
    return lambda spark, d: _scored(spark, d, lambda e: graph.fan_in(graph.trim_in(e), n))


def diamond_4(spark, d):
    return _scored(spark, d, lambda e: graph.diamonds(graph.trim_out(e)))


def diamond_5(spark, d):
    def make(e):
        outs = graph.trim_out(e)
        return graph.diamond_tails(graph.diamonds(outs), outs)

    return _scored(spark, d, make)


def greedy_coverage(spark, d):
    """The 20 three-node chains that cover most edges, picked one by one."""
    tasks = materialize(graph.score_tasks(graph.chains(graph.trim_out(weighted_edges(spark, d)), 3)))
    return graph.greedy_coverage(tasks, 20)


def category_stats(spark, d):
    outs = graph.trim_out(weighted_edges(spark, d))
    tasks = graph.chains(outs, 2).unionByName(graph.chains(outs, 3)).unionByName(graph.chains(outs, 4)).unionByName(graph.fan_out(outs, 3))
    return graph.category_stats(graph.score_tasks(tasks))


def pair_jobs(spark, d):
    """Compatible alignments grouped per pair, with the reason why others are passed over."""
    a = alignments(spark, d).withColumn(
        "reason",
        F.when(F.col("source") == F.col("target"), "self_pair").when(~graph.is_compatible_alignment(), "not_compatible").otherwise("job"),
    )
    return a.groupBy("source", "target", "reason").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"))


def _tail(category, path, edge_sum, n_edges, source, size):
    bonus, level = graph.STRUCTURE_BONUS[category], next(k for k, v in graph.DIFFICULTY.items() if category in v)
    weights = " + ".join(f"h{i}.weight" for i in range(size))
    joins = " ".join(f"JOIN hub h{i} ON h{i}.node = p[{i + 1}]" for i in range(size))
    return f"""{TRIM_SQL}, found AS ({source}),
scored AS (SELECT p, e / {n_edges} AS mean, 0.05 * ({weights}) / {size} AS penalty FROM (SELECT {path} AS p, {edge_sum} AS e FROM found) {joins}),
ranked AS (SELECT p, round(mean, 9) AS mean_edge_score, round(penalty, 9) AS hub_penalty, round(mean + {bonus} - penalty, 9) AS task_quality_score FROM scored),
numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY task_quality_score DESC, mean_edge_score DESC, p) AS INTEGER) AS task_rank FROM ranked)
SELECT '{category}' AS category, array_to_string(p, ',') AS path, '{level}' AS difficulty, mean_edge_score, hub_penalty, task_quality_score, task_rank
FROM numbered WHERE task_rank <= 1000"""


def _chain_sql(n):
    names = [f"e{i}" for i in range(1, n)]
    joins = "outs e1" + "".join(f" JOIN outs {b} ON {b}.source = {a}.target" for a, b in zip(names, names[1:], strict=False))
    nodes = ["e1.source", *[f"{x}.target" for x in names]]
    apart = [f"{nodes[j]} <> {nodes[i]}" for i in range(n) for j in range(i + 2, n)]
    source = "SELECT [" + ", ".join(nodes) + "] AS nodes, " + " + ".join(f"{x}.edge_score" for x in names) + f" AS e FROM {joins}" + (" WHERE " + " AND ".join(apart) if apart else "")
    return "WITH " + _tail(f"chain_{n}", "nodes", "e", n - 1, source, n)


def _fan_sql(n, out):
    names = [f"e{i}" for i in range(1, n)]
    t, hub, other = ("outs", "source", "target") if out else ("ins", "target", "source")
    joins = f"{t} e1" + "".join(f" JOIN {t} {b} ON {b}.{hub} = e1.{hub} AND {b}.rank > {a}.rank" for a, b in zip(names, names[1:], strict=False))
    others = ", ".join(f"{x}.{other}" for x in names)
    nodes = f"[e1.{hub}, {others}]" if out else f"[{others}, e1.{hub}]"
    source = f"SELECT {nodes} AS nodes, " + " + ".join(f"{x}.edge_score" for x in names) + f" AS e FROM {joins}"
    return "WITH " + _tail(f"fan_{'out' if out else 'in'}_{n}", "nodes", "e", n - 1, source, n)


_DIAMOND = """SELECT ab.source AS a, ab.target AS b, ac.target AS c, bd.target AS d, ab.edge_score + ac.edge_score + bd.edge_score + cd.edge_score AS e
FROM outs ab JOIN outs ac ON ac.source = ab.source AND ab.rank < ac.rank
JOIN outs bd ON bd.source = ab.target JOIN outs cd ON cd.source = ac.target AND cd.target = bd.target
WHERE bd.target <> ab.source AND bd.target <> ac.target"""

_TAILED = f"""SELECT a, b, c, d, t, e + te AS e FROM (
  SELECT x.*, o.target AS t, o.edge_score AS te, row_number() OVER (PARTITION BY a, b, c, d ORDER BY o.rank) AS n
  FROM ({_DIAMOND}) x JOIN outs o ON o.source = d WHERE o.target NOT IN (a, b, c, d)) WHERE n = 1"""


def _stats_sql(sql):
    inner = sql[: sql.index("numbered AS (")].rstrip().rstrip(",")
    category = sql.split("SELECT '")[-1].split("'")[0]
    return f"""SELECT '{category}' AS category, count(*) AS raw, least(count(*), 1000) AS kept, max(task_quality_score) AS best,
      (SELECT count(DISTINCT n) FROM (SELECT unnest(p) AS n FROM x)) AS nodes FROM x""", inner


def _all_stats_sql():
    parts = []
    for sql in (_chain_sql(2), _chain_sql(3), _chain_sql(4), _fan_sql(3, True)):
        select, inner = _stats_sql(sql)
        parts.append(f"SELECT * FROM ({inner}, x AS (SELECT * FROM ranked) {select})")
    return " UNION ALL ".join(parts)


def queries():
    out = {
        "flagship_best_chains": _chain(3),
        "edge_aggregate": edge_aggregate,
        "edge_quality": edge_quality,
        "trim_edges": trim_edges,
        "exclude_endpoints": exclude_endpoints,
        "degrees": degrees,
        "graph_stats": graph_stats,
        "pair_jobs": pair_jobs,
        "greedy_coverage": greedy_coverage,
        "category_stats": category_stats,
        "diamond_4": diamond_4,
        "diamond_5": diamond_5,
    }
    out |= {f"chain_{n}": _chain(n) for n in (2, 4, 5)}
    out |= {f"fan_out_{n}": _fan_out(n) for n in (3, 4, 5)}
    out |= {f"fan_in_{n}": _fan_in(n) for n in (3, 4, 5)}
    return out


def oracle_sql():
    e = f"WITH {EDGES_SQL} "
    out = {
        "flagship_best_chains": _chain_sql(3),
        "edge_aggregate": e + "SELECT * EXCLUDE (edge_score) FROM edges",
        "edge_quality": e + "SELECT source, target, edge_score FROM edges",
        "trim_edges": f"WITH {TRIM_SQL} SELECT 'out' AS side, source, target, rank FROM outs UNION ALL SELECT 'in', source, target, rank FROM ins",
        "exclude_endpoints": e + """SELECT source, target, edge_score FROM edges
            WHERE source IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0) AND target IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)""",
        "degrees": f"WITH {TRIM_SQL} SELECT node, out_degree, in_degree FROM degree",
        "graph_stats": f"""WITH {TRIM_SQL}, few AS (SELECT * FROM outs WHERE rank <= 3), per AS (
            SELECT n_nationkey, (SELECT count(*) FROM few WHERE source = n_nationkey) AS o, (SELECT count(*) FROM few WHERE target = n_nationkey) AS i FROM nation)
            SELECT count(*) AS node_count, count(*) FILTER (o > 0 OR i > 0) AS connected, count(*) FILTER (o > 0 AND i = 0) AS source_only,
              count(*) FILTER (o = 0 AND i > 0) AS sink_only, count(*) FILTER (o > 0 AND i > 0) AS bridge, count(*) FILTER (o = 0 AND i = 0) AS isolated,
              max(o) AS max_out_degree, max(i) AS max_in_degree, (SELECT count(*) FROM few) AS edge_count FROM per""",
        "pair_jobs": f"""WITH {EDGES_SQL} SELECT source, target, CASE WHEN source = target THEN 'self_pair'
              WHEN NOT (compatible AND alignment_type NOT IN ('duplicate_or_alternative', 'topical_only', 'incompatible')) THEN 'not_compatible' ELSE 'job' END AS reason,
              count(*) AS n, max(confidence) AS best FROM alignments GROUP BY ALL""",
        "category_stats": _all_stats_sql(),
        "diamond_4": "WITH " + _tail("diamond_4", "[a, b, c, d]", "e", 4, _DIAMOND, 4),
        "diamond_5": "WITH " + _tail("diamond_5", "[a, b, c, d, t]", "e", 5, _TAILED, 5),
    }
    out |= {f"chain_{n}": _chain_sql(n) for n in (2, 4, 5)}
    out |= {f"fan_out_{n}": _fan_sql(n, True) for n in (3, 4, 5)}
    out |= {f"fan_in_{n}": _fan_sql(n, False) for n in (3, 4, 5)}
    return out
