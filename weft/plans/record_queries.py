"""Registered queries of record joins, merges and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import graph, records
from weft.session import table


def canonical_mode(spark, d):
    p = table(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type")).alias("text"), "p_partkey")
    return records.canonical_mode(p, "p_brand", "text", "p_partkey")


def apply_reviews(spark, d):
    """Orders as edges, reviewed by their customers' segment where one is known."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    r = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", (F.col("c_mktsegment") != "BUILDING").alias("keep_edge"))
    return records.apply_reviews(o, r, "c_custkey")


def resolve_skill(spark, d):
    """Parts found by key, else by name."""
    p = table(spark, d, "part")
    want = p.select(F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")).alias("p_partkey"), "p_name", F.col("p_partkey").alias("wanted"))
    by_name = p.groupBy("p_name").agg(F.min("p_size").alias("p_size"))
    return records.resolve(want, p.select("p_partkey", "p_size"), by_name, "p_partkey", "p_name", "p_size").select("wanted", "p_size")


def completion_nodes(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    c = table(spark, d, "customer")
    e = c.select(F.col("c_nationkey").cast("long").alias("source"), F.lit("s").alias("source_name"), F.lit(99).cast("long").alias("target"), F.lit("t").alias("target_name"), F.col("c_custkey").alias("ord"))
    return records.completion_nodes(n, e)


def missing_docs(spark, d):
    """Sources and how many of their documents lack a label."""
    docs, labels = table(spark, d, "documents").select("source", "doc_id"), table(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("missing"))


def map_to_canonical(spark, d):
    """Each user's event types as numbers of the canonical ones, in order of first use."""
    e = table(spark, d, "events")
    kinds = e.select("event_type").distinct().where("event_type <> 'view'").withColumn("canonical_id", F.length("event_type") * 1000 + F.ascii("event_type"))
    out = records.map_to_canonical(e, kinds, "user_id", "event_type", "event_id")
    return out.select("user_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def last_file_contents(spark, d):
    e = table(spark, d, "events")
    return records.last_contents(e, "user_id", "event_type", "event_id", "props")


def merge_loops(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_set(F.pmod("l_partkey", F.lit(5)))).alias("parts"), F.array_sort(F.collect_set(F.pmod("l_suppkey", F.lit(3)))).alias("supps"))
    m = records.merge_loops(o, "l_orderkey", ["parts", "supps"], "l_linenumber")
    return m.select("l_orderkey", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("parts", "supps")])


def merge_deps(spark, d):
    p = table(spark, d, "part")
    name = F.element_at(F.split("p_name", " "), 1)
    req = F.when(F.col("p_size") % 4 == 0, F.concat(name, F.lit("=="), F.col("p_size"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("-r "), name)).otherwise(name)
    return records.merge_requirements(p.select("p_brand", req.alias("r")), "p_brand", "r")


def instruction_gate(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.pmod("o_custkey", F.lit(100)) / 10).alias("w"), F.when(F.col("o_orderkey") % 2 == 0, F.pmod("o_orderkey", F.lit(90)) / 10).alias("c"))
    return o.select("o_orderkey", records.instruction_gate(F.col("w"), F.col("c")).alias("passes"))


def should_continue(spark, d):
    o = table(spark, d, "orders")
    c = records.should_continue(F.pmod("o_custkey", F.lit(11)) / 10, F.pmod("o_orderkey", F.lit(5)), F.pmod("o_custkey", F.lit(40)))
    return o.select("o_orderkey", c.alias("reason"))


def newly_covered(spark, d):
    """Parts first sold in each ship month."""
    li = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_partkey")
    return records.newly_covered(li.withColumn("ord", F.col("month")), "month", "ord", "l_partkey")


def sort_alignments(spark, d):
    """All orders numbered in a global order of price, customer and key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = graph.with_dense_id(o, "n", F.desc("o_totalprice"), F.asc("o_custkey"), F.asc("o_orderkey"))
    return out.select("o_orderkey", F.format_string("align-%07d", "n").alias("alignment_id"))


def set_operations(spark, d):
    """Customers who ordered, who did not, and all parts of both: union, intersection and difference."""
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    sets = {"intersect": c.intersect(o), "except": c.exceptAll(o.distinct()), "union": c.union(o).distinct()}
    out = None
    for name, s in sets.items():
        one = s.select(F.lit(name).alias("part"), "c_custkey")
        out = one if out is None else out.unionByName(one)
    return out


def meta_counts(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("keep"), F.count_if(F.col("quality") == 0).alias("reject"), F.count_if(F.col("quality").isNull()).alias("skipped")
    )


def queries():
    return {f.__name__: f for f in (
        canonical_mode, apply_reviews, resolve_skill, completion_nodes, missing_docs, map_to_canonical, last_file_contents, merge_loops, merge_deps,
        instruction_gate, should_continue, newly_covered, sort_alignments, set_operations, meta_counts,
    )}


def oracle_sql():
    return {
        "canonical_mode": """WITH x AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type END AS text FROM part),
            t AS (SELECT p_brand, lower(text) AS low, count(*) AS n, arg_min(text, p_partkey) AS canonical FROM x GROUP BY 1, 2)
            SELECT p_brand, canonical FROM t QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, length(low), low) = 1""",
        "apply_reviews": """SELECT c_custkey, o_orderkey, CASE WHEN c_mktsegment IS NULL THEN 'unreviewed' WHEN c_mktsegment <> 'BUILDING' THEN 'kept' ELSE 'dropped' END AS verdict
            FROM (SELECT o_orderkey, o_custkey AS c_custkey FROM orders) LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) USING (c_custkey)""",
        "resolve_skill": """SELECT p_partkey AS wanted, CASE WHEN p_partkey % 3 > 0 THEN p_size ELSE min(p_size) OVER (PARTITION BY p_name) END AS p_size FROM part""",
        "completion_nodes": """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey < 2
            UNION ALL SELECT DISTINCT CAST(c_nationkey AS BIGINT), 's' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) UNION ALL SELECT 99, 't'""",
        "missing_docs": "SELECT source, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
        "map_to_canonical": """WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
            l AS (SELECT user_id, array_to_string(list(length(event_type) * 1000 + ascii(event_type) ORDER BY o), ',') AS ids FROM f GROUP BY 1)
            SELECT user_id, coalesce(ids, '') AS ids FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN l USING (user_id)""",
        "last_file_contents": "SELECT user_id, event_type, arg_max(props, event_id) AS content, count(*) AS writes FROM events GROUP BY 1, 2",
        "merge_loops": """WITH p AS (SELECT l_orderkey, l_partkey % 5 AS v, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey, l_suppkey % 3 AS v, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2),
            a AS (SELECT l_orderkey, array_to_string(list(v ORDER BY o, v), ',') AS parts FROM p GROUP BY 1), b AS (SELECT l_orderkey, array_to_string(list(v ORDER BY o, v), ',') AS supps FROM s GROUP BY 1)
            SELECT l_orderkey, parts, supps FROM a JOIN b USING (l_orderkey)""",
        "merge_deps": """WITH x AS (SELECT p_brand, string_split(p_name, ' ')[1] AS n, p_size FROM part WHERE p_size % 4 <> 1),
            y AS (SELECT p_brand, n, CASE WHEN p_size % 4 = 0 THEN n || '==' || p_size ELSE n END AS r FROM x)
            SELECT p_brand, lower(n) AS package, coalesce(min(r) FILTER (contains(r, '=')), min(r)) AS requirement, count(*) AS sources FROM y GROUP BY 1, 2""",
        "instruction_gate": "SELECT o_orderkey, (o_custkey % 100) / 10 >= 8.0 AND (o_orderkey % 2 <> 0 OR (o_orderkey % 90) / 10 >= 7.0) AS passes FROM orders",
        "should_continue": """SELECT o_orderkey, CASE WHEN o_custkey % 11 >= 9 THEN 'coverage' WHEN o_orderkey % 5 >= 3 THEN 'no_progress' WHEN o_custkey % 40 >= 30 THEN 'chunk_limit' END AS reason FROM orders""",
        "newly_covered": """WITH x AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month, l_partkey FROM lineitem), f AS (SELECT l_partkey, min(month) AS f FROM x GROUP BY 1)
            SELECT month, count(*) FILTER (f = month) AS new, count(*) AS total FROM x JOIN f USING (l_partkey) GROUP BY 1""",
        "sort_alignments": "SELECT o_orderkey, printf('align-%07d', row_number() OVER (ORDER BY o_totalprice DESC, o_custkey, o_orderkey)) AS alignment_id FROM orders",
        "set_operations": """SELECT 'intersect' AS part, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL
            SELECT 'except', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
            SELECT 'union', c_custkey FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)""",
        "meta_counts": """SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS keep, count(*) FILTER (quality = 0) AS reject, count(*) FILTER (quality IS NULL) AS skipped
            FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    }
