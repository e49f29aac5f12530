"""The reference data model on the given tables, as DataFrames and as SQL.

Alignments are line items: the supplier's nation hands work to the customer's nation
with the order's priority as confidence and the root of ten times the discount as retrieval score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import graph
from weft.session import materialize, table

TYPE_SQL = """CASE WHEN l_returnflag = 'R' THEN 'data_state_handoff'
  WHEN l_returnflag = 'A' THEN 'same_state_merge'
  WHEN l_linestatus = 'O' THEN 'topical_only' ELSE 'incompatible' END"""

ALIGNMENTS_SQL = f"""alignments AS (
  SELECT CAST(s_nationkey AS BIGINT) AS source, CAST(c_nationkey AS BIGINT) AS target,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS confidence, sqrt(l_discount * 10) AS retrieval_score,
    {TYPE_SQL} AS alignment_type, substr(o_orderpriority, 1, 1) <> '1' AS compatible
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey)"""

EDGES_SQL = ALIGNMENTS_SQL + """, used AS (
  SELECT * FROM alignments WHERE compatible AND confidence >= 3
    AND alignment_type NOT IN ('duplicate_or_alternative', 'topical_only', 'incompatible')
), raw_edges AS (
  SELECT source, target, count(*) AS alignment_count, array_to_string(list_sort(list_distinct(list(alignment_type))), ',') AS alignment_types,
    round(avg(confidence), 6) AS avg_confidence, max(confidence) AS max_confidence,
    round(avg(retrieval_score), 6) AS avg_retrieval_score, round(max(retrieval_score), 6) AS max_retrieval_score,
    row_number() OVER (ORDER BY source, target) AS edge_id
  FROM used WHERE source <> target GROUP BY source, target
), edges AS (
  SELECT *, round(0.45 * avg_confidence / 5.0 + 0.35 * avg_retrieval_score
    + 0.20 * (ln(1 + alignment_count) / ln(1 + max(alignment_count) OVER ())), 6) AS edge_score FROM raw_edges
)"""

TRIM_SQL = EDGES_SQL + """, outs AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY edge_score DESC, avg_confidence DESC, target) AS INTEGER) AS rank FROM edges)
  WHERE rank <= 12
), ins AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY edge_score DESC, avg_confidence DESC, edge_id) AS INTEGER) AS rank FROM edges)
  WHERE rank <= 12
), degree AS (
  SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
    SELECT source AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY node
), hub AS (
  SELECT node, ln(1 + out_degree + in_degree) / ln(1 + max(out_degree + in_degree) OVER ()) AS weight FROM degree
)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "supplier", "orders", "customer")}
    joined = (
        t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    )
    first = F.substring("o_orderpriority", 1, 1)
    return joined.select(
        F.col("s_nationkey").cast("long").alias("source"), F.col("c_nationkey").cast("long").alias("target"),
        first.cast("int").alias("confidence"), F.sqrt(F.col("l_discount") * 10).alias("retrieval_score"),
        F.expr(TYPE_SQL).alias("alignment_type"), (first != "1").alias("compatible"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored edges, written once: what follows reads them several times."""
    used = alignments(spark, sf_dir).where(graph.is_used_alignment())
    return materialize(graph.edge_quality(graph.edge_aggregate(used)))


def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(graph.with_hub_weights(edges(spark, sf_dir)))
