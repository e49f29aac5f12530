"""Registered queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import vectors
from weft.operators.components import connected_components
from weft.operators.ranking import top_k
from weft.session import table

THRESHOLD = 0.38  # the given vectors hold no pair near the usual 0.8 to 0.9


def _rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def l2_normalize(spark, d):
    r = _rows(spark, d).select("id", F.posexplode(vectors.l2_normalize(F.col("v"))).alias("i", "x"))
    return r.groupBy("id").agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("norm2"), F.round(F.sum("x"), 6).alias("total"))


def knn_self_join(spark, d):
    return vectors.knn_self_join(_rows(spark, d).select("id", "v"), 50, 0.35)


def similarity_graph(spark, d):
    """Weighted degree of every vector, isolated ones too."""
    rows = _rows(spark, d).select("id", "v")
    pairs = vectors.knn_self_join(rows, 100, THRESHOLD)
    ends = pairs.select(F.col("i").alias("id"), "score").unionByName(pairs.select(F.col("j").alias("id"), "score"))
    weight = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"), F.round(F.sum("score"), 5).alias("weight"))
    return rows.select("id").join(weight, "id", "left").fillna({"links": 0, "weight": 0.0})


def knn_cross_join(spark, d):
    """Vectors with an even label (after-states) against those with an odd one (before-states)."""
    rows = _rows(spark, d)
    post, pre = rows.where("label % 2 = 0").select("id", "v"), rows.where("label % 2 = 1").select("id", "v")
    found = vectors.neighbours(post, pre, 5, 0.2)
    return found.select("source", "target", F.round("score", 6).alias("score"), "rank")


def expand_alignments(spark, d):
    """Best matches of states, expanded to the skills (labels) that produce and consume them."""
    match = knn_cross_join(spark, d).where("rank <= 2")
    rows = _rows(spark, d).select("id", "label")
    by_post = rows.select(F.col("id").alias("source"), F.col("label").alias("source_skill"))
    by_pre = rows.select(F.col("id").alias("target"), F.col("label").alias("target_skill"))
    wide = match.join(by_post, "source").join(by_pre, "target").where("source_skill <> target_skill")
    return wide.groupBy("source_skill", "target_skill").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def mean_pool(spark, d):
    pooled = vectors.mean_pool(_rows(spark, d), "label", "v")
    return pooled.select("label", F.posexplode("v").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def connected_components_query(spark, d):
    rows = _rows(spark, d).select("id", "v")
    label = connected_components(vectors.knn_self_join(rows, 50, THRESHOLD), "i", "j")
    return rows.join(label, rows.id == label.node, "left").select("id", F.coalesce("root", "id").alias("component"))


def _ranked(spark, d):
    """Vectors with stars and a name, the keys of the choice of representatives."""
    return _rows(spark, d).select("id", "v", "label", (F.col("id") % 4).alias("stars"), F.concat(F.when(F.col("id") % 2 == 0, "N").otherwise("n"), F.col("id") % 3).alias("name"))


def dedup_clusters(spark, d):
    rows = _ranked(spark, d)
    return vectors.dedup_clusters(vectors.knn_self_join(rows.select("id", "v"), 50, THRESHOLD), rows, THRESHOLD, -F.col("stars"), F.lower("name"))


def cluster_summary(spark, d):
    """Size, side counts and different labels of each component of more than one vector."""
    parts = connected_components_query(spark, d).join(_rows(spark, d).select("id", "label"), "id")
    out = parts.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("label") % 2 == 0).alias("post"), F.count_if(F.col("label") % 2 == 1).alias("pre"),
        F.count_distinct("label").alias("skills"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"),
    )
    return out.where("size > 1")


def representative(spark, d):
    """Best member of each label: most stars, then name ignoring case, then id."""
    return top_k(_ranked(spark, d), ["label"], [F.desc("stars"), F.lower("name"), F.col("id")], 1).select("label", "id")


def queries():
    return {
        "l2_normalize": l2_normalize, "knn_self_join": knn_self_join, "similarity_graph": similarity_graph,
        "knn_cross_join": knn_cross_join, "expand_alignments": expand_alignments, "mean_pool": mean_pool,
        "connected_components": connected_components_query, "dedup_clusters": dedup_clusters,
        "cluster_summary": cluster_summary, "representative": representative,
    }


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _pairs(k, t):
    return f"""near AS (SELECT * FROM (SELECT a.vec_id AS s, b.vec_id AS t, {_COS} AS c,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r <= {k}),
    pairs AS (SELECT least(s, t) AS i, greatest(s, t) AS j, round(max(c), 6) AS score FROM near WHERE c >= {t} GROUP BY 1, 2)"""


_COMPONENTS = """walk(id, reach) AS (
  SELECT vec_id, vec_id FROM embeddings UNION
  SELECT w.id, CASE WHEN p.i = w.reach THEN p.j ELSE p.i END FROM walk w JOIN pairs p ON p.i = w.reach OR p.j = w.reach),
comp AS (SELECT id, min(reach) AS component FROM walk GROUP BY id)"""

_CROSS = f"""cross_ranked AS (SELECT a.vec_id AS source, b.vec_id AS target, {_COS} AS c,
  CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS INTEGER) AS rank
  FROM embeddings a JOIN embeddings b ON a.label % 2 = 0 AND b.label % 2 = 1 WHERE {_COS} >= 0.2),
cross_best AS (SELECT source, target, round(c, 6) AS score, rank FROM cross_ranked WHERE rank <= 5)"""


def oracle_sql():
    return {
        "l2_normalize": """WITH x AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
          n AS (SELECT id, sqrt(sum(x * x)) AS n, sum(x) AS s FROM x GROUP BY id)
          SELECT id, round(sum((x / n) * (x / n)), 6) AS norm2, round(sum(x / n), 6) AS total FROM x JOIN n USING (id) GROUP BY id""",
        "knn_self_join": f"WITH {_pairs(50, 0.35)} SELECT * FROM pairs",
        "similarity_graph": f"""WITH {_pairs(100, THRESHOLD)}, ends AS (SELECT i AS id, score FROM pairs UNION ALL SELECT j, score FROM pairs)
          SELECT vec_id AS id, count(score) AS links, coalesce(round(sum(score), 5), 0.0) AS weight FROM embeddings LEFT JOIN ends ON id = vec_id GROUP BY vec_id""",
        "knn_cross_join": f"WITH {_CROSS} SELECT * FROM cross_best",
        "expand_alignments": f"""WITH {_CROSS} SELECT a.label AS source_skill, b.label AS target_skill, count(*) AS n, max(score) AS best
          FROM cross_best JOIN embeddings a ON a.vec_id = source JOIN embeddings b ON b.vec_id = target WHERE rank <= 2 AND a.label <> b.label GROUP BY 1, 2""",
        "mean_pool": """WITH x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM embeddings),
          n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM x GROUP BY 1)
          SELECT label, i, round(avg(x / n), 6) AS x FROM x JOIN n USING (vec_id) GROUP BY 1, 2""",
        "connected_components": f"WITH RECURSIVE {_pairs(50, THRESHOLD)}, {_COMPONENTS} SELECT id, component FROM comp",
        "dedup_clusters": f"""WITH RECURSIVE {_pairs(50, THRESHOLD)}, {_COMPONENTS}, sized AS (
            SELECT component, count(*) AS n, arg_min(id, (-(id % 4), 'n' || (id % 3), id)) AS representative FROM comp GROUP BY 1),
          numbered AS (SELECT component, row_number() OVER (ORDER BY component) AS cluster_id FROM sized WHERE n > 1)
          SELECT id, cluster_id, representative, CASE WHEN id = representative THEN 1.0 ELSE round({_COS}, 6) END AS score,
            CASE WHEN id = representative THEN 'keep' WHEN {_COS} >= {THRESHOLD} THEN 'drop' ELSE 'neither' END AS outcome
          FROM comp JOIN sized USING (component) LEFT JOIN numbered USING (component) JOIN embeddings a ON a.vec_id = id JOIN embeddings b ON b.vec_id = representative""",
        "cluster_summary": f"""WITH RECURSIVE {_pairs(50, THRESHOLD)}, {_COMPONENTS}
          SELECT component, count(*) AS size, count(*) FILTER (label % 2 = 0) AS post, count(*) FILTER (label % 2 = 1) AS pre, count(DISTINCT label) AS skills,
            array_to_string(list_sort(list(id)), ',') AS members FROM comp JOIN embeddings ON vec_id = id GROUP BY component HAVING count(*) > 1""",
        "representative": """SELECT label, vec_id AS id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id % 4 DESC, vec_id % 3, vec_id) = 1""",
    }
