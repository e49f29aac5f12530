"""Registered queries of readers and judges, over texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import judges
from weft.functions import scalars as s
from weft.operators import vectors
from weft.session import table
from weft.sources import files

_ROW = "struct<event_id: bigint, event_type: string, value: double>"


def scan_rows_polymorphic(spark, d):
    """Events as JSON payloads per user, some arrays and some objects, read back as rows."""
    e = table(spark, d, "events")
    packed = e.groupBy("user_id", F.pmod("event_id", F.lit(50)).alias("part")).agg(F.to_json(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("j"))
    payload = F.when(F.col("user_id") % 2 == 0, F.col("j")).otherwise(F.concat(F.lit('{"meta": {}, "rows": '), "j", F.lit("}")))
    return files.polymorphic_rows(packed.select("user_id", payload.alias("t")), "t", "rows", _ROW).withColumn("value", F.round("value", 6))


def scan_entities_polymorphic(spark, d):
    """Pages as entity payloads in six shapes; an explicit false is left out, a missing answer stays."""
    p, key = table(spark, d, "pages"), F.col("page_id").cast("string")
    keep = F.when(F.col("page_id") % 3 == 0, False).when(F.col("page_id") % 3 == 1, True)
    row = F.to_json(F.struct(key.alias("task_id"), F.lit("page").alias("entity_name"), F.col("url").alias("url"), keep.alias("keep")))
    inner = F.to_json(F.struct(F.lit("page").alias("name"), F.lit("").alias("entity_url"), F.col("url").alias("url"), F.lit("html").alias("type"), keep.alias("keep")))
    task = F.concat(F.lit('{"task_id": "'), key, F.lit('", "upstream_input_entities": [7, '), inner, F.lit("]}"))
    shapes = [F.concat(F.lit('{"entities": ['), row, F.lit("]}")), F.concat(F.lit('{"evaluations": ['), row, F.lit("]}")), F.concat(F.lit('{"tasks": ['), task, F.lit("]}")), task, row, F.concat(F.lit("["), task, F.lit("]")), F.concat(F.lit("["), row, F.lit("]"))]
    text = F.element_at(F.array(*shapes), (F.pmod("page_id", F.lit(7)) + 1).cast("int"))
    return files.entities(p.select(text.alias("t")), "t")


def scan_stream_json_output(spark, d):
    e = table(spark, d, "events")
    lines = F.concat(F.lit('{"content": "'), "event_type", F.lit('"}\nplain '), F.col("event_id").cast("string"), F.lit("\n"), "props")
    return e.select("event_id", files.stream_output(lines).alias("text"))


def embedding_cache(spark, d):
    """Different texts that a cache holding the labelled ones lacks."""
    docs = table(spark, d, "documents")
    cache = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select(s.text_cache_key("m", F.col("text")).alias("key"))
    return files.embedding_misses(docs, cache, "m").select("key")


def quality_judgements(spark, d):
    docs = table(spark, d, "documents")
    j = judges.judge_quality(F.col("text"))
    scored = docs.select("doc_id", *[c.alias(n) for n, c in j.items()])
    q = s.quality_record(*[F.col(n) for n in j])
    return scored.withColumns({"overall_score": q["overall_score"], "keep": q["keep"]})


def align_and_judge(spark, d):
    """Nearest states judged by the offline rule: how many stay by type and confidence."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    found = vectors.neighbours(rows.where("label < 5").select("id", "v"), rows.where("label >= 5").select("id", "v"), 10)
    j = judges.judge_alignment(F.round("score", 6))
    return found.select(*[c.alias(n) for n, c in j.items()]).groupBy(*j).agg(F.count(F.lit(1)).alias("n"))


def queries():
    return {f.__name__: f for f in (scan_rows_polymorphic, scan_entities_polymorphic, scan_stream_json_output, embedding_cache, quality_judgements, align_and_judge)}


def oracle_sql():
    cos = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
    return {
        "scan_rows_polymorphic": "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events",
        "scan_entities_polymorphic": """SELECT CAST(page_id AS VARCHAR) AS task_id, page_id || CASE WHEN page_id % 7 IN (2, 3, 5) THEN '::entity-002' ELSE '::' || substr(sha1(url), 1, 12) END AS entity_record_id,
          'page' AS entity_name, CASE WHEN page_id % 7 IN (2, 3, 5) THEN 'html' ELSE '' END AS entity_type, url, CASE WHEN page_id % 3 = 1 THEN true END AS keep FROM pages WHERE page_id % 3 <> 0""",
        "scan_stream_json_output": "SELECT event_id, event_type || chr(10) || 'plain ' || event_id || chr(10) || props AS text FROM events",
        "embedding_cache": "SELECT DISTINCT 'm:' || sha256(text) AS key FROM documents WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))",
        "quality_judgements": """WITH x AS (SELECT doc_id, CASE WHEN contains(text, 'sudo') THEN 1 ELSE 4 END AS environment_cost_score,
              CAST(greatest(1, least(5, length(text) // 500 + 1)) AS INTEGER) AS verifiability_score,
              CAST(greatest(1, least(5, len(string_split(text, chr(10))))) AS INTEGER) AS documentation_quality_score FROM documents),
            y AS (SELECT *, 0.30::DOUBLE * environment_cost_score + 0.45::DOUBLE * verifiability_score + 0.25::DOUBLE * documentation_quality_score AS o FROM x)
            SELECT * EXCLUDE (o), round(o, 3) AS overall_score, environment_cost_score >= 2 AND verifiability_score >= 3 AND documentation_quality_score >= 3.5 AND o >= 3 AS keep FROM y""",
        "align_and_judge": f"""WITH c AS (SELECT a.vec_id AS s, b.vec_id AS t, {cos} AS c FROM embeddings a JOIN embeddings b ON a.label < 5 AND b.label >= 5),
            r AS (SELECT round(c, 6) AS c FROM c QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(c, 9) DESC, t) <= 10)
            SELECT c >= 0.3 AS compatible, CAST(greatest(1, least(5, ceil(c * 5))) AS INTEGER) AS confidence, CASE WHEN c >= 0.3 THEN 'data_state_handoff' ELSE 'incompatible' END AS alignment_type, count(*) AS n FROM r GROUP BY ALL""",
    }
