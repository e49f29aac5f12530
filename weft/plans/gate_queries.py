"""Registered queries of file domains, packages, script paths, tags and instruction checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import parsers as p
from weft.plans.task_queries import _STEPS_SQL, track_tool_operation
from weft.session import table


def _one_of(values, key):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def detect_domain(spark, d):
    ending = _one_of(("pdf", "CSV", "py", "md", "zip", "sql", ""), "p_partkey")
    return table(spark, d, "part").select("p_partkey", p.domain_of(F.concat(F.lit("/x/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.when(ending != "", ".").otherwise(""), ending)).alias("domain"))


def conda_preferred(spark, d):
    """Parts as requirements: a name of one of four packages, with or without a version or extra."""
    name, end = _one_of(("RDKit", "numpy", "scanpy", "scikit-bio"), "p_partkey"), _one_of(("", "==1.2", ">=3", "[all]>=1", "~=2"), "p_size")
    parts = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(name, end).alias("r")))).alias("x"))
    return parts.select("p_brand", F.array_join(p.conda_packages(F.transform("x", lambda x: x["r"])), ",").alias("packages"))


def extract_paths(spark, d):
    part, n = table(spark, d, "part"), F.replace("p_name", F.lit(" "), F.lit("-"))
    quote = F.when(F.col("p_size") % 2 == 0, "'").otherwise('"')
    script = F.concat(
        F.lit("cat "), quote, F.lit("/data/"), n, quote, F.lit(" > /root/out/"), n, F.when(F.col("p_size") % 3 == 0, ":").otherwise(".txt"), F.lit(" ; cp x /tmp/"), F.col("p_partkey"), F.lit(" '/a://b'")
    )
    return part.select("p_partkey", F.array_join(p.script_paths(script), ",").alias("paths"))


def infer_tags(spark, d):
    """A session's tags from its skills, written files and commands."""
    kind, value = F.col("kind"), F.col("value")
    lists = track_tool_operation(spark, d).groupBy("user_id").agg(
        F.collect_set(F.when(kind == "output", value)).alias("out"), F.max(kind == "command").alias("shell"),
        F.collect_set(F.when((kind == "skill") & value.endswith(".txt"), F.substring(value, 1, 8))).alias("skills"),
    )
    return lists.select("user_id", F.array_join(p.tags_of(F.col("skills"), F.col("out"), F.col("shell")), ",").alias("tags"))


def validate_instruction(spark, d):
    """Documents as instructions that should name two files, the second of which none does."""
    docs = table(spark, d, "documents")
    files = F.array(F.concat(F.lit("/out/"), F.substring("text", 1, 5)), F.lit("/out/none-such.csv"))
    told = F.concat(F.when(F.col("doc_id") % 3 == 0, "First, ").otherwise(""), F.col("text"))
    issues = p.instruction_issues(told, files, F.slice(files, 1, 1))
    return docs.select("doc_id", F.array_join(issues, "|").alias("issues"), (F.size(issues) == 0).alias("valid"))


def queries():
    return {f.__name__: f for f in (detect_domain, conda_preferred, extract_paths, infer_tags, validate_instruction)}


def oracle_sql():
    giveaways = ", ".join(f"'{g}'" for g in p.GIVEAWAYS)
    domains = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in p.DOMAINS.items())
    return {
        "detect_domain": f"""WITH x AS (SELECT p_partkey, ['pdf', 'csv', 'py', 'md', 'zip', 'sql', ''][p_partkey % 7 + 1] AS e FROM part)
            SELECT p_partkey, CASE e {domains} ELSE 'general' END AS domain FROM x""",
        "conda_preferred": """WITH x AS (SELECT p_brand, p_partkey, lower(['RDKit', 'numpy', 'scanpy', 'scikit-bio'][p_partkey % 4 + 1]) || ['', '==1.2', '>=3', '[all]>=1', '~=2'][p_size % 5 + 1] AS r FROM part),
            y AS (SELECT *, string_split(string_split(string_split(r, '[')[1], '>=')[1], '==')[1] AS n FROM x)
            SELECT p_brand, coalesce(string_agg(n, ',' ORDER BY p_partkey) FILTER (n IN ('rdkit', 'scanpy', 'scikit-bio')), '') AS packages FROM y GROUP BY 1""",
        "extract_paths": """WITH x AS (SELECT p_partkey, replace(p_name, ' ', '-') AS n, p_size % 3 > 0 AS whole FROM part)
            SELECT p_partkey, '/data/' || n || CASE WHEN whole THEN ',/root/out/' || n || '.txt' ELSE '' END || ',/tmp/' || p_partkey AS paths FROM x""",
        "infer_tags": f"""WITH {_STEPS_SQL}, t AS (SELECT user_id, 'text-processing' AS tag FROM operations WHERE kind = 'output' AND (ends_with(value, '.txt') OR ends_with(value, '.md'))
              UNION SELECT user_id, 'shell' FROM operations WHERE kind = 'command' UNION SELECT user_id, substr(value, 1, 8) FROM operations WHERE kind = 'skill' AND ends_with(value, '.txt')),
            n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tag) AS i FROM t)
            SELECT user_id, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (i <= 5), '') AS tags FROM (SELECT DISTINCT user_id FROM operations) LEFT JOIN n USING (user_id) GROUP BY 1""",
        "validate_instruction": f"""WITH x AS (SELECT doc_id, string_split(substr(text, 1, 5), '/')[-1] AS f, lower(CASE WHEN doc_id % 3 = 0 THEN 'First, ' ELSE '' END || text) AS t FROM documents),
            k AS (SELECT doc_id, list_filter([{giveaways}], lambda w: contains(t, w)) AS l, contains(t, lower(f)) AS named, f FROM x),
            i AS (SELECT doc_id, list_concat(CASE WHEN named THEN [] ELSE ['Output file ''' || f || ''' not mentioned in instruction'] END, ['Output file ''none-such.csv'' not mentioned in instruction'],
              CASE WHEN named THEN [] ELSE ['Input file ''' || f || ''' not mentioned in instruction'] END, list_transform(l, lambda w: 'Possible implementation detail: ''' || w || '''')) AS x FROM k)
            SELECT doc_id, array_to_string(x, '|') AS issues, len(x) = 0 AS valid FROM i""",
    }
