"""Registered queries of file scans and profiles: states, delimited files, types, routed profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft.functions import filetypes
from weft.operators import profiles
from weft.session import shared_dir, table
from weft.sources import files


def scan_state_json(spark, d):
    """Exploration states of customers in today's and older shapes, broken ones and lists left out, with their coverage, and as JSON again."""
    key = F.col("c_custkey").cast("string")
    shapes = [
        F.concat(F.lit('{"skill_names":["s'), key, F.lit('","t"],"total_steps":'), key, F.lit(',"documented_functions":{"a":["f","g"],"b":["h"]},"tested_functions":{"a":["g","x"]},"coverage_ratio":9,"own":1}')),
        F.concat(F.lit('{"skill_name":"s'), key, F.lit('","documented_functions":["f","g","h","i"],"tested_functions":["g"],"exploration_complete":true}')),
        F.concat(F.lit('{"documented_functions":["f"],"session_id":"'), key, F.lit('","workflows":[{"name":"w"}]}')), F.lit("{broken"), F.concat(F.lit("["), key, F.lit("]")),
    ]
    texts = table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*shapes), (F.pmod("c_custkey", F.lit(5)) + 1).cast("int")).alias("t"))
    found = files.states(texts, "t")
    again = files.states(found.select("c_custkey", files.state_json().alias("t")), "t")
    return again.select(
        "c_custkey", F.array_join("skill_names", ",").alias("skills"), "session_id", "total_steps", "exploration_complete", F.size("workflows").alias("workflows"),
        F.to_json("documented_functions").alias("documented"), F.round("coverage_ratio", 6).alias("coverage_ratio"),
    )


def _orders_file(spark, d):
    """Orders as delimited files: every seventh line has a field too many, every eleventh lacks its last."""
    path = f"{shared_dir(spark)}/weft-csv-{uuid.uuid4().hex}.csv"
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    status = F.when(key % 13 == 0, "NA").otherwise(F.col("o_orderstatus"))
    line = F.concat_ws(",", key, status, F.concat(F.lit("'"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("'")), F.col("o_orderpriority"))
    line = F.when(key % 7 == 0, F.concat(line, F.lit(",more"))).when(key % 11 == 0, F.regexp_replace(line, ",[^,]*$", "")).otherwise(line)
    o.select(line.alias("key,status,date,priority")).write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return path


def scan_csv_profiled(spark, d):
    """The rows of the orders' files as they are read back, without a limit."""
    rows = files.delimited(spark, _orders_file(spark, d), limit=None)
    return rows.select(F.col("key").cast("long").alias("key"), "status", "date", "priority")


def csv_profile(spark, d):
    """Kind, different values and missing share of the columns of orders' files."""
    rows = files.delimited(spark, _orders_file(spark, d), limit=None)
    cells = rows.select("key", F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.replace(c, F.lit("'"), F.lit("")).alias("value")) for c in ("key", "status", "date", "priority")])).alias("position", "c"))
    out = profiles.column_profile(cells.select(F.col("key").cast("long").alias("row"), "position", "c.name", "c.value"))
    return out.drop("position")


def _files(spark, d):
    """A file of some type for each part."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    kinds = [
        ("csv", F.concat(F.lit("id,name,when\n1,a,2024-01-02\n"), key, F.lit(",NA,x\n3,too,many,fields\n"))),
        ("py", F.concat(F.lit("import os\ndef f"), key, F.lit("(): pass\n"))), ("rs", F.lit("fn main() {}")),
        ("ipynb", F.concat(F.lit('{"cells":[{"cell_type":"code","source":["import numpy as np\\n","from a'), key, F.lit(' import b"],"outputs":[1]},{"cell_type":"markdown","source":"# x"}],"metadata":{}}'))),
        ("fasta", F.concat(F.lit(">s1\nACGT\n>"), key)), ("geojson", F.concat(F.lit('{"features":[1,2,'), key, F.lit('],"crs":{"properties":{"name":"EPSG:1"}}}'))),
        ("json", F.concat(F.lit('{"b":1,"a":'), key, F.lit("}"))), ("xml", F.concat(F.lit("<r><a/>"), F.lit("<b>"), size, F.lit("</b></r>"))), ("json", F.concat(F.lit("["), size, F.lit("]"))), ("pdf", key),
    ]
    pick = (F.pmod("p_partkey", F.lit(len(kinds))) + 1).cast("int")
    path = F.concat(F.lit("/in/f"), key, F.lit("."), F.element_at(F.array(*[F.lit(e) for e, _ in kinds]), pick))
    return table(spark, d, "part").select("p_partkey", path.alias("path"), F.element_at(F.array(*[c for _, c in kinds]), pick).cast("binary").alias("content"))


def profile_router(spark, d):
    return profiles.profile_files(_files(spark, d)).select("p_partkey", "category", F.replace(F.replace("metadata", F.lit(", "), F.lit(",")), F.lit(": "), F.lit(":")).alias("metadata"))


def file_metadata_text(spark, d):
    told = profiles.profile_files(_files(spark, d))
    text = profiles.metadata_text(F.concat(F.lit("f"), F.col("p_partkey")), F.col("category"), F.col("path"), F.lit("sum"), F.col("metadata"))
    return told.select("p_partkey", text.alias("text"))


def file_types(spark, d):
    """Type and profiler of paths with many endings."""
    endings = ["PDF", "csv", "tsv", "py", "h", "md", "yml", "ipynb", "tar.gz", "webp", "pptx", "html", "geojson", "odd", ""]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.pmod("p_partkey", F.lit(len(endings))) + 1).cast("int"))
    path = F.concat(F.lit("/x.y/"), F.when(F.col("p_size") % 5 == 0, ".").otherwise("n."), ending)
    return table(spark, d, "part").select("p_partkey", filetypes.file_type(path).alias("type"), filetypes.category(path).alias("category"))


def format_metadata_value(spark, d):
    key = F.col("p_partkey").cast("string")
    values = [F.concat(F.lit("[1,2,3,4,5,6,"), key, F.lit("]")), F.concat(F.lit('["a",'), key, F.lit("]")), F.lit("true"), F.lit("null"), F.concat(F.lit('{"k":['), key, F.lit("]}")), F.concat(F.lit('"t '), key, F.lit('"'))]
    value = F.element_at(F.array(*values), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", profiles.format_metadata_value(value).alias("text"))


def queries():
    return {
        "scan_state_json": scan_state_json, "scan_csv_profiled": scan_csv_profiled, "csv_profile": csv_profile, "profile_router": profile_router,
        "file_metadata_text": file_metadata_text, "file_types": file_types, "format_metadata_value": format_metadata_value,
    }


_LINES = """lines AS (SELECT CAST(o_orderkey AS BIGINT) AS key, CASE WHEN o_orderkey % 13 = 0 THEN 'NA' ELSE o_orderstatus END AS status, '''' || strftime(o_orderdate, '%Y-%m-%d') || '''' AS date,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 7 <> 0)"""
_ENDING = "(['PDF', 'csv', 'tsv', 'py', 'h', 'md', 'yml', 'ipynb', 'tar.gz', 'webp', 'pptx', 'html', 'geojson', 'odd', ''])[CAST(p_partkey % 15 AS INTEGER) + 1]"
_META = """meta AS (SELECT p_partkey, p_partkey % 10 AS k, CAST(p_partkey AS VARCHAR) AS n, CAST(p_size AS VARCHAR) AS z FROM part),
told AS (SELECT p_partkey, k, n, z, (['table', 'code', 'code', 'notebook', 'scientific', 'scientific', 'data', 'data', 'data', 'document'])[CAST(k AS INTEGER) + 1] AS category,
  '{"file_size_bytes":' || (CASE k WHEN 0 THEN 52 + length(n) WHEN 1 THEN 24 + length(n) WHEN 2 THEN 12 WHEN 3 THEN 152 + length(n) WHEN 4 THEN 10 + length(n) WHEN 5 THEN 58 + length(n)
    WHEN 6 THEN 12 + length(n) WHEN 7 THEN 18 + length(z) WHEN 8 THEN 2 + length(z) ELSE length(n) END) || CASE k
    WHEN 0 THEN ',"row_count":2,"column_count":3,"column_names":["id","name","when"],"column_types":{"id":"numeric","name":"text","when":"datetime"},"numeric_columns":["id"],"date_columns":["when"],"categorical_columns":[],"missing_value_ratio":0.167}'
    WHEN 1 THEN ',"line_count":3,"programming_language":"python","function_count":1,"function_names":["f' || n || '"],"class_count":0,"class_names":[],"imports":["os"]}'
    WHEN 2 THEN ',"line_count":1,"programming_language":"rust"}'
    WHEN 3 THEN ',"cell_count":2,"code_cell_count":1,"markdown_cell_count":1,"has_outputs":true,"imports":["a' || n || '","numpy"],"programming_language":"python"}'
    WHEN 4 THEN ',"scientific_domain":"bioinformatics","data_format":"fasta","sample_count":2}' WHEN 5 THEN ',"scientific_domain":"geospatial","data_format":"geojson","feature_count":3,"coordinate_system":"EPSG:1"}'
    WHEN 6 THEN ',"data_structure":"object","top_level_keys":["b","a"]}' WHEN 7 THEN ',"root_tag":"r","child_count":2}' WHEN 8 THEN ',"data_structure":"array","item_count":1}' ELSE '}' END AS metadata FROM meta)"""


def _map_sql(kinds, column):
    whens = " ".join(f"WHEN {column} IN ({', '.join(repr(e) for e in es.split())}) THEN '{k}'" for k, es in kinds.items())
    return f"CASE {whens} ELSE 'unknown' END"


def oracle_sql():
    return {
        "scan_state_json": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 's' || c_custkey || ',t' WHEN 1 THEN 's' || c_custkey ELSE '' END AS skills, CASE WHEN c_custkey % 5 = 2 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS session_id,
          CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS BIGINT) ELSE 0 END AS total_steps, c_custkey % 5 = 1 AS exploration_complete, CASE WHEN c_custkey % 5 = 2 THEN 1 ELSE 0 END AS workflows,
          CASE c_custkey % 5 WHEN 0 THEN '{"a":["f","g"],"b":["h"]}' WHEN 1 THEN '{"s' || c_custkey || '":["f","g","h","i"]}' ELSE '{"unknown":["f"]}' END AS documented,
          CASE c_custkey % 5 WHEN 0 THEN round(1 / 3, 6) WHEN 1 THEN 0.25 ELSE 0.0 END AS coverage_ratio FROM customer WHERE c_custkey % 5 < 3""",
        "scan_csv_profiled": f"WITH {_LINES} SELECT * FROM lines",
        "csv_profile": f"""WITH {_LINES}, cells AS (SELECT key AS row, CAST(key AS VARCHAR) AS value, 'key' AS name FROM lines UNION ALL SELECT key, nullif(status, 'NA'), 'status' FROM lines
            UNION ALL SELECT key, replace(date, '''', ''), 'date' FROM lines UNION ALL SELECT key, priority, 'priority' FROM lines),
          head AS (SELECT name, bool_or(regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS dated FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY row) AS r FROM cells WHERE value IS NOT NULL) WHERE r <= 5 GROUP BY 1)
          SELECT name, count(*) AS n, count(DISTINCT value) AS different, CASE WHEN count(TRY_CAST(value AS DOUBLE)) = count(value) THEN 'numeric' WHEN any_value(dated) THEN 'datetime'
            WHEN count(DISTINCT value) < 0.5 * count(*) THEN 'categorical' ELSE 'text' END AS kind, round((count(*) - count(value)) / count(*), 3) AS missing_ratio FROM cells JOIN head USING (name) GROUP BY name""",
        "profile_router": f"WITH {_META} SELECT p_partkey, category, metadata FROM told",
        "file_metadata_text": f"""WITH {_META}, parts AS (SELECT *, '### f' || n || chr(10) || '- **Content Type**: ' || category || chr(10) || '- **Path**: /in/f' || n || '.' ||
            (['csv', 'py', 'rs', 'ipynb', 'fasta', 'geojson', 'json', 'xml', 'json', 'pdf'])[CAST(k AS INTEGER) + 1] || chr(10) || '- **Summary**: sum' AS head FROM told)
          SELECT p_partkey, head || replace(chr(10) || chr(10) || '**Metadata**:' || CASE k
            WHEN 0 THEN '@row_count: 2@column_count: 3@column_names: id, name, when@numeric_columns: id@column_types: {{"id": "numeric", "name": "text", "when": "datetime"}}@date_columns: when@categorical_columns: @missing_value_ratio: 0.167'
            WHEN 1 THEN '@line_count: 3@programming_language: python@function_count: 1@function_names: f' || n || '@class_count: 0@class_names: @imports: os' WHEN 2 THEN '@line_count: 1@programming_language: rust'
            WHEN 3 THEN '@cell_count: 2@code_cell_count: 1@markdown_cell_count: 1@has_outputs: yes@imports: a' || n || ', numpy@programming_language: python'
            WHEN 4 THEN '@scientific_domain: bioinformatics@data_format: fasta@sample_count: 2' WHEN 5 THEN '@scientific_domain: geospatial@data_format: geojson@feature_count: 3@coordinate_system: EPSG:1'
            WHEN 6 THEN '@data_structure: object@top_level_keys: b, a' WHEN 7 THEN '@root_tag: r@child_count: 2' WHEN 8 THEN '@data_structure: array@item_count: 1' ELSE '' END, '@', chr(10) || '  - ') || chr(10) || chr(10) AS text FROM parts""",
        "file_types": f"""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 AND {_ENDING} <> 'tar.gz' THEN '' ELSE lower(regexp_extract({_ENDING}, '([^.]*)$', 1)) END AS e FROM part)
          SELECT p_partkey, {_map_sql(filetypes.FILE_TYPES, 'e')} AS type, {_map_sql(filetypes.CATEGORIES, 'e')} AS category FROM e""",
        "format_metadata_value": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1, 2, 3, 4, 5... (+2 more)' WHEN 1 THEN 'a, ' || p_partkey WHEN 2 THEN 'yes' WHEN 3 THEN 'N/A' WHEN 4 THEN '{"k": [' || p_partkey || ']}' ELSE 't ' || p_partkey END AS text FROM part""",
    }
