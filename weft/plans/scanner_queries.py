"""Registered queries of answer parsers, script scanners, code profiles and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import scanners
from weft.operators import sampling
from weft.session import table


def parse_filter_json(spark, d):
    """Answers about parts: JSON alone, in a fence, in prose, behind a brace that never closes, too deep, or none."""
    key = F.col("p_partkey").cast("string")
    inner = F.concat(F.lit('{"b": [1, {"c": "}"}], "a": '), key, F.lit("}"))
    answers = [
        inner, F.concat(F.lit("Sure:\n```json\n"), inner, F.lit("\n```\nbye")), F.concat(F.lit("I say {"), F.lit('"x": {"y": '), key, F.lit("}} and {}")), F.concat(F.lit("{ see {"), F.lit('"n": '), key, F.lit("}")),
        F.concat(F.lit('ok {"1": {"2": {"3": {"4": '), key, F.lit("}}}} end")), F.concat(F.lit("no braces "), key), F.concat(F.lit("[1, "), key, F.lit("]")),
    ]
    text = F.element_at(F.array(*answers), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", scanners.parse_filter_json(text).alias("json"))


def _script_of_parts(spark, d):
    """A script for each brand, a line or more for each part."""
    key = F.col("p_partkey").cast("string")
    lines = [
        F.concat(F.lit("  from test_"), key, F.lit(" import (a,\n  b(),\n  c\n)")), F.concat(F.lit("LIMIT_"), key, F.lit(" = [\n  # note\n  1,\n\n  {2: ')'},\n]")), F.concat(F.lit("X"), key, F.lit(" = "), key),
        F.lit("import test_all, os"), F.concat(F.lit("def f"), key, F.lit("():\n    Y = (1\n    return Y)")), F.concat(F.lit("  Z"), key, F.lit(" = 1")), F.lit("from expectation_tests import *"),
    ]
    line = F.element_at(F.array(*lines), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("script"))


def sanitize_script(spark, d):
    return _script_of_parts(spark, d).select("p_brand", scanners.sanitize_script(F.col("script")).alias("script"))


def extract_constants(spark, d):
    return _script_of_parts(spark, d).select("p_brand", scanners.extract_constants(F.col("script")).alias("constants"))


def code_profile(spark, d):
    """A module for each brand: a function or class for each part, its size as imports; some do not parse, some are of other languages."""
    key = F.col("p_partkey").cast("string")
    item = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("class C"), key, F.lit(":\n    def m(self): pass"))).otherwise(F.concat(F.lit("def f"), key, F.lit("():\n    import pkg"), F.col("p_size"), F.lit(".sub")))
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("s"))))
    number = F.substring("p_brand", -1, 1).cast("int")
    source = F.concat(F.array_join(F.transform(listed, lambda s: s["s"]), "\n"), F.when(number == 2, "\nimport broken(").otherwise(""))
    files = table(spark, d, "part").groupBy("p_brand").agg(source.alias("source")).withColumn("path", F.concat(F.lit("/src/m"), F.when(number == 3, ".rs").otherwise(".PY")))
    out = files.select("p_brand", scanners.code_profile(F.col("path"), F.col("source")).alias("p")).select("p_brand", "p.*")
    return out.withColumns({c: F.array_join(c, ",") for c in ("function_names", "class_names", "imports")})


def random_sample(spark, d):
    """Three parts of each brand by a hash of seed and key."""
    return sampling.sample_per_group(table(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 3, 13)


def queries():
    return {
        "parse_filter_json": parse_filter_json, "sanitize_script": sanitize_script, "extract_constants": extract_constants,
        "code_profile": code_profile, "random_sample": random_sample,
    }


_SCRIPTS = """scripts AS (SELECT p_brand, string_agg(([
    '  from test_' || p_partkey || ' import (a,' || chr(10) || '  b(),' || chr(10) || '  c' || chr(10) || ')',
    'LIMIT_' || p_partkey || ' = [' || chr(10) || '  # note' || chr(10) || '  1,' || chr(10) || chr(10) || '  {2: '')''},' || chr(10) || ']', 'X' || p_partkey || ' = ' || p_partkey,
    'import test_all, os', 'def f' || p_partkey || '():' || chr(10) || '    Y = (1' || chr(10) || '    return Y)', '  Z' || p_partkey || ' = 1', 'from expectation_tests import *'
  ])[CAST(p_partkey % 7 AS INTEGER) + 1], chr(10) ORDER BY p_partkey) AS s FROM part GROUP BY p_brand),
lines AS (SELECT p_brand, u.i, u.l FROM (SELECT p_brand, unnest(list_transform(string_split(s, chr(10)), lambda l, i: {'i': i, 'l': l})) AS u FROM scripts))"""


def oracle_sql():
    depth = "(length(l) - length(replace(l, '{o}', ''))) - (length(l) - length(replace(l, '{c}', '')))"
    parens = depth.format(o="(", c=")")
    every = " + ".join(f"({depth.format(o=o, c=c)})" for o, c in ("[]", "{}", "()"))
    starts = "|".join(scanners.TEST_IMPORTS).replace("^", "^\\s*")
    return {
        "parse_filter_json": """SELECT p_partkey, CASE p_partkey % 7 WHEN 2 THEN '{"x":{"y":' || p_partkey || '}}' WHEN 3 THEN '{"n":' || p_partkey || '}' WHEN 4 THEN '{"2":{"3":{"4":' || p_partkey || '}}}'
          WHEN 5 THEN NULL WHEN 6 THEN '[1,' || p_partkey || ']' ELSE '{"a":' || p_partkey || ',"b":[1,{"c":"}"}]}' END AS json FROM part""",
        "sanitize_script": f"""WITH RECURSIVE {_SCRIPTS}, walk(p_brand, i, d, drop) AS (
            SELECT p_brand, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM scripts
            UNION ALL SELECT w.p_brand, x.i, CASE WHEN w.d > 0 THEN w.d + {parens} WHEN regexp_matches(l, '{starts}') THEN {parens} ELSE 0 END, w.d > 0 OR regexp_matches(l, '{starts}')
            FROM walk w JOIN lines x ON x.p_brand = w.p_brand AND x.i = w.i + 1)
          SELECT p_brand, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT drop), '') AS script FROM walk JOIN lines USING (p_brand, i) GROUP BY p_brand""",
        "extract_constants": f"""WITH RECURSIVE {_SCRIPTS}, code AS (
            SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY i) AS i, l FROM lines WHERE trim(l) <> '' AND NOT regexp_matches(l, '^\\s*(#|class |def )')),
          walk(p_brand, i, d, take, closes) AS (
            SELECT p_brand, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, false FROM scripts
            UNION ALL SELECT w.p_brand, x.i, CASE WHEN w.d > 0 THEN greatest(w.d + {every}, 0) WHEN regexp_matches(l, '{scanners.CONSTANT}') THEN greatest({every}, 0) ELSE 0 END,
              w.d > 0 OR regexp_matches(l, '{scanners.CONSTANT}'), w.d > 0 AND w.d + {every} <= 0 FROM walk w JOIN code x ON x.p_brand = w.p_brand AND x.i = w.i + 1)
          SELECT p_brand, coalesce(string_agg(l || CASE WHEN closes THEN chr(10) ELSE '' END, chr(10) ORDER BY i) FILTER (take), '') AS constants FROM walk JOIN code USING (p_brand, i) GROUP BY p_brand""",
        "code_profile": """WITH n AS (SELECT p_brand, CAST(right(p_brand, 1) AS INTEGER) AS b, p_partkey AS k, p_size, p_partkey % 3 = 0 AS c FROM part),
          i AS (SELECT p_brand, array_to_string(list_slice(list_sort(list(DISTINCT 'pkg' || p_size)), 1, 15), ',') AS imports FROM n WHERE NOT c GROUP BY 1)
          SELECT p_brand, CAST(2 * count(*) + CASE WHEN b = 2 THEN 1 ELSE 0 END AS INTEGER) AS line_count, CASE WHEN b = 3 THEN 'rust' ELSE 'python' END AS programming_language,
            CASE WHEN b NOT IN (2, 3) THEN CAST(count(*) AS INTEGER) END AS function_count,
            CASE WHEN b NOT IN (2, 3) THEN array_to_string(list_slice(list_concat(coalesce(list('f' || k ORDER BY k) FILTER (NOT c), []), coalesce(list('m' ORDER BY k) FILTER (c), [])), 1, 10), ',') END AS function_names,
            CASE WHEN b NOT IN (2, 3) THEN CAST(count(*) FILTER (c) AS INTEGER) END AS class_count,
            CASE WHEN b NOT IN (2, 3) THEN array_to_string(list_slice(coalesce(list('C' || k ORDER BY k) FILTER (c), []), 1, 5), ',') END AS class_names,
            CASE b WHEN 3 THEN NULL WHEN 2 THEN 'broken' ELSE any_value(imports) END AS imports FROM n JOIN i USING (p_brand) GROUP BY p_brand, b""",
        "random_sample": """SELECT p_brand, p_partkey, CAST(r AS INTEGER) AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('13:' || p_partkey), p_partkey) AS r FROM part) WHERE r <= 3""",
    }
