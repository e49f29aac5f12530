"""Registered queries of dependencies, sections of answers, written files and small projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import sections
from weft.operators import dependencies as deps
from weft.operators import ranking
from weft.session import table
from weft.sources import files


def _key():
    return F.col("p_partkey").cast("string")


def _word():
    return F.element_at(F.split("p_name", " "), 1)


def _pick(values, n):
    return F.element_at(F.array(*values), (F.pmod("p_partkey", F.lit(n)) + 1).cast("int"))


def _skill_files(spark, d):
    """Five kinds of files of skills, which are brands."""
    paths = [F.lit(x) for x in ("requirements.txt", "dependencies.json", "SKILL.md", "scripts/run.py", "scripts/sub/x.py")]
    texts = [
        F.concat(F.lit("# c\n-r x\n"), _word(), F.lit("[a]>=1\n\n")), F.concat(F.lit('{"pip":["p'), F.col("p_size"), F.lit('"],"apt":["lib-'), _word(), F.lit('"]}')), F.concat(F.lit("Needs graphviz and "), _word()),
        F.concat(F.lit("import os, yaml\nfrom "), _word(), F.lit(".x import y\n")), F.lit("import never"),
    ]
    return table(spark, d, "part").select(F.col("p_brand").alias("skill"), F.concat(F.lit("/s/"), _pick(paths, 5)).alias("path"), _pick(texts, 5).alias("text"))


def skill_dependencies(spark, d):
    return deps.skill_dependencies(_skill_files(spark, d))


def env_dependencies(spark, d):
    """The packages that most skills need."""
    return deps.most_needed(deps.skill_dependencies(_skill_files(spark, d)), "skill")


def _run_steps(spark, d):
    commands = [F.concat(F.lit("pip install -q "), _word()), F.concat(F.lit("pip3 install --no-deps "), _word(), F.lit("==1 && mamba install -y -c forge rdkit")), F.concat(F.lit("apt-get install -y "), _word()), F.lit(None).cast("string")]
    content = F.when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("import json\nimport cv2\nx = (\nimport "), _word()))
    path = F.when(F.col("p_size") % 2 == 0, "/o/a.py").otherwise("/o/a.txt")
    return table(spark, d, "part").select(F.col("p_brand").alias("session"), _pick(commands, 4).alias("command"), path.alias("path"), content.alias("content"))


def run_dependencies(spark, d):
    return deps.run_dependencies(_run_steps(spark, d))


def install_commands(spark, d):
    return deps.install_commands(deps.run_dependencies(_run_steps(spark, d)), "session")


def runtime_dependencies(spark, d):
    """Part names as frozen packages; those of small parts, in upper case, were there before."""
    part = table(spark, d, "part")
    line = F.concat(_word(), F.lit("-"), F.pmod("p_partkey", F.lit(40)), F.when(F.col("p_size") % 3 == 0, " @ file").otherwise(" == 1.0==x"))
    return deps.runtime_dependencies(part.select(F.col("p_brand").alias("session"), line.alias("line")), part.where("p_size < 10").select(F.upper(line).alias("line")))


def section_extractors(spark, d):
    key = _key()
    answers = [
        F.concat(F.lit("x\n# synthesized  Task Instruction \n Do "), key, F.lit(" \n## Notes\nno")), F.concat(F.lit("## Task Instruction\nMake "), key, F.lit("\n\n## Execution Guide\n1. go\n## End")),
        F.concat(F.lit("**Goal**: Reach "), key, F.lit(" **Expected**: that\nthen")), F.concat(F.lit("Here:\n```python\ndef test_"), key, F.lit("(): pass\n```")), F.concat(F.lit("note\nimport os\ndef test_"), key, F.lit("(): pass")), F.concat(F.lit("  plain "), key, F.lit("  ")),
    ]
    text = _pick(answers, 6)
    goal = sections.goal_and_guide(text)
    return table(spark, d, "part").select("p_partkey", sections.task_instruction(text).alias("task"), goal["instruction"].alias("instruction"), goal["guide"].alias("guide"), sections.test_code(text).alias("code"))


def output_structure(spark, d):
    key = _key()
    paths = [F.lit(x) for x in ("/o/a.json", "/o/b.JSON", "/o/c.csv", "/o/d.md", "/o/e.txt", "/o/f.json", "/o/none")]
    texts = [F.concat(F.lit('{"b":1,"a'), key, F.lit('":2}')), F.lit("[1]"), F.concat(F.lit("x,y\n1,2\n"), key, F.lit("\n")), F.concat(F.lit("\n# T"), key, F.lit("\ntext\n## U\n")), F.concat(key, F.lit("\n\nb")), F.concat(F.lit("{"), key), key]
    s = table(spark, d, "part").select("p_partkey", sections.output_structure(_pick(paths, 7), _pick(texts, 7)).alias("s")).select("p_partkey", "s.*")
    return s.withColumns({c: F.array_join(c, ",") for c in ("keys", "header", "headers")})


def run_summary(spark, d):
    """A summary of each brand's parts as a run: a tool for each container size, a file for each part of the first sizes."""
    p = table(spark, d, "part").withColumn("tool", F.concat(F.lit("T"), F.pmod("p_size", F.lit(4))))
    tools = p.groupBy("p_brand", "tool").count().groupBy("p_brand").agg(F.collect_list(F.struct(F.col("tool").alias("name"), F.col("count").alias("n"))).alias("tools"), F.sum("count").alias("steps"))
    made = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.when(F.col("p_size") < 5, F.col("p_partkey")))).alias("made"), F.collect_list(F.when(F.col("p_size") == 50, F.col("p_partkey"))).alias("inputs"))
    names = F.transform("made", lambda k: F.concat(F.lit("f"), k.cast("string")))
    return tools.join(made, "p_brand").select("p_brand", sections.run_summary(F.col("p_brand"), F.col("steps"), F.size("made") > 5, F.col("tools"), names, F.col("inputs")).alias("summary"))


def limit_pending(spark, d):
    """The first hundred orders, by price, of customers that have none done."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return ranking.first_pending(o, o.select("o_custkey", "o_orderstatus"), ["o_custkey"], (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 2 == 0), 100, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey")


def project_evidence(spark, d):
    """Line items as alignments, the best of each supplier with its evidence."""
    li = table(spark, d, "lineitem")
    rows = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("alignment_id"), F.col("l_suppkey").alias("source_post_scenario_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_post_scenario"),
        F.col("l_partkey").alias("target_pre_scenario_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target_pre_scenario"), F.col("l_discount").alias("retrieval_score"), F.col("l_returnflag").alias("alignment_type"),
        F.col("l_linenumber").alias("confidence"), F.col("l_linestatus").alias("reason"),
    )
    best = rows.groupBy("source_post_scenario_id").agg(F.max_by(sections.edge_evidence(), F.struct("retrieval_score", "confidence", "alignment_id", "target_pre_scenario_id", "alignment_type", "reason")).alias("e"))
    return best.select("e.alignment_id", "e.source_post_scenario", "e.target_pre_scenario", "e.retrieval_score", "e.confidence")


def scenario_dim(spark, d):
    """Canonical texts of payloads, one for each brand; a part's text may come again."""
    item = F.concat(F.lit('{"scenario_id":'), F.pmod("p_partkey", F.lit(700)), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit(',"canonical_scenario":"'), F.lower("p_brand"), F.lit('"'))), F.lit("}"))
    p = table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.lit('{"scenarios":['), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit('],"skill_scenarios":[]}')).alias("t"))
    one = p.agg(F.min("t").alias("t"))
    return files.scenario_names(one, "t")


def queries():
    return {f.__name__: f for f in (
        skill_dependencies, env_dependencies, run_dependencies, install_commands, runtime_dependencies, section_extractors, output_structure, run_summary,
        limit_pending, project_evidence, scenario_dim,
    )}


_SKILLS = """parts AS (SELECT p_brand, split_part(p_name, ' ', 1) AS w, p_partkey % 5 AS k, p_size FROM part),
needs AS (SELECT DISTINCT p_brand AS skill, u.m AS manager, u.p AS package, u.s AS source FROM (SELECT p_brand, unnest(CASE k WHEN 0 THEN [{'m': 'pip', 'p': w || '[a]', 's': 'skill_requirements'}]
    WHEN 1 THEN [{'m': 'pip', 'p': 'p' || p_size, 's': 'skill_dependencies_json'}, {'m': 'apt', 'p': 'lib-' || w, 's': 'skill_dependencies_json'}] WHEN 2 THEN [{'m': 'apt', 'p': 'graphviz', 's': 'skill_md_analysis'}]
    WHEN 3 THEN [{'m': 'pip', 'p': 'PyYAML', 's': 'skill_requirements'}, {'m': 'pip', 'p': w, 's': 'skill_requirements'}] ELSE [] END) AS u FROM parts))"""
_RUNS = """parts AS (SELECT p_brand, split_part(p_name, ' ', 1) AS w, p_partkey % 4 AS k, p_size FROM part),
needs AS (SELECT DISTINCT p_brand AS session, u.m AS manager, u.p AS package, u.s AS source FROM (SELECT p_brand, unnest(CASE
    WHEN k = 1 THEN [{'m': 'pip', 'p': w || '==1', 's': 'trajectory_commands'}, {'m': 'conda', 'p': 'rdkit', 's': 'trajectory_commands'}] WHEN k = 2 THEN [{'m': 'apt', 'p': w, 's': 'trajectory_commands'}]
    WHEN k = 3 AND p_size % 2 = 0 THEN [{'m': 'pip', 'p': 'opencv-python', 's': 'trajectory_imports'}, {'m': 'pip', 'p': w, 's': 'trajectory_imports'}] ELSE [] END) AS u FROM parts))"""


def oracle_sql():
    command = "CASE WHEN count(*) FILTER (manager = '{m}') = 0 THEN '' ELSE '{c}' || array_to_string(list_sort(list(DISTINCT package) FILTER (manager = '{m}')), ' ') END AS {m}"
    return {
        "skill_dependencies": f"WITH {_SKILLS} SELECT * FROM needs",
        "env_dependencies": f"WITH {_SKILLS} SELECT manager, package, count(DISTINCT skill) AS owners FROM needs GROUP BY 1, 2 ORDER BY owners DESC, package, manager LIMIT 10",
        "run_dependencies": f"WITH {_RUNS} SELECT * FROM needs",
        "install_commands": f"WITH {_RUNS} SELECT session, {', '.join(command.format(m=m, c=c) for m, c in deps.INSTALLERS.items())} FROM needs GROUP BY session",
        "runtime_dependencies": """WITH x AS (SELECT p_brand, p_size, split_part(p_name, ' ', 1) || '-' || (p_partkey % 40) AS n FROM part WHERE p_size % 3 <> 0)
          SELECT DISTINCT p_brand AS session, 'pip' AS manager, n AS package, 'runtime_freeze' AS source FROM x WHERE n NOT IN (SELECT n FROM x WHERE p_size < 10)""",
        "section_extractors": r"""WITH a AS (SELECT p_partkey, p_partkey % 6 AS k, CAST(p_partkey AS VARCHAR) AS n FROM part), t AS (SELECT *, CASE k
            WHEN 0 THEN 'x' || chr(10) || '# synthesized  Task Instruction ' || chr(10) || ' Do ' || n || ' ' || chr(10) || '## Notes' || chr(10) || 'no' WHEN 1 THEN '## Task Instruction' || chr(10) || 'Make ' || n || chr(10) || chr(10) || '## Execution Guide' || chr(10) || '1. go' || chr(10) || '## End'
            WHEN 2 THEN '**Goal**: Reach ' || n || ' **Expected**: that' || chr(10) || 'then' WHEN 3 THEN 'Here:' || chr(10) || '```python' || chr(10) || 'def test_' || n || '(): pass' || chr(10) || '```'
            WHEN 4 THEN 'note' || chr(10) || 'import os' || chr(10) || 'def test_' || n || '(): pass' ELSE 'plain ' || n END AS t FROM a)
          SELECT p_partkey, CASE k WHEN 0 THEN 'Do ' || n || ' ' || chr(10) || '#' ELSE t END AS task, CASE k WHEN 1 THEN 'Make ' || n WHEN 2 THEN 'Reach ' || n ELSE t END AS instruction,
            CASE k WHEN 1 THEN '1. go' WHEN 2 THEN '**Expected**: that' || chr(10) || 'then' ELSE '' END AS guide,
            CASE k WHEN 3 THEN 'def test_' || n || '(): pass' WHEN 4 THEN 'import os' || chr(10) || 'def test_' || n || '(): pass' END AS code FROM t""",
        "output_structure": """WITH a AS (SELECT p_partkey, CAST(p_partkey % 7 AS INTEGER) AS k, CAST(p_partkey AS VARCHAR) AS n FROM part)
          SELECT p_partkey, (['json', 'json', 'csv', 'md', 'txt', 'json', ''])[k + 1] AS extension, CAST(CASE k WHEN 0 THEN 13 + length(n) WHEN 1 THEN 3 WHEN 2 THEN 9 + length(n) WHEN 3 THEN 15 + length(n) WHEN 4 THEN 3 + length(n) WHEN 5 THEN 1 + length(n) ELSE length(n) END AS INTEGER) AS content_length,
            CASE WHEN k IN (0, 1) THEN true WHEN k = 5 THEN false END AS valid_json, CASE k WHEN 0 THEN false WHEN 1 THEN true END AS is_array, CASE k WHEN 0 THEN 'b,a' || n END AS keys,
            CASE k WHEN 2 THEN 'x,y' END AS header, CASE k WHEN 2 THEN 2 END AS row_count, CASE k WHEN 3 THEN 3 WHEN 4 THEN 3 END AS line_count, CASE k WHEN 3 THEN '# T' || n || ',## U' END AS headers FROM a""",
        "run_summary": """WITH t AS (SELECT p_brand, string_agg('T' || k || ':' || n, ', ' ORDER BY k) AS tools, CAST(sum(n) AS BIGINT) AS steps FROM (SELECT p_brand, p_size % 4 AS k, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1),
          m AS (SELECT p_brand, count(*) FILTER (p_size < 5) AS n, count(*) FILTER (p_size = 50) AS i, list('f' || p_partkey ORDER BY p_partkey) FILTER (p_size < 5) AS f FROM part GROUP BY 1)
          SELECT p_brand, 'Session: ' || p_brand || chr(10) || 'Steps: ' || steps || chr(10) || 'Success: ' || CASE WHEN n > 5 THEN 'True' ELSE 'False' END || chr(10) || 'Tools used: ' || tools
            || CASE WHEN n > 0 THEN chr(10) || 'Files created: ' || n || array_to_string(list_transform(f[1:5], lambda x: chr(10) || '  - ' || x), '') || CASE WHEN n > 5 THEN chr(10) || '  ... and ' || (n - 5) || ' more' ELSE '' END ELSE '' END
            || CASE WHEN i > 0 THEN chr(10) || 'Input files: ' || i ELSE '' END AS summary FROM t JOIN m USING (p_brand)""",
        "limit_pending": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
        "project_evidence": """SELECT l_orderkey * 10 + l_linenumber AS alignment_id, 's' || l_suppkey AS source_post_scenario, 'p' || l_partkey AS target_pre_scenario, l_discount AS retrieval_score, l_linenumber AS confidence FROM lineitem
          QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_linenumber DESC, l_orderkey DESC, l_partkey DESC) = 1""",
        "scenario_dim": """WITH b AS (SELECT arg_min(p_brand, t) AS b FROM (SELECT p_brand, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT p_brand, '{"scenario_id":' || (p_partkey % 700) || CASE WHEN p_size % 5 = 0 THEN '' ELSE ',"canonical_scenario":"' || lower(p_brand) || '"' END || '}' AS t FROM part) GROUP BY 1)),
          r AS (SELECT p_partkey % 700 AS i, CASE WHEN p_size % 5 = 0 THEN '' ELSE lower(p_brand) END AS c, '{"scenario_id":' || (p_partkey % 700) || CASE WHEN p_size % 5 = 0 THEN '' ELSE ',"canonical_scenario":"' || lower(p_brand) || '"' END || '}' AS t FROM part, b WHERE p_brand = b)
          SELECT i AS scenario_id, arg_max(c, t) AS canonical_scenario FROM r GROUP BY i""",
    }
