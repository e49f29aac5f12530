"""Registered queries of event logs, task graphs, gates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import scalars as s
from weft.operators import trajectory as t
from weft.session import materialize, table
from weft.streaming import events as stream

TOOLS = ("Read", "Write", "Bash", "Skill", "WebFetch", "TodoWrite", "Other")


def _steps(spark, d):
    """Events as tool uses: a session per user, the tool by the event's number."""
    e = table(spark, d, "events")
    tool = F.element_at(F.array(*[F.lit(x) for x in TOOLS]), (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    return t.number_steps(e.withColumn("tool", tool), "user_id", "event_id", F.col("event_type").isNotNull()).select("user_id", "event_id", "step_id", "tool", "event_type", "value")


def _nodes(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").cast("long").alias("node")).distinct()


def _dag(spark, d):
    """A task graph per order: an item hands work to a later one, by its part; acyclic by construction."""
    li, a = table(spark, d, "lineitem"), F.col("l_linenumber").cast("long")
    edges = li.select(F.col("l_orderkey").alias("task"), a.alias("source"), (a + 1 + F.pmod("l_partkey", F.lit(3))).alias("target")).distinct()
    return edges.join(_nodes(spark, d).withColumnRenamed("node", "target"), ["task", "target"], "left_semi").select("task", "source", "target")


def pair_tool_results(spark, d):
    c = table(spark, d, "conversations")
    return t.pair_results(c, "conv_id", "turn", F.col("role") == "assistant", F.col("role") == "user", "text")


def record_trajectory(spark, d):
    c = table(spark, d, "conversations")
    return t.number_steps(c, "conv_id", "turn", (F.col("role") == "assistant") & (F.trim("text") != "")).select("conv_id", "turn", "step_id")


def tool_usage(spark, d):
    return t.tool_usage(_steps(spark, d), "user_id", "tool")


def tool_usage_by_category(spark, d):
    out = t.tools_by_category(_steps(spark, d), "user_id", "tool", "event_id")
    return out.withColumn("tools", F.array_join("tools", ","))


def trajectory_summary(spark, d):
    return t.summary(_steps(spark, d), "user_id", "tool")


def validate_trajectory(spark, d):
    """Customers' events as runs: purchases are texts, some of them on errors; those with few points have failed."""
    text = F.when(F.col("event_id") % 50 == 0, "An Error: x").when(F.col("event_id") % 50 == 1, "we Failed to go").otherwise("fine")
    steps = _steps(spark, d).select(F.col("user_id").cast("long").alias("user_id"), "step_id", F.when(F.col("event_type") == "purchase", "text").otherwise("tool_use").alias("action"), "tool", text.alias("text"))
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), F.when(F.col("c_acctbal") > 5000, None).otherwise(F.col("c_acctbal") > 0).alias("success"), (F.col("c_custkey") % 4).alias("outputs"))
    v = t.validate(c, steps, "user_id", 3)
    return v.select("user_id", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), "valid")


def clip_middle_steps(spark, d):
    return t.clip_middle(_steps(spark, d), "user_id", 20)


def no_progress_run(spark, d):
    """Different event types seen by each user so far, and how long nothing new came."""
    e = table(spark, d, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("user_id", "event_id", F.lit(1).alias("new"))
    from pyspark.sql import Window

    tested = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("user_id").orderBy("event_id"))
    progress = e.join(first, ["user_id", "event_id"], "left").select("user_id", "event_id", tested.alias("tested"))
    return t.no_progress_run(progress, "user_id", "event_id", "tested")


def coverage_ratio(spark, d):
    docs, labels = table(spark, d, "documents").select("source", "doc_id"), table(spark, d, "labels").where("quality = 1").select("doc_id")
    return t.coverage_ratio(docs, docs.join(labels, "doc_id"), "source", "doc_id")


def retrieval_metrics(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return t.retrieval_metrics(docs.where("n_chars > 1500"), docs.where("quality = 1"), "source", "doc_id")


def source_sink_nodes(spark, d):
    return t.ends(_dag(spark, d), "task")


def all_paths(spark, d):
    return t.all_paths(_dag(spark, d), "task", _nodes(spark, d)).select("task", F.array_join("path", ">").alias("path"))


def topological_order(spark, d):
    """Task graphs whose nodes are renamed so that edges lead to smaller and larger ones."""
    renamed = _dag(spark, d).select("task", *[F.pmod(F.col(c) * 5, F.lit(11)).alias(c) for c in ("source", "target")])
    return t.topological_order(renamed, "task")


def dag_coverage(spark, d):
    """Path, edge and core-function coverage of task graphs: tested are paths through node 3 and unknown ones, edges with an even end; functions are items of parts."""
    edges, nodes = _dag(spark, d), _nodes(spark, d)
    paths = materialize(t.all_paths(edges, "task", nodes).select("task", F.array_join("path", ">").alias("item")))
    some = paths.where(F.concat(F.lit(">"), "item", F.lit(">")).contains(">3>")).unionByName(nodes.where("node = 7").select("task", F.lit("own").alias("item")))
    e = edges.select("task", F.concat_ws(">", "source", "target").alias("item"), "target")
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("skill"), F.pmod("l_partkey", F.lit(9)).cast("string").alias("item"), "l_quantity")
    return t.dag_coverage(paths, some, e, e.where("target % 2 = 0"), f, f.where("l_quantity > 25"), "task")


def pytest_summary(spark, d):
    o = table(spark, d, "orders")
    text = F.format_string("==== %d passed, %d failed, %d skipped in %d.5s ====", F.pmod("o_custkey", F.lit(9)), F.pmod("o_orderkey", F.lit(3)), F.pmod("o_custkey", F.lit(2)), F.pmod("o_orderkey", F.lit(100)))
    runs = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", text).otherwise("no tests ran").alias("text"), F.pmod("o_orderkey", F.lit(2)).alias("code"))
    return t.pytest_summary(runs, "text", "code").drop("text", "code")


def text_profile(spark, d):
    """Lines, words and headings of every text."""
    x = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.size(F.split(x, "\n")).alias("lines"), F.size(F.regexp_extract_all(x, F.lit(r"[^ \t\n\r\f\x0B]+"), 0)).alias("words"),
        F.size(F.filter(F.split(x, "\n"), lambda ln: ln.rlike("^#+ "))).alias("headings"), F.contains(x, F.lit("```")).alias("has_code"),
    )


def json_profile(spark, d):
    """Top-level keys of every event's properties."""
    e = table(spark, d, "events")
    return e.select(F.explode(F.json_object_keys("props")).alias("key"), "event_type").groupBy("key", "event_type").agg(F.count(F.lit(1)).alias("n"))


def content_type_groups(spark, d):
    """Documents of each source by the kind of their content."""
    docs = table(spark, d, "documents").select("source", s.classify_content(F.col("text"), F.col("source")).alias("content"))
    return docs.groupBy("source", "content").agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark, d):
    return stream.run_available(stream.window_counts(stream.read_events(spark, d), late=None), "update").groupBy("start", "event_type").agg(
        F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total")
    )


def exploration_state(spark, d):
    rows = stream.run_available(stream.exploration_state(stream.read_events(spark, d)), "update")
    last = rows.groupBy("user_id").agg(*[F.max_by(c, "batch").alias(c) for c in ("chunks", "tested", "last_new")])
    return stream.idle_runs(last, table(spark, d, "events"))


def queries():
    return {f.__name__: f for f in (
        pair_tool_results, record_trajectory, tool_usage, tool_usage_by_category, trajectory_summary, validate_trajectory, clip_middle_steps, no_progress_run,
        coverage_ratio, retrieval_metrics, source_sink_nodes, all_paths, topological_order, dag_coverage, pytest_summary, text_profile,
        json_profile, content_type_groups, event_windows, exploration_state,
    )}


_TOOL = "(['" + "', '".join(TOOLS) + "'])[CAST(event_id % 7 AS INTEGER) + 1]"
_STEPS = f"""steps AS (SELECT user_id, event_id, {_TOOL} AS tool, event_type, value,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS step_id FROM events WHERE event_type IS NOT NULL)"""
_CATEGORY = "CASE " + " ".join(f"WHEN tool IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in s.TOOL_CATEGORIES.items()) + " ELSE 'other' END"
_DAG = """nodes AS (SELECT DISTINCT l_orderkey AS task, CAST(l_linenumber AS BIGINT) AS node FROM lineitem),
 dag AS (SELECT DISTINCT task, CAST(l_linenumber AS BIGINT) AS source, node AS target FROM lineitem JOIN nodes ON task = l_orderkey AND node = l_linenumber + 1 + l_partkey % 3),
 ends AS (SELECT task, node, sum(i) = 0 AS is_source, sum(o) = 0 AS is_sink FROM (SELECT task, source AS node, 1 AS o, 0 AS i FROM dag UNION ALL SELECT task, target, 0, 1 FROM dag) GROUP BY 1, 2)"""
_SUMMARY = """SELECT user_id, count(*) AS steps, count(DISTINCT tool) AS tools, count(*) FILTER (tool IN ('Read', 'Glob', 'Grep')) AS reads,
  count(*) FILTER (tool IN ('Write', 'Edit', 'NotebookEdit')) AS writes, count(*) FILTER (tool = 'Bash') AS commands, count(*) FILTER (tool = 'Skill') AS skills,
  count(*) FILTER (tool IN ('WebFetch', 'WebSearch')) AS web FROM steps"""


def _content(column):
    def some(words):
        return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"

    return f"CASE WHEN {some(s.FORM_WORDS)} THEN 'form' WHEN {some(s.TABLE_WORDS)} THEN 'table' WHEN {some(s.CODE_WORDS)} THEN 'code' ELSE 'text' END"


def oracle_sql():
    return {
        "pair_tool_results": """WITH n AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS action FROM conversations)
            SELECT conv_id, CAST(action AS BIGINT) AS action, arg_min(text, turn) FILTER (role = 'assistant') AS input, arg_min(text, turn) FILTER (role = 'user') AS output FROM n WHERE action > 0 GROUP BY 1, 2""",
        "record_trajectory": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS step_id FROM conversations WHERE role = 'assistant' AND trim(text) <> ''",
        "tool_usage": f"WITH {_STEPS} SELECT user_id, tool, count(*) AS uses FROM steps GROUP BY 1, 2",
        "tool_usage_by_category": f"""WITH {_STEPS}, f AS (SELECT user_id, {_CATEGORY} AS category, tool, min(event_id) AS o FROM steps GROUP BY 1, 2, 3)
            SELECT user_id, category, array_to_string(list(tool ORDER BY o), ',') AS tools FROM f GROUP BY 1, 2""",
        "trajectory_summary": f"WITH {_STEPS} {_SUMMARY} GROUP BY user_id",
        "validate_trajectory": f"""WITH {_STEPS}, x AS (SELECT CAST(user_id AS BIGINT) AS user_id, step_id, event_type = 'purchase' AS is_text, tool, event_id % 50 AS k FROM steps),
            g AS (SELECT user_id, count(*) AS n, count(*) FILTER (NOT is_text) AS uses, count(*) FILTER (NOT is_text AND tool IN ('Write', 'Edit', 'NotebookEdit')) AS writes,
              coalesce(list('Potential error detected in step ' || step_id ORDER BY step_id) FILTER (is_text AND k < 2), []) AS wrong FROM x GROUP BY user_id),
            j AS (SELECT CAST(c_custkey AS BIGINT) AS user_id, coalesce(c_acctbal > 0 AND c_acctbal <= 5000, false) AS success, c_custkey % 4 AS outputs, coalesce(n, 0) AS n, coalesce(uses, 0) AS uses, coalesce(writes, 0) AS writes, coalesce(wrong, []) AS wrong
              FROM customer LEFT JOIN g ON g.user_id = c_custkey),
            m AS (SELECT user_id, list_filter([CASE WHEN n < 3 THEN 'Trajectory has ' || n || ' steps, minimum is 3' END, CASE WHEN outputs = 0 AND writes = 0 THEN 'No output files or write operations found' END,
                CASE WHEN uses = 0 THEN 'No tool use operations found' END, CASE WHEN n = 0 THEN 'Trajectory is empty' END], lambda e: e IS NOT NULL) AS errors,
              list_concat(list_filter([CASE WHEN NOT success THEN 'Trajectory execution was not successful' END, CASE WHEN n BETWEEN 1 AND 2 THEN 'Trajectory has very few steps' END], lambda w: w IS NOT NULL), wrong) AS warnings FROM j)
            SELECT user_id, array_to_string(errors, '|') AS errors, array_to_string(warnings, '|') AS warnings, len(errors) = 0 AS valid FROM m""",
        "clip_middle_steps": f"""WITH {_STEPS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM steps)
            SELECT user_id, step_id, CAST(NULL AS VARCHAR) AS note FROM n WHERE n <= 20 OR step_id < 10 OR step_id >= n - 10
            UNION ALL SELECT user_id, 10, (n - 20) || ' steps left out' FROM n WHERE n > 20 AND step_id = 0""",
        "no_progress_run": """WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2),
            p AS (SELECT e.user_id, e.event_id, CAST(sum(CASE WHEN f.event_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS BIGINT) AS tested
              FROM events e LEFT JOIN f ON f.user_id = e.user_id AND f.event_id = e.event_id),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, tested ORDER BY event_id) - 1 AS INTEGER) AS no_progress FROM p)
            SELECT user_id, event_id, tested, no_progress, no_progress < 3 AS go_on FROM r""",
        "coverage_ratio": """SELECT source, count(*) AS documented, count(quality) AS tested, round(count(quality) / count(*), 6) AS coverage
            FROM documents LEFT JOIN (SELECT * FROM labels WHERE quality = 1) USING (doc_id) GROUP BY source""",
        "retrieval_metrics": """WITH x AS (SELECT source, n_chars > 1500 AS p, quality = 1 AS g FROM documents JOIN labels USING (doc_id)),
            y AS (SELECT source, count(*) FILTER (p) AS p, count(*) FILTER (g) AS g, count(*) FILTER (p AND g) AS hit FROM x WHERE p OR g GROUP BY source)
            SELECT source, CASE WHEN p > 0 THEN round(hit / p, 6) ELSE 0.0 END AS precision, CASE WHEN g > 0 THEN round(hit / g, 6) ELSE 1.0 END AS recall, hit = g AS complete FROM y""",
        "source_sink_nodes": f"WITH {_DAG} SELECT * FROM ends",
        "all_paths": f"""WITH RECURSIVE {_DAG}, walk(task, node, path, n) AS (
              SELECT task, node, CAST(node AS VARCHAR), 1 FROM ends WHERE is_source
              UNION ALL SELECT w.task, g.target, w.path || '>' || g.target, n + 1 FROM walk w JOIN dag g ON g.task = w.task AND g.source = w.node)
            SELECT w.task, path FROM walk w JOIN ends e ON e.task = w.task AND e.node = w.node AND e.is_sink WHERE n > 1
            UNION ALL SELECT task, CAST(node AS VARCHAR) FROM nodes WHERE task NOT IN (SELECT task FROM dag)""",
        "topological_order": f"""WITH RECURSIVE {_DAG}, g AS (SELECT task, source * 5 % 11 AS a, target * 5 % 11 AS b FROM dag), n AS (SELECT task, node * 5 % 11 AS node FROM ends),
          walk(task, placed) AS (SELECT DISTINCT task, CAST([] AS BIGINT[]) FROM n
            UNION ALL SELECT w.task, list_append(any_value(w.placed), min(n.node)) FROM walk w JOIN n ON n.task = w.task AND NOT list_contains(w.placed, n.node)
              LEFT JOIN g ON g.task = w.task AND g.b = n.node AND NOT list_contains(w.placed, g.a) WHERE g.a IS NULL GROUP BY w.task),
          whole AS (SELECT task, arg_max(placed, len(placed)) AS placed FROM walk GROUP BY task)
          SELECT task, CAST(i - 1 AS INTEGER) AS place, placed[i] AS node FROM (SELECT task, placed, unnest(range(1, len(placed) + 1)) AS i FROM whole)""",
        "dag_coverage": f"""WITH RECURSIVE {_DAG}, walk(task, node, path) AS (SELECT task, node, CAST(node AS VARCHAR) FROM ends WHERE is_source
              UNION ALL SELECT w.task, g.target, w.path || '>' || g.target FROM walk w JOIN dag g ON g.task = w.task AND g.source = w.node),
            paths AS (SELECT w.task, w.path FROM walk w JOIN ends e ON e.task = w.task AND e.node = w.node AND e.is_sink UNION ALL SELECT task, CAST(node AS VARCHAR) FROM nodes WHERE task NOT IN (SELECT task FROM ends)),
            p AS (SELECT task, count(*) AS p, count(DISTINCT path) FILTER (contains('>' || path || '>', '>3>')) AS tp FROM paths GROUP BY 1), own AS (SELECT DISTINCT task FROM nodes WHERE node = 7),
            e AS (SELECT task, count(*) AS e, count(*) FILTER (target % 2 = 0) AS te FROM dag GROUP BY 1),
            f AS (SELECT l_orderkey AS task, l_linenumber AS skill, l_partkey % 9 AS item, l_quantity > 25 AS hit FROM lineitem),
            ff AS (SELECT task, sum(n) AS f, count(*) FILTER (h) AS tf FROM (SELECT task, skill, item, count(*) AS n, bool_or(hit) AS h FROM f GROUP BY 1, 2, 3) GROUP BY 1)
            SELECT ff.task, round((tp + CASE WHEN own.task IS NULL THEN 0 ELSE 1 END) / p, 6) AS path_coverage, CASE WHEN e IS NULL THEN 1.0 ELSE round(te / e, 6) END AS edge_coverage, round(tf / f, 6) AS core_function_coverage
            FROM ff JOIN p USING (task) LEFT JOIN e USING (task) LEFT JOIN own ON own.task = ff.task""",
        "pytest_summary": """WITH x AS (SELECT *, o_orderstatus <> 'P' AS ran FROM orders), y AS (SELECT o_orderkey, CAST(CASE WHEN ran THEN o_custkey % 9 ELSE 0 END AS INTEGER) AS passed,
              CAST(CASE WHEN ran THEN o_orderkey % 3 ELSE 0 END AS INTEGER) AS failed, 0 AS errors, CAST(CASE WHEN ran THEN o_custkey % 2 ELSE 0 END AS INTEGER) AS skipped,
              CASE WHEN ran THEN o_orderkey % 100 + 0.5 ELSE 0 END::DOUBLE AS duration, o_orderkey % 2 AS code FROM x)
            SELECT o_orderkey, passed, failed, errors, skipped, passed + failed + errors + skipped AS total, duration,
              CASE WHEN passed + failed + skipped = 0 THEN 0.0 ELSE round(passed / (passed + failed + skipped), 6) END AS success_rate, code = 0 AND passed > 0 AND failed = 0 AS all_passed FROM y""",
        "text_profile": r"""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS INTEGER) AS words,
            CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#+ '))) AS INTEGER) AS headings, contains(text, '```') AS has_code FROM documents""",
        "json_profile": "SELECT key, event_type, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key, event_type FROM events) GROUP BY 1, 2",
        "content_type_groups": f"SELECT source, {_content('text')} AS content, count(*) AS n FROM documents GROUP BY 1, 2",
        "event_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "exploration_state": """WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2), l AS (SELECT user_id, max(first) AS last_new, count(*) AS tested FROM f GROUP BY 1)
            SELECT e.user_id, CAST(count(*) AS INTEGER) AS chunks, CAST(any_value(tested) AS INTEGER) AS tested, CAST(count(*) FILTER (event_id > last_new) AS INTEGER) AS idle FROM events e JOIN l USING (user_id) GROUP BY 1""",
    }
