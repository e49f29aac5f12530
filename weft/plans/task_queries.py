"""Registered queries of tool uses, task records, entities and parsers, over whole given tables.

Events are steps of a session (the user): the tool by the event's number, its file by type
and number. Orders are tasks: their line items are skills, parts their names, and each item
hands work to the next one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import parsers as p
from weft.operators import tasks as t
from weft.operators import tools, trajectory
from weft.plans import trajectory_queries as tq
from weft.session import table

_TOOLS = [name for name, _, _ in tools.OPERATIONS]
_LIST = "['" + "', '".join(_TOOLS) + "']"
_FIELDS = "['" + "', '".join(field for _, field, _ in tools.OPERATIONS) + "']"


def _steps(spark, d):
    e = table(spark, d, "events")
    at = (F.pmod("event_id", F.lit(len(_TOOLS))) + 1).cast("int")
    tool, field = (F.element_at(F.array(*[F.lit(x) for x in xs]), at) for xs in (_TOOLS, [f for _, f, _ in tools.OPERATIONS]))
    n = F.pmod(F.floor(F.col("event_id") / 10), F.lit(9)).cast("string")
    path = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/x/skills/"), "event_type", n, F.lit("/SKILL.md")))
        .when(F.col("event_id") % 7 == 0, F.concat(F.lit("/root/output/"), "event_type"))
        .when(F.col("event_id") % 11 == 0, "")
        .otherwise(F.concat(F.lit("/work/"), "event_type", n, F.when(F.col("event_id") % 2 == 0, ".txt").otherwise("")))
    )
    return e.select("user_id", "event_id", tool.alias("tool_name"), F.create_map(field, path).alias("tool_input"), path.alias("path"))


_STEPS_SQL = f"""steps AS (SELECT user_id, event_id, {_LIST}[event_id % {len(_TOOLS)} + 1] AS tool_name,
  CASE WHEN event_id % 3 = 0 THEN '/x/skills/' || event_type || (event_id // 10) % 9 || '/SKILL.md'
    WHEN event_id % 7 = 0 THEN '/root/output/' || event_type WHEN event_id % 11 = 0 THEN ''
    ELSE '/work/' || event_type || (event_id // 10) % 9 || CASE WHEN event_id % 2 = 0 THEN '.txt' ELSE '' END END AS path FROM events),
kinds(tool_name, kind) AS (VALUES {", ".join(f"('{n}', '{k}')" for n, _, ks in tools.OPERATIONS for k in ks)}),
operations AS (SELECT user_id, event_id, kind, path AS value FROM steps JOIN kinds USING (tool_name) WHERE path <> '')"""


def track_tool_operation(spark, d):
    return tools.track_operations(_steps(spark, d), "user_id", "event_id")


def filter_outputs(spark, d):
    return tools.filtered_files(track_tool_operation(spark, d), "user_id")


def file_operations(spark, d):
    return tools.file_operations(_steps(spark, d), "user_id", "event_id")


def used_skills(spark, d):
    return tools.used_skills(track_tool_operation(spark, d), "user_id", ("view1", "click2"))


def loop_summary(spark, d):
    """A loop per hundred events of a user."""
    ops = track_tool_operation(spark, d).withColumn("loop", F.floor(F.col("event_id") / 100))
    out = tools.loop_summary(ops, ["user_id", "loop"], "event_id")
    return out.select("user_id", "loop", *[F.array_join(c, ",").alias(c) for c in ("reads", "writes", "edits")])


def pair_by_tool_use_id(spark, d):
    """Conversation turns as uses and results: a turn is answered by a later one of the same parity."""
    c = table(spark, d, "conversations").withColumn("use", (F.col("turn") % 2).cast("int"))
    uses = c.where("role = 'assistant'").select("conv_id", "use", "turn")
    return tools.pair_by_use(uses, c.where("role = 'user'"), "conv_id", "use", "turn", "text")


def tool_lists(spark, d):
    """How many files each session made, commands it ran, pages it read and patterns it searched."""
    ops = track_tool_operation(spark, d)
    counts = {"created": ("output",), "commands": ("command",), "web": ("url", "query"), "patterns": ("glob", "grep")}
    return ops.groupBy("user_id").agg(*[F.count_if(F.col("kind").isin(*kinds)).alias(name) for name, kinds in counts.items()])


def empty_trajectory(spark, d):
    """Customers with the number of their events, none included."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("user_id"))
    return tools.empty_sessions(c, table(spark, d, "events").select(F.col("user_id").cast("long").alias("user_id")), "user_id")


def last_text_block(spark, d):
    c = table(spark, d, "conversations")
    return tools.last_text(c.where("role = 'assistant'"), "conv_id", "turn", "text", ["Summary:", "The"], "none")


def step_preview(spark, d):
    e = table(spark, d, "events")
    return tools.step_preview(e, "user_id", "event_id", "props", "event_type")


def _skills(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("id"), F.col("l_linenumber").cast("int").alias("ord"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return li.join(names, "id")


def _connections(spark, d):
    """Each item hands work to the next line number; every third one has no brackets, every fifth no arrow."""
    s = _skills(spark, d)
    a = s.select("task", F.col("name").alias("a"), (F.col("ord") + 1).alias("ord"))
    b = s.select("task", F.col("name").alias("b"), "ord")
    bracket = F.when(F.col("task") % 3 == 0, "").otherwise(" (table, text)")
    arrow = F.when((F.col("task") + F.col("ord")) % 5 == 0, " and ").otherwise(" -> ")
    return a.join(b, ["task", "ord"]).select("task", "ord", F.concat("a", arrow, "b", bracket).alias("connection"))


_SKILLS_SQL = """skills AS (SELECT l_orderkey AS task, l_partkey AS id, CAST(l_linenumber AS INTEGER) AS ord, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
links AS (SELECT a.task, b.ord, a.name AS a, b.name AS b, (a.task + b.ord) % 5 <> 0 AS told FROM skills a JOIN skills b ON a.task = b.task AND b.ord = a.ord + 1),
led AS (SELECT DISTINCT task, b AS name FROM links WHERE told),
marked AS (SELECT task, id, name, name IN (SELECT l.name FROM led l WHERE l.task = s.task) AS led FROM skills s),
roots AS (SELECT task, id, name FROM (SELECT *, bool_and(led) OVER (PARTITION BY task) AS none FROM marked) WHERE NOT led OR none)"""


def parse_connection(spark, d):
    c = p.parse_connection(F.col("connection"))
    return _connections(spark, d).select("task", "ord", c["source"].alias("source"), c["target"].alias("target"))


def upstream_roots(spark, d):
    return t.upstream_roots(_skills(spark, d), _connections(spark, d), "task")


def infer_entity_skill(spark, d):
    """An entity per line item: every other one names a part, every fourth only its key's neighbour."""
    s = _skills(spark, d)
    e = s.select(
        "task", "ord", F.when(F.col("id") % 2 == 0, F.col("id")).when(F.col("id") % 4 == 1, F.col("id") + 1).alias("for_id"), F.when(F.col("id") % 3 == 0, F.col("name")).alias("for_name")
    )
    return t.infer_entity_skill(e, s, _connections(spark, d), "task", "ord")


def node_list(spark, d):
    """Names of an order's parts in order of its lines; parts of a size over 45 are not known."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    nodes = table(spark, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    out = t.node_list(li.select("task", F.transform("x", lambda x: x["l_partkey"]).alias("ids")), nodes, "task", "ids")
    return out.select("task", F.array_join("names", "|").alias("names"))


def task_item_keys(spark, d):
    li = table(spark, d, "lineitem")
    word = F.when(F.col("l_linenumber") == 2, "x").otherwise(F.pmod("l_partkey", F.lit(4)).cast("string"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", word.alias("w")))).alias("x"))
    keys = t.item_keys(F.transform("x", lambda x: x["w"]))
    return rows.select("l_orderkey", F.array_join(keys.cast("array<string>"), ",").alias("keys"))


def record_key(spark, d):
    g = table(spark, d, "pages")
    given = F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).otherwise("")
    return g.select("page_id", t.record_key(given, (F.col("page_id") % 10).cast("string"), F.col("url"), F.length("html").cast("string")).alias("key"))


def limited_edge_evidence(spark, d):
    """Suppliers' evidence of an order's lines: three of a line, twelve in all."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.transform(F.sequence(F.lit(1), (F.col("l_quantity") / 10 + 1).cast("int")), lambda i: F.concat_ws(":", "l_suppkey", i)).alias("e"))
    return t.limited_evidence(li, "l_orderkey", "l_linenumber", "e")


def entities_in_tasks(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("task"))
    tasks = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("long").alias("task"))
    return t.entities_in_tasks(e, tasks, "task")


def join_manifest(spark, d):
    """Pages' folders with the suppliers as a manifest; two thirds have a row, some without a name."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("/skills/s"), "page_id").alias("local_path"))
    s = table(spark, d, "supplier")
    m = s.where("s_suppkey % 3 <> 0").select(
        F.concat(F.lit("/skills/s"), F.pmod("s_suppkey", F.lit(150))).alias("local_path"), F.col("s_suppkey").cast("long").alias("ord"),
        F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name")).alias("skill_name"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey").cast("long")).alias("stars"),
    )
    return t.join_manifest(pages, m, "local_path")


def load_retained_skills(spark, d):
    """Documents as skills of a path per length; only paths that a label's document has too exist."""
    docs = table(spark, d, "documents").select(F.col("n_chars").alias("path"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 10).otherwise(0).alias("given"))
    there = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("n_chars").alias("path"))
    return t.retained(docs, there, "path", "ord", "given").select("path", "ord", "skill_id")


def load_quality_keep(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus") != "F").alias("keep"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("c"), "o_custkey")).alias("a"), F.concat(F.lit("c"), F.col("o_custkey") + 1).alias("b"),
    )
    there = table(spark, d, "customer").where("c_nationkey < 15").select(F.concat(F.lit("c"), "c_custkey").alias("path"))
    return t.quality_keep(o, there, "o_orderkey", ["a", "b"])


def entity_fit_record(spark, d):
    o = table(spark, d, "orders")
    fit = F.when(F.col("o_orderkey") % 7 == 0, "high").otherwise((F.pmod("o_custkey", F.lit(9)) - 1).cast("string"))
    r = t.entity_fit(fit, F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")), F.col("o_orderpriority"))
    return o.select("o_orderkey", r["fit_score"].alias("fit_score"), r["keep"].alias("keep"), r["decision"].alias("decision"), r["value"].alias("value"))


def normalize_suggested_task(spark, d):
    """Turns as suggestions: their sentences as a list of steps, or their role as one step and as what to verify."""
    c, head = table(spark, d, "conversations"), [F.col("text").alias("title"), F.concat(F.lit(" "), "role").alias("input")]
    told = F.when(F.col("turn") % 3 > 0, F.to_json(F.struct(*head, F.split("text", "\\.").alias("workflow")))).otherwise(F.to_json(F.struct(*head, F.col("role").alias("workflow"), F.col("role").alias("verification"))))
    s = t.suggested_task(told)
    return c.select("conv_id", "turn", s["title"].alias("title"), s["input"].alias("input"), F.size(s["workflow"]).alias("steps"), F.array_join(s["workflow"], "|").alias("workflow"), F.array_join(s["verification"], "|").alias("verification"))


def get_edge(spark, d):
    li = table(spark, d, "lineitem").withColumn("ord", F.struct("l_orderkey", "l_linenumber"))
    return t.first_edge(li, ["l_suppkey", "l_partkey"], "ord", "l_quantity")


def category_cap(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return t.capped(c, "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")], 50)


def copy_plan(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("ord"), F.pmod("l_partkey", F.lit(60)).alias("id"))
    r = table(spark, d, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    return t.copy_plan(li, r, "task", "ord")


def repository_urls(spark, d):
    """Pages' addresses at a code host, every fourth one in another shape, taken apart and built again."""
    name = F.concat(F.lit("sk ill+"), F.col("page_id").cast("string"))
    mode = F.when(F.col("page_id") % 4 == 0, "raw").when(F.col("page_id") % 2 == 0, "tree").otherwise("blob")
    host = F.when(F.col("page_id") % 5 == 0, "Example.org").otherwise("Code.Example.com")
    url = F.concat(F.lit("https://"), host, F.lit("/own/repo/"), mode, F.lit("/v%2F1/a%20b/"), F.lit("s"), F.col("page_id").cast("string"), F.lit("/README.md?x=1"))
    r = p.parse_repository_url(url, "code.example.com")
    return table(spark, d, "pages").select(
        "page_id", r["mode"].alias("mode"), r["ref"].alias("ref"), r["path"].alias("path"),
        p.contents_url("https://api.example.com", r["owner"], r["repo"], r["path"], r["ref"]).alias("contents"), p.raw_url("https://raw.example.com", r["owner"], r["repo"], name, r["ref"]).alias("raw"),
    )


def llm_labels(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", p.label_of(F.col("text"), ["the", "and", "der"], "mixed").alias("label"))


def test_names(spark, d):
    path = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("/out/"), F.col("page_id").cast("string"), F.lit("-a.b.csv")))
    return table(spark, d, "pages").select("page_id", p.test_name(path).alias("name"))


def metadata_values(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", p.list_value(F.col("x").cast("array<string>")).alias("value"))


def failure_summaries(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    total, passed, failed, errors = F.pmod(k, F.lit(3)), F.pmod(c, F.lit(2)), F.pmod(c, F.lit(3)), F.when(k % 5 == 0, 1).otherwise(0)
    failures = F.when((k % 4 == 0) & (failed > 0), F.array(F.struct(F.col("o_orderpriority").alias("test_name"), F.col("o_orderstatus").alias("error_message"))))
    said = F.when(k % 2 == 0, F.col("o_orderpriority"))
    return o.select("o_orderkey", p.failure_summary(total, passed, failed, errors, F.pmod(k, F.lit(2)), failures, said, F.when(k % 11 == 0, F.col("o_orderstatus"))).alias("summary"))


def science_profile(spark, d):
    """Documents read as sequence files: lines that start a record, and records of four lines."""
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(lines, lambda x: x.startswith("A"))).alias("headed"), F.floor(F.size(lines) / 4).alias("of_four"))


def basic_summary(spark, d):
    docs = table(spark, d, "documents")
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 3), "\n")
    return docs.select("doc_id", F.substring(head, 1, 500).alias("summary"))


def candidate_paths(spark, d):
    s = table(spark, d, "supplier")
    given = F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("x/"), "s_suppkey"))
    folder = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("/f/"), "s_nationkey"))
    return s.select("s_suppkey", F.posexplode(t.candidate_paths(given, folder, F.col("s_name"), "/skills")).alias("place", "path"))


def skill_text(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_linestatus")).alias("q"))
    parts = table(spark, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    return parts.select("p_partkey", t.skill_text(F.col("p_name"), F.when(F.col("p_size") > 9, F.col("p_type")), F.col("q"), F.col("p_brand")).alias("text"))


def sort_clusters(spark, d):
    return t.sorted_clusters(table(spark, d, "customer"), "c_nationkey", "c_custkey")


def sort_starts(spark, d):
    """Suppliers by their best parts, with the sum of the first four."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.sum("l_quantity").alias("edge_score"))
    return t.best_starts(li)


def checkpoint_concat(spark, d):
    return t.joined_texts(table(spark, d, "conversations"), "conv_id", "turn", "text", "\n---\n")


def serialize_trajectory(spark, d):
    return t.nested_document(table(spark, d, "events"), "user_id", "event_id", ["event_type"])


def dag_state_init(spark, d):
    edges, nodes = tq._dag(spark, d), tq._nodes(spark, d)
    out = t.dag_state(edges, trajectory.all_paths(edges, "task", nodes), "task")
    return out.select("task", *[F.array_join(c, ",").alias(c) for c in ("edges", "paths")])


def should_continue_flag(spark, d):
    o = table(spark, d, "orders")
    share = F.when(F.col("o_orderkey") % 3 > 0, F.pmod("o_custkey", F.lit(5)) / 4)
    return o.select("o_orderkey", t.go_on(F.col("o_orderstatus") == "F", share).alias("go_on"))


def notebook_profile(spark, d):
    """Orders as notebooks: a cell per line, code for every other one, with outputs where something was returned."""
    li = table(spark, d, "lineitem")
    cell = F.struct(
        F.when(F.col("l_linenumber") % 2 == 1, "code").otherwise("markdown").alias("cell_type"),
        F.when(F.col("l_returnflag") == "R", F.array(F.col("l_linestatus"))).otherwise(F.array().cast("array<string>")).alias("outputs"),
    )
    books = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(cell).alias("cells"))).alias("j"))
    broken = F.when(F.col("l_orderkey") % 7 == 0, F.lit("[1, 2")).otherwise(F.col("j"))
    p = t.notebook_profile(broken)
    return books.select("l_orderkey", *[p[c].alias(c) for c in ("cells", "code", "markdown", "has_outputs")])


def skill_names(spark, d):
    """Folders of the skill files that events touch."""
    steps = _steps(spark, d).where(F.col("path").endswith("/SKILL.md"))
    return steps.select(F.element_at(F.split("path", "/"), -2).alias("skill")).where(~F.col("skill").startswith(".")).distinct()


def loop_text(spark, d):
    """A line per loop of how many files it read, wrote and edited."""
    ops = track_tool_operation(spark, d).withColumn("loop", F.floor(F.col("event_id") / 100))
    s = tools.loop_summary(ops, ["user_id", "loop"], "event_id")
    text = F.concat_ws(", ", *[F.concat(F.size(c).cast("string"), F.lit(f" {c}")) for c in ("reads", "writes", "edits")])
    return s.select("user_id", "loop", text.alias("text"))


_QUERIES = (
    candidate_paths, skill_text, sort_clusters, sort_starts, checkpoint_concat, serialize_trajectory, dag_state_init, should_continue_flag, notebook_profile,
    skill_names, loop_text,
    track_tool_operation, filter_outputs, file_operations, used_skills, loop_summary, pair_by_tool_use_id, tool_lists, empty_trajectory, last_text_block,
    step_preview, parse_connection, upstream_roots, infer_entity_skill, node_list, task_item_keys, record_key, limited_edge_evidence, entities_in_tasks,
    join_manifest, load_retained_skills, load_quality_keep, entity_fit_record, normalize_suggested_task, get_edge, category_cap, copy_plan, repository_urls,
    llm_labels, test_names, metadata_values, failure_summaries, science_profile, basic_summary,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    steps, skills = f"WITH {_STEPS_SQL}", f"WITH {_SKILLS_SQL}"
    return {
        "candidate_paths": """WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'x/' || s_suppkey END AS g, CASE WHEN s_nationkey % 2 = 0 THEN '/f/' || s_nationkey END AS f, s_name AS n FROM supplier),
            y AS (SELECT s_suppkey, list_filter([g, '/skills/' || g, f || '/SKILL.md', '/skills/' || n || '/SKILL.md'], lambda p: p IS NOT NULL) AS l FROM x)
            SELECT s_suppkey, CAST(unnest(range(len(l))) AS INTEGER) AS place, unnest(l) AS path FROM y""",
        "skill_text": """WITH q AS (SELECT l_partkey, string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) AS q FROM lineitem GROUP BY 1)
            SELECT p_partkey, 'Skill name: ' || p_name || chr(10) || 'Description: ' || CASE WHEN p_size > 9 THEN p_type ELSE '' END || chr(10) || 'Queries: ' || coalesce(q, '') || chr(10) || chr(10) || p_brand AS text
            FROM part LEFT JOIN q ON p_partkey = l_partkey""",
        "sort_clusters": "SELECT c_nationkey, count(*) AS size, min(c_custkey) AS first FROM customer GROUP BY 1 ORDER BY 2 DESC, 3 DESC",
        "sort_starts": """WITH e AS (SELECT l_suppkey AS s, l_partkey AS p, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY q DESC, p) AS i FROM e)
            SELECT s AS node, max(q) AS best, round(sum(q), 6) AS total FROM n WHERE i <= 4 GROUP BY 1""",
        "checkpoint_concat": "SELECT conv_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1",
        "serialize_trajectory": """SELECT user_id, CAST(to_json({'user_id': user_id, 'n': count(*), 'steps': list({'event_id': event_id, 'event_type': event_type} ORDER BY event_id)}) AS VARCHAR) AS document
            FROM events GROUP BY 1""",
        "dag_state_init": f"""WITH RECURSIVE {tq._DAG}, walk(task, node, path) AS (SELECT task, node, CAST(node AS VARCHAR) FROM ends WHERE is_source
              UNION ALL SELECT w.task, g.target, w.path || '->' || g.target FROM walk w JOIN dag g ON g.task = w.task AND g.source = w.node),
            p AS (SELECT w.task, path FROM walk w JOIN ends e ON e.task = w.task AND e.node = w.node AND e.is_sink
              UNION ALL SELECT task, CAST(node AS VARCHAR) FROM nodes WHERE task NOT IN (SELECT task FROM dag)),
            e AS (SELECT task, string_agg(source || '->' || target, ',' ORDER BY source || '->' || target) AS edges FROM dag GROUP BY 1)
            SELECT task, coalesce(edges, '') AS edges, paths FROM (SELECT task, string_agg(path, ',' ORDER BY path) AS paths FROM p GROUP BY 1) LEFT JOIN e USING (task)""",
        "should_continue_flag": "SELECT o_orderkey, o_orderstatus <> 'F' AND (o_orderkey % 3 = 0 OR o_custkey % 5 < 4) AS go_on FROM orders",
        "notebook_profile": """WITH x AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber % 2 = 1) AS c, bool_or(l_returnflag = 'R') AS o, l_orderkey % 7 > 0 AS ok FROM lineitem GROUP BY 1)
            SELECT l_orderkey, CAST(CASE WHEN ok THEN n END AS INTEGER) AS cells, CAST(CASE WHEN ok THEN c END AS INTEGER) AS code, CAST(CASE WHEN ok THEN n - c END AS INTEGER) AS markdown, CASE WHEN ok THEN o END AS has_outputs FROM x""",
        "skill_names": f"{steps} SELECT DISTINCT regexp_extract(path, '([^/]*)/SKILL.md$', 1) AS skill FROM steps WHERE ends_with(path, '/SKILL.md')",
        "loop_text": f"""{steps}, f AS (SELECT DISTINCT user_id, event_id // 100 AS loop, kind, value FROM operations)
            SELECT user_id, loop, count(*) FILTER (kind = 'input') || ' reads, ' || count(*) FILTER (kind = 'output') || ' writes, ' || count(*) FILTER (kind = 'edited') || ' edits' AS text FROM f GROUP BY 1, 2""",
        "track_tool_operation": f"{steps} SELECT * FROM operations",
        "filter_outputs": f"""{steps} SELECT DISTINCT user_id, 'output' AS side, value AS path FROM operations o WHERE kind = 'output'
            AND (contains(regexp_extract(value, '[^/]*$'), '.') OR NOT EXISTS (SELECT 1 FROM operations i WHERE i.kind = 'input' AND i.user_id = o.user_id AND i.value = o.value))
            UNION ALL SELECT DISTINCT user_id, 'input', value FROM operations WHERE kind = 'input' AND NOT starts_with(value, '/root/output')""",
        "file_operations": f"""{steps} SELECT user_id, event_id, CASE tool_name WHEN 'Write' THEN 'create' WHEN 'Edit' THEN 'edit' WHEN 'Read' THEN 'read' ELSE 'notebook_edit' END AS operation, path
            FROM steps WHERE tool_name IN ('Write', 'Edit', 'Read', 'NotebookEdit') AND path <> ''""",
        "used_skills": f"""{steps} SELECT DISTINCT user_id, skill FROM (SELECT user_id, CASE WHEN kind = 'skill' THEN value
            WHEN kind IN ('input', 'glob', 'command') THEN regexp_extract(value, '/skills/([^/*]+)', 1) END AS skill FROM operations) WHERE skill <> '' AND skill NOT IN ('view1', 'click2')""",
        "loop_summary": f"""{steps}, f AS (SELECT user_id, event_id // 100 AS loop, kind, value, min(event_id) AS o FROM operations GROUP BY ALL)
            SELECT user_id, loop, {", ".join(f"coalesce(string_agg(value, ',' ORDER BY o, value) FILTER (kind = '{k}'), '') AS {n}" for k, n in (("input", "reads"), ("output", "writes"), ("edited", "edits")))}
            FROM f GROUP BY 1, 2""",
        "pair_by_tool_use_id": """SELECT a.conv_id, CAST(a.turn % 2 AS INTEGER) AS use, a.turn, substr(arg_min(b.text, b.turn), 1, 10000) AS output FROM conversations a
            LEFT JOIN conversations b ON b.role = 'user' AND b.conv_id = a.conv_id AND b.turn % 2 = a.turn % 2 AND b.turn > a.turn WHERE a.role = 'assistant' GROUP BY 1, 2, 3""",
        "tool_lists": f"""{steps} SELECT user_id, count(*) FILTER (kind = 'output') AS created, count(*) FILTER (kind = 'command') AS commands,
            count(*) FILTER (kind IN ('url', 'query')) AS web, count(*) FILTER (kind IN ('glob', 'grep')) AS patterns FROM operations GROUP BY 1""",
        "empty_trajectory": "SELECT CAST(c_custkey AS BIGINT) AS user_id, count(e.user_id) AS steps FROM customer LEFT JOIN events e ON e.user_id = c_custkey GROUP BY 1",
        "last_text_block": """SELECT conv_id, coalesce(arg_max(trim(regexp_replace(trim(text), '^(?:Summary:|The)\\s*', '')), turn) FILTER (trim(text) <> ''), 'none') AS summary
            FROM conversations WHERE role = 'assistant' GROUP BY 1""",
        "step_preview": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events)
            SELECT user_id, event_id, substr(props, 1, 500) AS action, substr(event_type, 1, 300) AS response, m > 20 AS cut FROM n WHERE m <= 20 OR i <= 10 OR i > m - 10""",
        "parse_connection": f"{skills} SELECT task, ord, CASE WHEN told THEN a END AS source, CASE WHEN told THEN b END AS target FROM links",
        "upstream_roots": f"{skills} SELECT task, id, name FROM roots",
        "infer_entity_skill": f"""{skills}, e AS (SELECT task, ord, CASE WHEN id % 2 = 0 THEN id WHEN id % 4 = 1 THEN id + 1 END AS for_id, CASE WHEN id % 3 = 0 THEN name END AS for_name FROM skills),
            one AS (SELECT task, min(id) AS id FROM roots GROUP BY 1 HAVING count(*) = 1)
            SELECT e.task, e.ord, coalesce((SELECT min(s.id) FROM skills s WHERE s.task = e.task AND s.id = e.for_id), (SELECT min(s.id) FROM skills s WHERE s.task = e.task AND s.name = e.for_name), one.id) AS skill
            FROM e LEFT JOIN one USING (task)""",
        "node_list": """SELECT l_orderkey AS task, string_agg(CASE WHEN p_size <= 45 THEN p_name ELSE '' END, '|' ORDER BY l_linenumber, l_partkey) AS names
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
        "task_item_keys": """WITH f AS (SELECT l_orderkey, l_partkey % 4 AS k, min(l_linenumber) AS o FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2)
            SELECT l_orderkey, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY o, k), '') AS keys FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN f USING (l_orderkey) GROUP BY 1""",
        "record_key": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) ELSE concat_ws('::', page_id % 10, url, length(html)) END AS key FROM pages",
        "limited_edge_evidence": """WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, unnest(range(1, 1 + least(3, CAST(floor(l_quantity / 10 + 1) AS INTEGER)))) AS i FROM lineitem),
            n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, i, l_suppkey || ':' || i) AS INTEGER) AS n FROM x)
            SELECT l_orderkey, n, l_suppkey || ':' || i AS item FROM n WHERE n <= 12""",
        "entities_in_tasks": "SELECT event_id, CAST(user_id AS BIGINT) AS task FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
        "join_manifest": """WITH m AS (SELECT s_suppkey % 150 AS k, max(s_suppkey) AS s FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1)
            SELECT '/skills/s' || page_id AS local_path, CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE 's' || page_id END AS skill_name,
              CAST(CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey ELSE 0 END AS BIGINT) AS stars FROM pages LEFT JOIN m ON k = page_id LEFT JOIN supplier ON s_suppkey = s""",
        "load_retained_skills": """WITH f AS (SELECT n_chars AS path, min(doc_id) AS ord FROM documents WHERE n_chars IN (SELECT n_chars FROM documents JOIN labels USING (doc_id)) GROUP BY 1)
            SELECT path, ord, CASE WHEN ord % 2 = 0 AND ord > 0 THEN ord * 10 ELSE ord + 1 END AS skill_id FROM f""",
        "load_quality_keep": """WITH k AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus <> 'F' END AS keep FROM orders),
            t AS (SELECT c_custkey FROM customer WHERE c_nationkey < 15),
            f AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_custkey IN (FROM t) THEN o_custkey WHEN o_custkey + 1 IN (FROM t) THEN o_custkey + 1 END AS c FROM k WHERE keep IS NULL OR keep)
            SELECT 'c' || c AS path, min(o_orderkey) AS o_orderkey FROM f WHERE c IS NOT NULL GROUP BY 1""",
        "entity_fit_record": """WITH x AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE greatest(1.0, least(5.0, o_custkey % 9 - 1.0)) END AS f FROM orders)
            SELECT o_orderkey, CAST(f AS DOUBLE) AS fit_score, f >= 3 AS keep, CASE WHEN f >= 3 THEN 'keep' ELSE 'reject' END AS decision,
              CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS value FROM x""",
        "normalize_suggested_task": """WITH w AS (SELECT *, CASE WHEN turn % 3 > 0 THEN list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '') ELSE [role] END AS l FROM conversations)
            SELECT conv_id, turn, trim(coalesce(text, '')) AS title, role AS input, CAST(len(l) AS INTEGER) AS steps, array_to_string(l, '|') AS workflow, CASE WHEN turn % 3 > 0 THEN '' ELSE role END AS verification FROM w""",
        "get_edge": "SELECT l_suppkey, l_partkey, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity FROM lineitem GROUP BY 1, 2",
        "category_cap": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 50",
        "copy_plan": """WITH x AS (SELECT l_orderkey AS task, l_linenumber AS ord, p_brand AS name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey % 60 AND p_partkey % 5 <> 0)
            SELECT task, ord, coalesce(name, '') AS name, CASE WHEN name IS NULL THEN 'missing' WHEN row_number() OVER (PARTITION BY task, name ORDER BY ord) > 1 THEN 'duplicate_skill_name_skipped' ELSE 'copied' END AS status FROM x""",
        "repository_urls": """WITH x AS (SELECT page_id, page_id % 5 > 0 AND page_id % 4 > 0 AS ok, CASE WHEN page_id % 2 = 0 THEN 'tree' ELSE 'blob' END AS m FROM pages)
            SELECT page_id, CASE WHEN ok THEN m END AS mode, CASE WHEN ok THEN 'v/1' END AS ref, CASE WHEN ok THEN 'a b/s' || page_id || '/README.md' END AS path,
              CASE WHEN ok THEN 'https://api.example.com/repos/own/repo/contents/a%20b/s' || page_id || '/README.md?ref=v%2F1' END AS contents,
              CASE WHEN ok THEN 'https://raw.example.com/own/repo/v%2F1/sk%20ill%2B' || page_id END AS raw FROM x""",
        "llm_labels": """SELECT conv_id, turn, CASE WHEN lower(trim(text)) IN ('the', 'and', 'der') THEN lower(trim(text)) WHEN contains(lower(text), 'the') THEN 'the'
            WHEN contains(lower(text), 'and') THEN 'and' WHEN contains(lower(text), 'der') THEN 'der' ELSE 'mixed' END AS label FROM conversations""",
        "test_names": """WITH x AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '[^/]*$') ELSE page_id || '-a.b.csv' END AS f FROM pages),
            y AS (SELECT page_id, regexp_replace(CASE WHEN contains(f, '.') THEN regexp_replace(f, '\\.[^.]*$', '') ELSE f END, '[^a-zA-Z0-9_]', '_', 'g') AS n FROM x)
            SELECT page_id, CASE WHEN n = '' THEN 'output' WHEN regexp_matches(n, '^[0-9]') THEN 'file_' || n ELSE n END AS name FROM y""",
        "metadata_values": """WITH l AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS x FROM lineitem GROUP BY 1)
            SELECT o_orderkey, CASE WHEN x IS NULL THEN 'N/A' ELSE array_to_string(x[1:5], ', ') || CASE WHEN len(x) > 5 THEN '... (+' || (len(x) - 5) || ' more)' ELSE '' END END AS value
            FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
        "failure_summaries": """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 3 AS t, o_custkey % 2 AS p, o_custkey % 3 AS f, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS e, o_orderkey % 2 AS c,
              o_orderkey % 4 = 0 AND o_custkey % 3 > 0 AS told, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS so, CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus END AS se, o_orderpriority AS n, o_orderstatus AS m FROM orders)
            SELECT k AS o_orderkey, CASE WHEN t = 0 AND c = 0 THEN 'No tests collected (test file may be empty or have no test functions)' || CASE WHEN so IS NOT NULL THEN '. Output:' || chr(10) || so ELSE '' END
              WHEN e > 0 AND NOT told AND se IS NOT NULL THEN '1 test error(s) (collection/import). Details:' || chr(10) || se
              WHEN e > 0 AND NOT told AND so IS NOT NULL THEN '1 test error(s) (collection/import). Output:' || chr(10) || so
              WHEN e > 0 AND NOT told THEN '1 test error(s) occurred (collection/import errors, return_code=' || c || ')'
              WHEN f > 0 AND NOT told THEN f || ' test(s) failed (no detailed failure info available)' WHEN NOT told AND p > 0 THEN 'All tests passed.'
              WHEN NOT told THEN 'No test results (passed=' || p || ', failed=' || f || ', errors=' || e || ')' ELSE 'Failed 1 test(s):' || chr(10) || '  - ' || n || ': ' || m END AS summary FROM x""",
        "science_profile": """WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
            SELECT doc_id, CAST(len(list_filter(l, lambda x: starts_with(x, 'A'))) AS INTEGER) AS headed, CAST(len(l) // 4 AS BIGINT) AS of_four FROM x""",
        "basic_summary": "SELECT doc_id, substr(array_to_string(string_split(text, chr(10))[1:3], chr(10)), 1, 500) AS summary FROM documents",
    }
