"""Registered queries of scalar functions, one per family, over whole given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import scalars as s
from weft.operators import ranking
from weft.session import table


def names_and_paths(spark, d):
    p, u = table(spark, d, "pages"), F.col("url")
    return p.select(
        "page_id", s.safe_name(u).alias("safe_name"), s.sanitize_name(u).alias("sanitized"), s.normalize_path(u).alias("path"),
        s.filename(u).alias("filename"), s.extension(u).alias("extension"), s.guess_extension(u, F.lit("Excel sheet")).alias("guessed"),
        s.url_record_id(F.col("page_id").cast("string"), u).alias("record_id"), s.text_cache_key("m", u).alias("cache_key"),
    )


def scores(spark, d):
    o = table(spark, d, "orders")
    env, ver, doc = (F.substring("o_orderpriority", 1, 1).cast("int"), F.pmod("o_custkey", F.lit(7)).cast("int"), F.pmod("o_orderkey", F.lit(6)).cast("int"))
    env, ver, doc = s.clamp_score(env), s.clamp_score(ver), s.clamp_score(doc)
    q, t = s.quality_record(env, ver, doc), s.task_evaluation(env, ver)
    return o.select(
        "o_orderkey", env.alias("env"), ver.alias("ver"), doc.alias("doc"), q["overall_score"].alias("overall_score"), q["keep"].alias("keep"),
        t["decision"].alias("decision"), s.safe_float(F.col("o_orderpriority")).alias("as_float"), s.clamp_int(F.col("o_orderstatus"), 1, 5, 3).alias("as_int"),
    )


def scenario_lists(spark, d):
    c = table(spark, d, "conversations")
    parts = s.normalize_scenarios(F.split("text", "\\."))
    return c.select("conv_id", "turn", F.size(parts).alias("n"), F.array_join(parts, "|").alias("scenarios"), s.normalize_scenario(F.col("text")).alias("whole"))


def model_json(spark, d):
    e = table(spark, d, "events")
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    told = F.concat(F.lit("The answer is "), F.when(F.col("event_id") % 5 == 0, F.rtrim("props", F.lit("}"))).otherwise(F.col("props")), F.lit(" as asked."))
    return e.select(
        "event_id", *[s.parse_model_json(v, "k").alias(n) for n, v in (("plain", F.col("props")), ("fenced", fenced), ("told", told))],
        s.parse_model_json(F.col("event_type"), "k").alias("none"),
    )


def truncations(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(s.truncate_head_tail(t)).alias("head_tail"), F.length(s.truncate_head_tail(t)).alias("n"), s.truncate_prefix(t, 100).alias("prefix"),
        F.size(s.split_text(t, 1000)).alias("pieces"), s.classify_content(t, F.col("source")).alias("content"), s.looks_like_date(t).alias("date"),
    )


def commands(spark, d):
    """Shell commands made of part names: what they install and write."""
    p = table(spark, d, "part")
    name = F.regexp_replace("p_name", " ", "-")
    version = F.concat(F.lit("=="), F.pmod("p_size", F.lit(4)).cast("string"))
    pip = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("pip3 install --quiet --upgrade "), name, version)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("pip install "), name)).otherwise("pip list")
    apt = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("apt-get install -y "), name)).otherwise("apt update")
    out = F.when(F.col("p_size") % 5 == 0, "/dev/null").otherwise(F.concat(F.lit("/root/out/"), name, F.lit(".log")))
    command = F.concat(pip, F.lit(" && "), apt, F.lit(" > "), out, F.lit(" 2>/dev/null; cat /x/skills/"), "p_brand")
    return p.select(
        "p_partkey", F.array_join(s.pip_packages(command), ",").alias("pip"), F.array_join(s.apt_packages(command), ",").alias("apt"),
        F.array_join(s.redirect_targets(command), ",").alias("files"), s.skill_from_path(command).alias("skill"),
        F.array_join(s.requirement_names(F.concat_ws("\n", F.lit("# head"), name, F.lit("-r x"), F.concat(name, F.lit(">=2")))), ",").alias("requirements"),
        F.array_join(s.system_packages(F.concat(F.when(F.col("p_size") % 2 == 0, "uses ffmpeg and ").otherwise("has "), F.when(F.col("p_size") % 3 == 0, "Pandoc ").otherwise("none "), "p_name")), ",").alias("system"),
    )


def lists(spark, d):
    o = table(spark, d, "orders")
    parts = F.split(F.concat_ws(",", F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_custkey"), F.lit(" 7 "), F.lit("")), ",")
    return o.select("o_orderkey", F.array_join(s.as_int_list(parts).cast("array<string>"), ",").alias("ints"), F.array_join(s.normalize_string_list(parts), ",").alias("texts"))


def normalized_verdicts(spark, d):
    """Alignment types and review decisions under their defaulting rules."""
    o = table(spark, d, "orders").withColumn("conf", F.substring("o_orderpriority", 1, 1).cast("int"))
    kind = F.when(F.col("o_orderstatus") == "O", "same_state_merge").otherwise(F.col("o_orderstatus"))
    given = F.when(F.col("o_custkey") % 3 == 0, True).when(F.col("o_custkey") % 3 == 1, False)
    return o.select(
        "o_orderkey", s.alignment_type(F.col("conf") > 2, kind, ["same_state_merge", "data_state_handoff"]).alias("alignment_type"),
        s.review_keep(given, F.col("o_orderstatus") == "P", F.col("conf")).alias("keep_edge"),
    )


def star_counts(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).alias("stars"), F.col("p_type").alias("star"), F.lit("5").alias("stargazers_count"))
    p = p.withColumn("star", F.when(F.col("p_partkey") % 2 == 0, F.col("star")))
    return p.select("p_partkey", s.star_count("stars", "star", "stargazers_count").alias("stars"))


def topk_by_stars(spark, d):
    e = table(spark, d, "events")
    return ranking.top_k(e, ["user_id"], [F.desc("value"), F.col("event_id")], 20, F.col("value") >= 10).select("user_id", "event_id", "rank")


def keep_first(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.md5("text").alias("content"))
    return ranking.keep_first(t, ["content"], [F.col("doc_id")])


def collect_skills(spark, d):
    """Per event type and day: best value, first user, users in order of appearance."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    users = ranking.ordered_distinct(e.withColumn("key", F.concat_ws("/", "event_type", "day")), "key", "user_id", "event_id")
    best = e.groupBy(F.concat_ws("/", "event_type", "day").alias("key")).agg(F.max("value").alias("best"), F.min_by("user_id", "event_id").alias("first_user"))
    return users.join(best, "key").select("key", "best", "first_user", F.array_join(F.col("values").cast("array<string>"), ",").alias("users"))


def download_with_dedup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"), "source", F.md5("text").alias("content"), F.concat("source", F.lit("/"), F.pmod("doc_id", F.lit(97)).cast("string")).alias("url"))
    return ranking.download_status(docs, "source", "url", "content", "doc_id").select("doc_id", "status")


def package_summary(spark, d):
    return download_with_dedup(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


def resume_pending(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    return ranking.pending(docs, labels, ["doc_id"], F.col("quality") == 1)


def keep_and_reject(spark, d):
    kept, rest = ranking.keep_and_reject(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"), F.col("quality") == 1)
    return kept.select("doc_id", F.lit("keep").alias("part")).unionByName(rest.select("doc_id", F.lit("reject").alias("part")))


def unique_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return ranking.numbered_names(p, "p_brand", "p_partkey").select("p_partkey", "unique_name")


def scan_manifest(spark, d):
    """Records of three lists, the last of a name wins."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") < 10, 1).when(F.col("p_size") < 30, 2).otherwise(3).alias("list"))
    p = p.withColumn("ord", F.col("list") * 10_000_000 + F.col("p_partkey"))
    return ranking.last_wins(p, ["p_brand"], "ord").select("p_brand", "p_partkey", "list")


def queries():
    return {f.__name__: f for f in (
        names_and_paths, scores, scenario_lists, model_json, truncations, commands, lists, normalized_verdicts, star_counts, topk_by_stars, keep_first,
        collect_skills, download_with_dedup, package_summary, resume_pending, keep_and_reject, unique_names, scan_manifest,
    )}


_KIND = "".join(f" WHEN contains('excel sheet', '{t}') THEN '{e}'" for t, e in s.ENTITY_EXTENSIONS)
_STATUS = """SELECT doc_id, source, CASE WHEN u > 1 THEN 'duplicate_url' WHEN doc_id > min(CASE WHEN u = 1 THEN doc_id END) OVER (PARTITION BY source, content)
  THEN 'duplicate_content' ELSE 'downloaded' END AS status FROM (
  SELECT doc_id, source, md5(text) AS content, row_number() OVER (PARTITION BY source, source || '/' || (doc_id % 97) ORDER BY doc_id) AS u FROM documents)"""


def _cut_end(a, most=1000):
    """Where the piece that starts after ``a`` characters ends."""
    w = f"substr(text, {a} + 1, {most})"
    line = f"{a} + length({w}) - strpos(reverse({w}), chr(10))"
    return f"CASE WHEN {a} + {most} < length(text) AND contains({w}, chr(10)) AND {line} > {a} + {most // 2} THEN {line} + 1 ELSE least(length(text), {a} + {most}) END"


def _any(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def oracle_sql():
    clamp = "greatest(1, least(5, coalesce({}, 1)))"
    env, ver, doc = (clamp.format(x) for x in ("CAST(substr(o_orderpriority, 1, 1) AS INTEGER)", "CAST(o_custkey % 7 AS INTEGER)", "CAST(o_orderkey % 6 AS INTEGER)"))
    clean = "trim(regexp_replace({}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' .;:-')"
    name = "replace(p_name, ' ', '-')"
    return {
        "names_and_paths": f"""SELECT page_id,
            substr(coalesce(nullif(trim(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g'), '-._'), ''), 'skill'), 1, 80) AS safe_name,
            substr(coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[\\\\/:*?"<>|]+', '_', 'g'), '\\s+', '_', 'g'), '._ '), ''), 'file'), 1, 120) AS sanitized,
            rtrim(replace(url, '\\', '/'), '/') AS path, string_split(url, '/')[-1] AS filename,
            lower(regexp_extract(string_split(url, '/')[-1], '\\.([^.]*)$', 1)) AS extension,
            CASE WHEN regexp_extract(string_split(url, '/')[-1], '[^.](\\.[^.]+)$', 1) <> '' AND length(regexp_extract(string_split(url, '/')[-1], '[^.](\\.[^.]+)$', 1)) <= 12
              THEN regexp_extract(string_split(url, '/')[-1], '[^.](\\.[^.]+)$', 1) ELSE CASE {_KIND} ELSE '.dat' END END AS guessed,
            page_id || '::' || substr(sha1(url), 1, 12) AS record_id, 'm:' || sha256(url) AS cache_key FROM pages""",
        "scores": f"""WITH x AS (SELECT *, {env} AS env, {ver} AS ver, {doc} AS doc FROM orders),
            y AS (SELECT *, CAST(0.30 AS DOUBLE) * env + CAST(0.45 AS DOUBLE) * ver + CAST(0.25 AS DOUBLE) * doc AS overall FROM x)
            SELECT o_orderkey, env, ver, doc, round(overall, 3) AS overall_score, env >= 2 AND ver >= 3 AND doc >= 3.5 AND overall >= 3 AS keep,
              CASE WHEN env >= 4 AND ver >= 4 THEN 'keep' ELSE 'reject' END AS decision, coalesce(TRY_CAST(o_orderpriority AS DOUBLE), 0.0::DOUBLE) AS as_float,
              CAST(greatest(1, least(5, coalesce(TRY_CAST(o_orderstatus AS INTEGER), 3))) AS INTEGER) AS as_int FROM y""",
        "scenario_lists": f"""WITH x AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, '.'), lambda s: {clean.format("s")}), lambda s: s <> '') AS a FROM conversations),
            y AS (SELECT *, list_transform(a, lambda s: lower(s)) AS l FROM x), z AS (SELECT *, list_filter(a, lambda s, i: list_position(l, lower(s)) = i) AS k FROM y)
            SELECT conv_id, turn, CAST(len(k) AS INTEGER) AS n, array_to_string(k, '|') AS scenarios, {clean.format("text")} AS whole FROM z""",
        "model_json": r"""WITH x AS (SELECT event_id, event_type, props, '```json' || chr(10) || props || chr(10) || '```' AS fenced,
              'The answer is ' || CASE WHEN event_id % 5 = 0 THEN rtrim(props, '}') ELSE props END || ' as asked.' AS told FROM events),
            y AS (SELECT *, regexp_extract(fenced, '^```json\s*(.*?)\s*```$', 1, 's') AS f, regexp_extract(told, '\{.*\}', 0, 's') AS t FROM x)
            SELECT event_id, CASE WHEN json_valid(props) THEN props ->> '$.k' END AS plain, CASE WHEN json_valid(f) THEN f ->> '$.k' END AS fenced,
              CASE WHEN json_valid(t) THEN t ->> '$.k' END AS told, CASE WHEN json_valid(event_type) THEN event_type ->> '$.k' END AS none FROM y""",
        "truncations": f"""WITH RECURSIVE cuts(doc_id, text, a, b) AS (
              SELECT doc_id, text, 0, {_cut_end("0")} FROM documents UNION ALL SELECT doc_id, text, b, {_cut_end("b")} FROM cuts WHERE b < length(text)),
            parts AS (SELECT doc_id, count(*) FILTER (trim(substr(text, a + 1, b - a), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS n FROM cuts GROUP BY 1),
            x AS (SELECT *, CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 1400) || chr(10) || '... [' || (length(text) - 2000) || ' characters truncated] ...' || chr(10) || right(text, 600) END AS ht FROM documents)
            SELECT doc_id, md5(ht) AS head_tail, CAST(length(ht) AS INTEGER) AS n, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 100) || '...' END AS prefix,
              CAST(CASE WHEN length(text) <= 1000 THEN 1 ELSE greatest(1, parts.n) END AS INTEGER) AS pieces,
              CASE WHEN {_any("lower(text)", s.FORM_WORDS)} THEN 'form' WHEN {_any("lower(text)", s.TABLE_WORDS)} THEN 'table' WHEN {_any("lower(text)", s.CODE_WORDS)} THEN 'code' ELSE 'text' END AS content,
              regexp_matches(text, '{s.DATE_PATTERN}') AS date FROM x JOIN parts USING (doc_id)""",
        "commands": rf"""WITH x AS (SELECT p_partkey, p_brand, {name} AS n, p_size,
              CASE p_size % 3 WHEN 0 THEN 'pip3 install --quiet --upgrade ' || {name} || '==' || (p_size % 4) WHEN 1 THEN 'pip install ' || {name} ELSE 'pip list' END || ' && '
              || CASE WHEN p_size % 2 = 0 THEN 'apt-get install -y ' || {name} ELSE 'apt update' END || ' > ' || CASE WHEN p_size % 5 = 0 THEN '/dev/null' ELSE '/root/out/' || {name} || '.log' END
              || ' 2>/dev/null; cat /x/skills/' || p_brand AS c, CASE WHEN p_size % 2 = 0 THEN 'ffmpeg' END AS a, CASE WHEN p_size % 3 = 0 THEN 'pandoc' END AS b FROM part)
            SELECT p_partkey, array_to_string(regexp_extract_all(c, 'pip3?\s+install\s+(?:--[^\s]+\s+)*([^\s&|;#]+)', 1), ',') AS pip,
              array_to_string(regexp_extract_all(c, 'apt(?:-get)?\s+install\s+(?:-y\s+)?([^\s&|;#]+)', 1), ',') AS apt,
              array_to_string(list_filter(regexp_extract_all(c, '>\s*([^\s&|;>]+)', 1), lambda f: NOT starts_with(f, '/dev/')), ',') AS files, regexp_extract(c, '/skills/([^/\s]+)', 1) AS skill,
              n || ',' || n AS requirements, concat_ws(',', a, b) AS system FROM x""",
        "lists": """SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_custkey, 7])), ',') AS ints,
            o_custkey || ',' || o_orderpriority || ',' || o_custkey || ',7' AS texts FROM orders""",
        "normalized_verdicts": """WITH x AS (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS conf FROM orders)
            SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'same_state_merge' WHEN conf > 2 THEN 'data_state_handoff' ELSE 'incompatible' END AS alignment_type,
              CASE WHEN o_orderstatus = 'P' OR conf >= 4 THEN false ELSE o_custkey % 3 <> 1 END AS keep_edge FROM x""",
        "star_counts": """SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS BIGINT) WHEN p_partkey % 2 = 0 THEN 0 ELSE 5 END AS stars FROM part""",
        "topk_by_stars": """SELECT user_id, event_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value >= 10) WHERE r <= 20""",
        "keep_first": "SELECT min(doc_id) AS doc_id, md5(text) AS content FROM documents GROUP BY md5(text)",
        "collect_skills": """WITH e AS (SELECT *, event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS key FROM events), u AS (SELECT key, user_id, min(event_id) AS o FROM e GROUP BY 1, 2),
            l AS (SELECT key, array_to_string(list(user_id ORDER BY o), ',') AS users FROM u GROUP BY 1)
            SELECT key, max(value) AS best, arg_min(user_id, event_id) AS first_user, any_value(users) AS users FROM e JOIN l USING (key) GROUP BY key""",
        "download_with_dedup": f"SELECT doc_id, status FROM ({_STATUS})",
        "package_summary": f"SELECT source, status, count(*) AS n FROM ({_STATUS}) GROUP BY 1, 2",
        "resume_pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "keep_and_reject": "SELECT doc_id, CASE WHEN quality = 1 THEN 'keep' ELSE 'reject' END AS part FROM documents LEFT JOIN labels USING (doc_id)",
        "unique_names": """SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || '__' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)""",
        "scan_manifest": """SELECT p_brand, p_partkey, CAST(list AS INTEGER) AS list FROM (SELECT *, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS list FROM part)
            QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY list DESC, p_partkey DESC) = 1""",
    }
