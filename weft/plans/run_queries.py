"""Registered queries of resumed runs, retry feedback, reviews and documented functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weft.functions import parsers, scanners
from weft.session import shared_dir, table
from weft.streaming import events as stream


def incremental_resume(spark, d):
    """Orders worked off in two runs of several batches: a fifth fails at first and is done again."""
    orders, store = table(spark, d, "orders").select("o_orderkey", "o_custkey"), f"{shared_dir(spark)}/weft-resume-{uuid.uuid4().hex}"

    def work(run):
        fails = (F.col("o_orderkey") % 5 == 0) & F.lit(run == 1)
        return lambda todo: todo.select("o_orderkey", F.lit(run).alias("run"), (F.col("o_custkey") * 2).alias("done"), F.when(fails, "failed").alias("error"))

    n = orders.count()
    stream.resume(orders, store, ["o_orderkey"], work(1), -(-n // 3))
    return stream.resume(orders, store, ["o_orderkey"], work(2), -(-n // 3)).select("o_orderkey", "run", "done", "error")


def _attempts(events):
    """Every three events are the attempts of a task: views fail to run, others fail in up to three tests."""
    n = F.pmod("event_id", F.lit(4)).cast("int")
    fails = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), n), lambda i: F.struct(F.concat(F.col("event_type"), F.lit("_"), i).alias("test_name"), F.when(i != 1, F.concat(F.lit("user "), F.col("user_id"))).alias("error_message")))
    return events.select(
        F.floor(F.col("event_id") / 3).alias("task"), F.pmod("event_id", F.lit(3)).cast("int").alias("attempt"), F.when(n < 3, fails).alias("failures"), F.when(n == 3, F.concat(F.lit("exit "), F.col("event_type"))).alias("error"), "ts",
    )


def _prompts(history):
    return history.select("task", "attempt", stream.retry_prompt(F.concat(F.lit("Do "), F.col("task")), F.col("history"), F.col("attempt") + 1).alias("prompt"))


def retry_feedback(spark, d):
    return _prompts(stream.retry_feedback(_attempts(table(spark, d, "events")), "task", "attempt", "failures", "error"))


def retry_feedback_stream(spark, d):
    """The same as a stream over the files of events."""
    rows = stream.run_available(stream.retry_feedback_stream(_attempts(stream.read_events(spark, d)), "task", "attempt", "failures", "error", "ts", "36500 days"), "update")
    last = rows.groupBy("task", "attempt").agg(F.max_by("history", F.struct("batch", F.length("history"))).alias("history"))
    return _prompts(last)


def parse_prm_result(spark, d):
    """Reviews of parts: fenced or bare JSON, signals in text, lists of issues, or nothing."""
    key = F.col("p_partkey").cast("string")
    answers = [
        F.concat(F.lit('```json\n{"is_valid": true, "issues": ["a'), key, F.lit('"], "feedback": "fine"}\n```')), F.concat(F.lit('so {"is_valid": false, "issues": []} '), key), F.concat(F.lit("IS_VALID: true "), key),
        F.concat(F.lit("is_valid: false\n - first "), key, F.lit("\n* second\nAn Error here\nok")), F.concat(F.lit("nothing "), key), F.concat(F.lit('```\nbroken\n``` then {"is_valid": true, "feedback": "'), key, F.lit('"}')),
    ]
    text = F.element_at(F.array(*answers), (F.pmod("p_partkey", F.lit(len(answers))) + 1).cast("int"))
    r = table(spark, d, "part").select("p_partkey", scanners.parse_prm_result(text).alias("r"))
    return r.select("p_partkey", "r.is_valid", F.array_join("r.issues", "|").alias("issues"), "r.feedback")


def documented_functions(spark, d):
    """A skill document for each brand, a line for each part."""
    key, word = F.col("p_partkey").cast("string"), F.element_at(F.split("p_name", " "), 1)
    lines = [
        F.concat(F.lit("#### Merge "), word, F.lit("  ")), F.concat(F.lit("def do_"), word, F.lit(" (x):")), F.concat(F.lit("r = Reader"), F.col("p_size"), F.lit("(f).extract_"), F.upper(word), F.lit("(1).Read()")),
        F.concat(F.lit("use `do_"), F.upper(word), F.lit("()` or `t"), key, F.lit("()`")), F.lit("#### Usage"), F.lit("API (see x.go (y) and Setup ())"),
    ]
    line = F.element_at(F.array(*lines), (F.pmod("p_partkey", F.lit(len(lines))) + 1).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l"))))
    docs = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(listed, lambda s: s["l"]), "\n").alias("text"))
    return docs.select("p_brand", F.array_join(parsers.documented_functions(F.col("text")), ",").alias("functions"))


def queries():
    return {
        "incremental_resume": incremental_resume, "retry_feedback": retry_feedback, "retry_feedback_stream": retry_feedback_stream,
        "parse_prm_result": parse_prm_result, "documented_functions": documented_functions,
    }


def oracle_sql():
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    feedback = f"""WITH a AS (SELECT event_id // 3 AS task, CAST(event_id % 3 AS INTEGER) AS attempt, CASE WHEN event_id % 3 = 0 THEN '### Attempt 1 (Initial Execution):' ELSE '### Attempt ' || (event_id % 3 + 1) || ' (Retry ' || (event_id % 3) || '):' END
          || '\n\n' || CASE event_id % 4 WHEN 3 THEN '   Execution failed: exit ' || event_type || '\n\n' WHEN 0 THEN '   No test failures recorded.\n\n'
            ELSE '1. **' || event_type || '_0**\n   Error: user ' || user_id || '\n\n' || CASE WHEN event_id % 4 = 2 THEN '2. **' || event_type || '_1**\n\n' ELSE '' END END AS b FROM events)
        SELECT task, attempt, 'Do ' || task || {quoted(stream.FEEDBACK_HEAD)} || string_agg(b, '') OVER (PARTITION BY task ORDER BY attempt) || '---\nThis is retry ' || (attempt + 1) || ' of 3.\n' || {quoted(stream.FEEDBACK_TAIL)} AS prompt FROM a"""
    found = "list_transform(regexp_extract_all(s, '{}', 1), lambda n: n)"
    headings = ", ".join(quoted(h) for h in parsers.HEADINGS)
    methods = ", ".join(quoted(h) for h in parsers.PLAIN_METHODS)
    return {
        "incremental_resume": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS run, o_custkey * 2 AS done, CAST(NULL AS VARCHAR) AS error FROM orders",
        "retry_feedback": feedback,
        "retry_feedback_stream": feedback,
        "parse_prm_result": """SELECT p_partkey, p_partkey % 6 NOT IN (1, 3) AS is_valid, CASE p_partkey % 6 WHEN 0 THEN 'a' || p_partkey WHEN 3 THEN 'first ' || p_partkey || '|second|An Error here' ELSE '' END AS issues,
          CASE p_partkey % 6 WHEN 0 THEN 'fine' WHEN 3 THEN 'is_valid: false' || chr(10) || ' - first ' || p_partkey || chr(10) || '* second' || chr(10) || 'An Error here' || chr(10) || 'ok'
            WHEN 4 THEN 'Could not parse PRM result, assuming valid.' WHEN 5 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS feedback FROM part""",
        "documented_functions": f"""WITH docs AS (SELECT p_brand, string_agg((['#### Merge ' || w || '  ', 'def do_' || w || ' (x):', 'r = Reader' || p_size || '(f).extract_' || upper(w) || '(1).Read()',
            'use `do_' || upper(w) || '()` or `t' || p_partkey || '()`', '#### Usage', 'API (see x.go (y) and Setup ())'])[CAST(p_partkey % 6 AS INTEGER) + 1], chr(10) ORDER BY p_partkey) AS s
            FROM (SELECT *, split_part(p_name, ' ', 1) AS w FROM part) GROUP BY p_brand),
          names AS (SELECT p_brand, unnest(list_transform(list_concat(list_concat(list_concat(list_concat(list_transform(regexp_extract_all(s, '(?m)^####\\s+(.+)$', 1), lambda h: trim(h)), {found.format('def\\s+(\\w+)\\s*\\(')}),
            {found.format('\\b([A-Z][a-zA-Z0-9]+)\\s*\\(')}), list_filter({found.format('\\.([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(')}, lambda m: lower(m) NOT IN ({methods}) AND length(m) > 2)), {found.format('`(\\w+)\\(\\)`')}),
            lambda n, i: {{'n': n, 'i': i}})) AS x FROM docs),
          first AS (SELECT p_brand, arg_min(x.n, x.i) AS n, min(x.i) AS i FROM names WHERE lower(x.n) NOT IN ({headings}) GROUP BY p_brand, lower(x.n))
          SELECT p_brand, coalesce(string_agg(n, ',' ORDER BY i), '') AS functions FROM docs LEFT JOIN first USING (p_brand) GROUP BY p_brand""",
    }
