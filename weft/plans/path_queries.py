"""Registered queries of path rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import paths
from weft.operators import paths as path_ops
from weft.session import table


def _name():
    return F.replace("p_name", F.lit(" "), F.lit("-"))


def _choice(*values):
    return F.element_at(F.array(*values), (F.pmod(F.col("p_partkey"), F.lit(len(values))) + 1).cast("int"))


def _lit(*values):
    return [F.lit(v) for v in values]


def normalize_workspace_paths(spark, d):
    folder = _choice(*_lit("/root/harbor_workspaces/t1/input/", "/root/harbor_workspaces/t1/final_res//", "/tmp/harbor_exploration/e5/", "/tmp/solve_verify_9/", "/ossfs/workspace/a/b/output/", "/root/input/", "/home/x/", "/work/own/input/"))
    text = F.concat(F.lit("cat "), folder, _name(), F.lit(" > /root//output/"), F.col("p_partkey"), F.lit("; ls /work/own"))
    return table(spark, d, "part").select("p_partkey", paths.flatten_workspace(text, F.lit("/work/own/")).alias("text"))


def normalize_known_paths(spark, d):
    """A text for each order that names its line items' files by their full paths, some of which begin with others, and a path no one knows."""
    li = table(spark, d, "lineitem")
    known = li.select("l_orderkey", F.concat(F.lit("/share/"), F.col("l_returnflag"), F.when(F.col("l_linenumber") % 2 == 0, "/deep/f").otherwise("/f"), F.col("l_linenumber")).alias("path"), F.col("l_linenumber").alias("ord"))
    listed = known.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda s: F.concat(s["path"], F.lit("x"))), " ").alias("text"))
    texts = listed.withColumn("text", F.concat("text", F.lit(" '/tmp/harbor_exploration/e/input/q.csv' /root/output/f1 (/data/input/z.txt)")))
    return path_ops.rewrite_by_owner(texts, known, "l_orderkey")


def rewrite_with_trie(spark, d):
    """Comments of orders as lists of part names, each name known to the trie."""
    part, li = table(spark, d, "part"), table(spark, d, "lineitem")
    known = part.select(F.concat(F.lit("/p/"), F.element_at(F.split("p_name", " "), 1), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/"), F.col("p_size"))).otherwise("")).alias("path"))
    named = li.join(part, li.l_partkey == part.p_partkey).select("l_orderkey", "l_linenumber", F.concat(F.lit("/p/"), F.element_at(F.split("p_name", " "), 1), F.lit("/"), F.col("p_size")).alias("t"))
    texts = named.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))), lambda s: s["t"]), " ").alias("text"))
    return path_ops.rewrite_with_trie(texts, known)


def _script():
    folder = _choice(*_lit("/root/harbor_workspaces/t-2/input/", "/root/.harbor/workspaces/w/output/", "/tmp/harbor_77/", "/root/input/", "/data//raw/", "/root/workspace/final_res/"))
    body = F.concat(F.lit("curl http://a.b//c -o "), folder, _name(), F.lit(".csv\n"))
    code = F.concat(F.lit("python <<EOF\nopen('/root/input/"), folder, F.lit("x')\nEOF\necho '"), folder, F.lit("y.txt'"))
    return F.concat(body, F.when(F.col("p_size") % 2 == 0, code).otherwise("true"))


def normalize_script_paths(spark, d):
    return table(spark, d, "part").select("p_partkey", paths.normalize_script(_script()).alias("script"))


def normalize_for_container(spark, d):
    inputs = F.array(F.concat(F.lit("/data/raw/"), _name(), F.lit(".csv")), F.lit("y.txt"))
    return table(spark, d, "part").select("p_partkey", paths.normalize_for_container(_script(), inputs).alias("script"))


def validate_paths(spark, d):
    inputs = F.array(F.lit("y.txt"), F.concat(_name(), F.lit(".csv")))
    return table(spark, d, "part").select("p_partkey", F.array_join(paths.invalid_paths(F.concat(_script(), F.lit("\ncat '/in/y.txt/'")), inputs), "|").alias("issues"))


def path_remap(spark, d):
    """Parts' files follow the last copy of a file of the same name, made for the part's line items."""
    name = F.concat(F.lit("f"), F.pmod("l_partkey", F.lit(1500)))
    copied = table(spark, d, "lineitem").select(F.concat(F.lit("/orig/"), F.col("l_returnflag"), F.lit("/"), name).alias("path"), F.when(F.col("l_linenumber") < 6, F.concat(F.lit("/ws/"), F.col("l_orderkey"), F.lit("/"), name)).otherwise("").alias("new_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    files = table(spark, d, "part").select("p_partkey", F.concat(F.lit("/mnt/f"), F.col("p_partkey")).alias("path"))
    return path_ops.remap_by_name(files, copied)


def queries():
    return {
        "normalize_workspace_paths": normalize_workspace_paths, "normalize_known_paths": normalize_known_paths, "rewrite_with_trie": rewrite_with_trie,
        "normalize_script_paths": normalize_script_paths, "normalize_for_container": normalize_for_container, "validate_paths": validate_paths, "path_remap": path_remap,
    }


def _rewrite(text, rules):
    """Nested replacements in SQL."""
    for rule, to in rules:
        text = f"regexp_replace({text}, '{rule.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return text


def _choice_sql(*values):
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST(p_partkey % {len(values)} AS INTEGER) + 1]"


_SLASHES = ("(^|[^:])//+", "\\1/")
_FOLDER = _choice_sql("/root/harbor_workspaces/t-2/input/", "/root/.harbor/workspaces/w/output/", "/tmp/harbor_77/", "/root/input/", "/data//raw/", "/root/workspace/final_res/")
_SCRIPT = f"""(SELECT p_partkey, replace(p_name, ' ', '-') AS n, 'curl http://a.b//c -o ' || {_FOLDER} || replace(p_name, ' ', '-') || '.csv' || chr(10) || CASE WHEN p_size % 2 = 0
  THEN 'python <<EOF' || chr(10) || 'open(''/root/input/' || {_FOLDER} || 'x'')' || chr(10) || 'EOF' || chr(10) || 'echo ''' || {_FOLDER} || 'y.txt''' ELSE 'true' END AS s FROM part)"""
_ONCE = [(r, "/root/") for r in paths.SCRIPT_RULES] + [_SLASHES]
_FLAT = [(f"/root/{f}([^/\\s\"']+)", "/root/\\1") for f in paths.SCRIPT_FOLDERS]


def _normalized(text):
    # The heredocs of these scripts end with EOF; rules are applied to their code once more, which other text does not need.
    out = _rewrite(text, _ONCE + _FLAT)
    return _rewrite(_rewrite(out, [("python3?\\s*<<\\s*['\"]?EOF['\"]?\\s*", "python3 << ''EOF''")]), _ONCE)


_KNOWN = [(r.replace("(?<![a-zA-Z0-9])", "(^|[^a-zA-Z0-9])"), "\\1/root/\\2" if "?<!" in r else "/root/\\1") for r in paths.FILE_RULES]


def oracle_sql():
    folder = _choice_sql("/root/harbor_workspaces/t1/input/", "/root/harbor_workspaces/t1/final_res//", "/tmp/harbor_exploration/e5/", "/tmp/solve_verify_9/", "/ossfs/workspace/a/b/output/", "/root/input/", "/home/x/", "/work/own/input/")
    flat = "replace(replace(t, '/work/own/', '/root/'), '/work/own', '/root')"
    flat = _rewrite(flat, [(r, "/root/") for r in paths.FLAT_RULES])
    for f in paths.FLAT_FOLDERS:
        flat = f"replace({flat}, '{f}', '/root/')"
    folded = "list_reduce(list_prepend({start}, {list}), lambda t, p: replace(t, p, '/root/' || regexp_extract(p, '([^/]*)/*$', 1)))"
    return {
        "normalize_workspace_paths": f"""SELECT p_partkey, {_rewrite(flat, [('/root/+', '/root/')])} AS text
          FROM (SELECT p_partkey, 'cat ' || {folder} || replace(p_name, ' ', '-') || ' > /root//output/' || p_partkey || '; ls /work/own' AS t FROM part)""",
        "normalize_known_paths": f"""WITH k AS (SELECT l_orderkey, l_linenumber AS o, '/share/' || l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN '/deep/f' ELSE '/f' END || l_linenumber AS p FROM lineitem),
          g AS (SELECT l_orderkey, string_agg(p || 'x', ' ' ORDER BY o, p) || ' ''/tmp/harbor_exploration/e/input/q.csv'' /root/output/f1 (/data/input/z.txt)' AS t,
            list(p ORDER BY length(p) DESC, o, p) AS ps, list(DISTINCT regexp_extract(p, '([^/]*)/*$', 1)) AS ns FROM k GROUP BY 1),
          r AS (SELECT l_orderkey, ns, {folded.format(start='t', list='ps')} AS t FROM g), f AS (SELECT l_orderkey, ns, {_rewrite('t', _KNOWN)} AS t FROM r)
          SELECT l_orderkey, list_reduce(list_prepend(t, ns), lambda t, n: replace(t, '/root/output/' || n, '/root/' || n)) AS text FROM f""",
        "rewrite_with_trie": f"""WITH known AS (SELECT DISTINCT '/p/' || split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 2 = 0 THEN '/' || p_size ELSE '' END AS p FROM part),
          ps AS (SELECT list(p ORDER BY length(p) DESC, p) AS ps FROM known),
          t AS (SELECT l_orderkey, string_agg('/p/' || split_part(p_name, ' ', 1) || '/' || p_size, ' ' ORDER BY l_linenumber, '/p/' || split_part(p_name, ' ', 1) || '/' || p_size) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
          SELECT l_orderkey, {folded.format(start='t', list='(SELECT ps FROM ps)')} AS text FROM t""",
        "normalize_script_paths": f"SELECT p_partkey, {_normalized('s')} AS script FROM {_SCRIPT}",
        "normalize_for_container": f"""WITH a AS (SELECT p_partkey, n, {_normalized('s')} AS s FROM {_SCRIPT}),
          b AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(s, '["'']?/data/raw/' || n || '[.]csv["'']?', '"/root/' || n || '.csv"', 'g'),
            '/root/input/' || n || '[.]csv', '"/root/' || n || '.csv"', 'g'), '/root/workspace/' || n || '[.]csv', '"/root/' || n || '.csv"', 'g') AS s FROM a),
          c AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(s, '["'']?y[.]txt["'']?', '"/root/y.txt"', 'g'), '/root/input/y[.]txt', '"/root/y.txt"', 'g'), '/root/workspace/y[.]txt', '"/root/y.txt"', 'g') AS s FROM b)
          SELECT p_partkey, {_rewrite('s', [("/root/output/([^/\\s\"']+)", "/root/\\1"), _SLASHES])} AS script FROM c""",
        "validate_paths": f"""WITH a AS (SELECT p_partkey, s || chr(10) || 'cat ''/in/y.txt/''' AS s FROM {_SCRIPT}),
          b AS (SELECT p_partkey, list_sort(list_distinct(list_filter(list_concat(list_concat(regexp_extract_all(s, '["''](/[^"''<>\\s]+)["'']', 1), regexp_extract_all(s, '\\s(/root/[^\\s"''<>]+)', 1)),
            regexp_extract_all(s, '(/tmp/[^\\s"''<>]+)', 1)), lambda p: NOT ends_with(p, ':') AND NOT contains(p, '://')))) AS ps FROM a)
          SELECT p_partkey, array_to_string(list_filter(flatten(list_transform(ps, lambda p: [CASE WHEN regexp_matches(p, '^({'|'.join(r.replace(chr(39), chr(39) * 2) for r in paths.SCRIPT_RULES)})') THEN 'Workspace path not normalized: ' || p END,
            CASE WHEN p = '/in/y.txt/' THEN 'Input file path mismatch: /in/y.txt/ (expected /root/y.txt)' END])), lambda m: m IS NOT NULL), '|') AS issues FROM b""",
        "path_remap": """WITH c AS (SELECT 'f' || (l_partkey % 1500) AS n, max_by(CASE WHEN l_linenumber < 6 THEN '/ws/' || l_orderkey || '/f' || (l_partkey % 1500) ELSE '' END, l_orderkey * 10 + l_linenumber) AS new FROM lineitem GROUP BY 1)
          SELECT p_partkey, coalesce(nullif(new, ''), '/mnt/f' || p_partkey) AS path FROM part LEFT JOIN c ON n = 'f' || p_partkey""",
    }
