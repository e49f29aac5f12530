"""Path rewriting against plain string operations, scanners against the rules done by hand."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from weft.functions import paths, scanners
from weft.operators import paths as path_ops
from weft.operators import sampling


def one_by_one(text, known):
    for p in sorted(known, key=lambda p: (-len(p), p)):
        text = text.replace(p, known[p])
    return text


@pytest.mark.parametrize(("seed", "bound"), [(1, 64 << 20), (2, 40)])
def test_trie_equals_replacing_longest_first(spark, monkeypatch, seed, bound):
    monkeypatch.setattr(path_ops, "TRIE_BYTES", bound)
    rng = random.Random(seed)
    words = ["/a", "/a/b", "/a/b/c", "b/c", "/root/c", "c", "/x y", "é/ü", "/a/b/", "//"]
    known = {w: rng.choice(["/root/c", "", "/a", "q", "/x y/b/c"]) for w in words}
    texts = ["".join(rng.choices([*words, " ", "'", "z"], k=rng.randint(0, 12))) for _ in range(200)] + ["", None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    paths_table = spark.createDataFrame([*known.items(), ("", "never"), (None, "never"), ("c", "zzz")], "path string, to string")
    got = {r.id: r.text for r in path_ops.rewrite_with_trie(table, paths_table, target_col="to").collect()}
    known["c"] = min(known["c"], "zzz")
    assert got == {i: one_by_one(t, known) if t else t for i, t in enumerate(texts)}


def test_known_paths_of_an_owner(spark):
    texts = spark.createDataFrame([(1, "/d/in.csv.bak /d/in.csv in.csv x/root/output/in.csv"), (2, "/d/in.csv"), (3, None)], "task long, text string")
    known = spark.createDataFrame([(1, "/d/in.csv", 1), (1, "/d/in.csv.bak", 2), (1, None, 3), (1, "", 4)], "task long, path string, ord int")
    got = {r.task: r.text for r in path_ops.rewrite_by_owner(texts, known, "task").collect()}
    assert got == {1: "/root/in.csv.bak /root/in.csv in.csv x/root/in.csv", 2: "/d/in.csv", 3: None}


def test_scripts_and_heredocs(spark):
    script = "cd /root/harbor_workspaces/t1\nwget http://x//y //z///q\npython3 <<'EOF'\nopen('/tmp/harbor_a/input/f')\nEOF\npython << X\n\n1\nX\n"
    rows = spark.createDataFrame([(script,), (None,), ("",)], "s string").select(paths.normalize_script(F.col("s")).alias("s")).collect()
    assert [r.s for r in rows] == ["cd /root/\nwget http://x/y /z/q\npython3 << 'EOF'open('/root/f')\nEOF\npython3 << 'X'1\nX\n", None, ""]


def test_container_and_messages(spark):
    row = spark.createDataFrame([("cp '/o/a.b' /root/input/a.b /root/workspace/aXb", ["/o/a.b", None, ""])], "s string, i array<string>")
    got = row.select(paths.normalize_for_container(F.col("s"), F.col("i")).alias("s")).first().s
    assert got == 'cp "/root/a.b" /root/a.b /root/aXb'  # flattened before the input is looked for
    told = spark.createDataFrame([("x '/in/a.csv/' '/root/harbor_workspaces/q/z' /tmp/harbor_1/k", ["/any/a.csv"])], "s string, i array<string>")
    assert told.select(paths.invalid_paths(F.col("s"), F.col("i")).alias("m")).first().m == [
        "Input file path mismatch: /in/a.csv/ (expected /root/a.csv)",
        "Workspace path not normalized: /root/harbor_workspaces/q/z",
        "Workspace path not normalized: /tmp/harbor_1/k",
    ]


def test_flatten_workspace_without_workspace(spark):
    row = spark.createDataFrame([("/root/harbor_workspaces/t/final_res/o.json /root/input/a",)], "s string")
    assert row.select(paths.flatten_workspace(F.col("s"), F.lit(None).cast("string")).alias("s")).first().s == "/root/o.json /root/a"


def test_last_copy_of_a_name_wins(spark):
    files = spark.createDataFrame([("/a/x",), ("/b/y/",), ("/c/z",), (None,)], "path string")
    copied = spark.createDataFrame([("/o/x", "/w/1", 1), ("/p/x", "/w/2", 2), ("/o/y", "/w/y", 1), ("/o/z", None, 1)], "path string, new_path string, ord int")
    assert sorted((r.path for r in path_ops.remap_by_name(files, copied).collect()), key=str) == ["/c/z", "/w/2", "/w/y", None]


BRACES = re.compile(r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}", re.DOTALL)


def test_first_braces_equals_the_nested_pattern():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choices("{}{}ab\n", k=rng.randint(0, 16)))
        m = BRACES.search(text)
        assert scanners.first_braces(text) == (m[0] if m else None), text
    assert scanners.first_braces("{" * 100_000 + "{}") == "{}"


def test_filter_json(spark):
    answers = ['{"a": 1}', '{"a": 1} x', "```\n[1]\n```", "```json\n{bad}\n``` {\"k\": \"}\"}", '{"k": "{"}', "null", "", None, "x {'a': 1}", '```json\n{"b": 2}\n```']
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = {r.i: r.j for r in rows.select("i", scanners.parse_filter_json(F.col("a")).alias("j")).collect()}
    assert [got[i] and json.loads(got[i]) for i in range(len(answers))] == [{"a": 1}, {"a": 1}, [1], None, {"k": "{"}, None, None, None, None, {"b": 2}]


def test_sanitize_and_constants(spark):
    script = "import os\n  from test_x import (a, # (\n b)\n)\nimport test_y\nfrom expectation_tests import q\nkeep()\nfrom test_z import (\n never closed"
    source = "A = 1\n# B = 2\nC = [\n  1, # x\n  # gone\n\n  '[',\n]\nD = 2\n  E = 3\nlower = 1\ndef f():\n    G = 1\nH=(\n1\n)\nI_2 = {\n"
    row = spark.createDataFrame([(script, source), (None, None), ("", "")], "s string, c string")
    got = row.select(scanners.sanitize_script(F.col("s")).alias("s"), scanners.extract_constants(F.col("c")).alias("c")).collect()
    assert got[0].s == "import os\nkeep()" and (got[1].s, got[1].c, got[2].s, got[2].c) == (None, None, "", "")
    assert got[0].c == "A = 1"  # the bracket in a string keeps C open, as the rule counts every bracket
    plain = spark.createDataFrame([(source.replace("'['", "'x'"),)], "c string").select(scanners.extract_constants(F.col("c")).alias("c")).first().c
    assert plain == "A = 1\nC = [\n  1, # x\n  'x',\n]\n\nD = 2\nH=(\n1\n)\n"


def test_code_profile(spark):
    source = '"""def no(): pass"""\nimport os.path, sys\nfrom a.b import c\nfrom . import d\nclass A:\n    class B: pass\n    def m(self):\n        def inner(): pass\nasync def z(): pass\ndef f(): import json\n'
    files = [("/x/a.py", source), ("b.PY", "import x\nfrom y import (\n"), ("c.js", "import q"), ("noext", ""), (".py", "x"), (None, None), ("d.py", None)]
    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "i int, p string, s string")
    got = {r.i: r.x.asDict() for r in rows.select("i", scanners.code_profile(F.col("p"), F.col("s")).alias("x")).collect()}
    assert got[0] == {"line_count": 11, "programming_language": "python", "function_count": 3, "function_names": ["f", "m", "inner"], "class_count": 2, "class_names": ["A", "B"], "imports": ["a", "json", "os", "sys"]}
    assert got[1]["imports"] == ["x", "y"] and got[1]["function_count"] is None
    assert (got[2]["programming_language"], got[3]["line_count"], got[4]["programming_language"], got[5]["line_count"]) == ("javascript", 1, "unknown", None)
    assert got[6]["programming_language"] == "python" and got[6]["imports"] is None


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit("g"), F.col("id") % 3).alias("g"))
    draw = lambda r, seed=7: sorted(x.id for x in sampling.sample(r, "id", 10, seed).collect())
    assert draw(rows) == draw(rows.repartition(9)) != draw(rows, 8) and len(draw(rows)) == 10
    assert sampling.sample(rows.limit(0), "id", 3, 1).count() == 0 and sampling.sample(rows.limit(2), "id", 3, 1).count() == 2
    parts = sampling.sample_per_group(rows.unionByName(spark.createDataFrame([(None, None)], "id long, g string")), ["g"], "id", 4, 1)
    assert sorted((r.g, r["count"]) for r in parts.where("g IS NOT NULL").groupBy("g").count().collect()) == [("g0", 4), ("g1", 4), ("g2", 4)]
