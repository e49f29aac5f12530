"""States, delimited files and profiles against plain Python."""

import ast
import csv
import io
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from weft.functions import filetypes, scanners
from weft.operators import profiles
from weft.sources import files


def states_of(spark, *docs):
    rows = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    return files.states(spark.createDataFrame(rows, "i int, t string"), "t")


def test_state_shapes(spark):
    new = {"skill_names": ["a", "b"], "total_steps": 3, "documented_functions": {"a": ["f", "f", "g"], "b": []}, "tested_functions": {"a": ["f"], "z": ["g"]}, "workflows": [{"name": "w", "steps": [1]}], "should_continue": False, "own": {"x": 1}}
    old = {"skill_name": "pdf", "documented_functions": ["f"], "discovered_functions": [], "total_steps": "many"}
    nameless = {"skill_name": "", "tested_functions": ["q"], "skill_names": None}
    found = states_of(spark, new, old, nameless, {}, "[1]", "{", None, "7")
    got = {r.i: r for r in found.drop("workflows").collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0].skill_names == ["a", "b"] and got[0].total_steps == 3 and got[0].coverage_ratio == pytest.approx(1 / 3)
    assert got[1].skill_names == ["pdf"] and got[1].documented_functions == {"pdf": ["f"]} and got[1].discovered_functions == {"pdf": []} and got[1].total_steps == 0
    assert got[2].skill_names == [] and got[2].tested_functions == {"unknown": ["q"]} and got[2].coverage_ratio == 1.0
    assert got[3].session_id == "" and got[3].exploration_complete is False and got[3].documented_functions == {}
    text = found.select("i", files.state_json().alias("t"))
    back = files.states(text, "t")
    assert {r.i: r.asDict() for r in back.drop("workflows").collect()} == {i: r.asDict() for i, r in got.items()}
    kept = json.loads(text.where("i = 0").first().t)
    assert kept["workflows"] == new["workflows"] and "own" not in kept and "should_continue" not in kept


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_delimited_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", b'x,y,z\n1,2,3\n4,5\n6,7,8,9\n"a,b",caf\xff\xc3\xa9,""\n\n10,11,12\n')
    got = [(r.x, r.y, r.z) for r in files.delimited(spark, path).orderBy("_row").collect()]
    assert got == [("1", "2", "3"), ("4", "5", None), ("a,b", "café", ""), ("10", "11", "12")]
    assert files.delimited(spark, path, limit=2).count() == 2


@pytest.mark.parametrize(("name", "mark"), [("b.tsv", "\t"), ("c.txt", ";"), ("d.txt", "|")])
def test_separators(spark, tmp_path, name, mark):
    path = write(tmp_path / name, "\n".join(mark.join(r) for r in (["k", "v, w"], ["1", "2"], ["3", "4, 5"])))
    assert [tuple(r)[:2] for r in files.delimited(spark, path).orderBy("_row").collect()] == [("1", "2"), ("3", "4, 5")]


TABLE = "n,f,d,c,t,b,e,late\n" + "".join(f"{i},{i / 4 if i % 3 else 'NA'},{'2024-01-0' + str(i) if i < 3 else 'x' + str(i)},{'ab'[i % 2]},v{i},{i % 2 == 0},,{'y' + str(i) if i < 8 else '2024-01-01'}\n" for i in range(10))


def test_column_kinds_in_both_ways(spark, tmp_path):
    path = write(tmp_path / "t.csv", TABLE)
    rows = files.delimited(spark, path)
    names = next(csv.reader(io.StringIO(TABLE)))
    cells = rows.select(F.col("_row").alias("row"), F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])).alias("position", "c")).select("row", "position", "c.*")
    got = {r.name: (r.kind, r.n, r.different, r.missing_ratio) for r in profiles.column_profile(cells).collect()}
    assert {k: v[0] for k, v in got.items()} == {"n": "numeric", "f": "numeric", "d": "datetime", "c": "categorical", "t": "text", "b": "bool", "e": "numeric", "late": "text"}
    assert got["f"][3] == 0.4 and got["e"] == ("numeric", 10, 0, 1.0) and got["c"][2] == 2
    whole = profiles._table(path, TABLE.encode())
    assert whole["column_types"] == {k: v[0] for k, v in got.items()} and whole["row_count"] == 10
    assert whole["missing_value_ratio"] == round(sum(v[3] for v in got.values()) / 8, 3)


def test_router(spark):
    docs = [
        ("a.csv", b""), ("a.json", b"{bad"), ("a.JSON", b"[1,2]"), ("b.xml", b"<a><b/><c/></a>"), ("n.ipynb", b"[]"), ("n2.ipynb", b'{"cells":[{"cell_type":"code","source":"import z\\n","outputs":[]}],"metadata":{"kernelspec":{"language":"R"}}}'),
        ("s.fastq", b"@a\nA\n+\nI\n@b\nA\n+\nI\n"), ("g.geojson", b'{"type":"x"}'), ("x.pdf", b"12"), ("none", None), (None, b"1"), ("c.py", b"def f(:\nimport q\n"),
    ]
    rows = spark.createDataFrame([(p, bytearray(c) if c is not None else None, "kept") for p, c in docs], "path string, content binary, metadata2 string")
    got = {r.path: (r.category, json.loads(r.metadata)) for r in profiles.profile_files(rows).collect()}
    assert got["a.csv"][1]["file_size_bytes"] == 0 and "extraction_error" in got["a.csv"][1]
    assert len(got["a.json"][1]["extraction_error"]) <= 100
    assert got["a.JSON"][1] == {"file_size_bytes": 5, "data_structure": "array", "item_count": 2}
    assert got["b.xml"][1] == {"file_size_bytes": 15, "root_tag": "a", "child_count": 2}
    assert "extraction_error" in got["n.ipynb"][1]
    assert got["n2.ipynb"][1] | {"file_size_bytes": 0} == {"file_size_bytes": 0, "cell_count": 1, "code_cell_count": 1, "markdown_cell_count": 0, "has_outputs": False, "imports": ["z"], "programming_language": "R"}
    assert got["s.fastq"][1]["sample_count"] == 2 and got["g.geojson"][1]["feature_count"] == 0
    assert got["x.pdf"] == ("document", {"file_size_bytes": 2}) and got["none"] == ("unknown", {"file_size_bytes": None}) and got[None][0] == "unknown"
    assert got["c.py"][1] == {"file_size_bytes": 17, "line_count": 3, "programming_language": "python", "imports": ["q"]}


def test_endings(spark):
    paths = ["/a/b.TAR.GZ", ".bashrc", "x.", "a.b/c", "d.py/", None, "..a"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", filetypes.suffix(F.col("p")).alias("s"))
    assert {r.p: r.s for r in rows.collect()} == {"/a/b.TAR.GZ": "gz", ".bashrc": "", "x.": "", "a.b/c": "", "d.py/": "py", None: None, "..a": "a"}


def test_metadata_entries(spark):
    meta = {"z": 1, "row_count": 2, "long": "x" * 200, "language": "en", "extraction_error": "no", "ok": [True, None], "d": {"k": "é"}, "f": 1.0}
    rows = spark.createDataFrame([("n", json.dumps(meta)), ("m", None), ("e", "{}")], "n string, m string")
    one = F.lit("c")
    got = {r.n: r.t for r in rows.select("n", profiles.metadata_text(F.col("n"), one, one, one, F.col("m")).alias("t")).collect()}
    head = "### n\n- **Content Type**: c\n- **Path**: c\n- **Summary**: c"
    assert got["n"] == head + '\n\n**Metadata**:\n  - language: en\n  - row_count: 2\n  - z: 1\n  - ok: True, None\n  - d: {"k": "é"}\n  - f: 1.0\n\n'
    assert got["m"] == head.replace("### n", "### m") + "\n\n" and got["e"].endswith("c\n\n")


def test_long_sources_are_parsed_in_parts():
    """Parts give what the whole tree gives, in memory that the source's length does not set."""
    odd = 'x = """\ndef no(): pass\n"""\nif x:\n    def a(): pass\nelse:\n    import os.path\n@f(\n)\n@g\nclass B:\n    class C:\n        def d(self): pass\ny = [\n\n]\nfrom q.r import s\ndef e(): pass\n'
    nodes = list(ast.walk(ast.parse(odd)))
    for size in (1, 20, 1 << 16):
        levels = {}
        for tree in scanners._trees(odd, size):
            level, depth = [tree], 0
            while level:
                levels.setdefault(depth, []).extend(n.name for n in level if isinstance(n, ast.FunctionDef | ast.ClassDef))
                level, depth = [c for n in level for c in ast.iter_child_nodes(n)], depth + 1
        assert sum(levels.values(), []) == [n.name for n in nodes if isinstance(n, ast.FunctionDef | ast.ClassDef)]
    got = scanners._profile("/m.py", odd)
    assert got["function_names"] == ["e", "a", "d"] and got["class_names"] == ["B", "C"] and got["imports"] == ["os", "q"]
    assert "function_count" not in scanners._profile("/m.py", odd + "z = (")
    long = "".join(f"def f{i}():\n    import p{i % 7}.sub\n" for i in range(30000))
    tracemalloc.start()
    assert scanners._profile("/m.py", long)["function_count"] == 30000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(long)  # the whole tree takes 140 times
