"""Dependencies, sections of answers, written files and scans of paths on hard cases."""

import pytest
from pyspark.sql import functions as F

from weft.functions import sections
from weft.operators import dependencies as deps
from weft.operators import ranking
from weft.sources import files


def test_imports_and_packages(spark):
    code = ["import os, yaml.x\nfrom sklearn.a import b\ndef f():\n    import zz\nfrom . import me", "import a, b\nbroken(\n  from c import d", "", None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(code)], "i int, c string").select("i", deps.imports_of(F.col("c")).alias("m"))
    got = {r.i: (r.m, r.p) for r in rows.select("i", "m", deps.imports_to_packages(F.col("m")).alias("p")).collect()}
    assert got[0] == (["os", "sklearn", "yaml", "zz"], ["PyYAML", "scikit-learn", "zz"])
    assert got[1] == (["a", "c"], ["a", "c"]) and got[2] == ([], []) and got[3] == (None, None)
    own = rows.where("i = 0").select(deps.imports_to_packages(F.col("m"), ["zz"]).alias("p")).first().p
    assert own == ["PyYAML", "os", "scikit-learn"]


def test_dependencies_of_skills_and_runs(spark):
    skill = [("a", "x/requirements.txt", "# c\n-e .\nreq[x]==1\n"), ("a", "x/dependencies.json", '{"pip":["p"],"conda":["c"],"python":">=3"}'), ("a", "y/dependencies.json", "{bad"), ("a", "x/SKILL.md", None), ("b", "scripts/r.py", "import cv2"), ("b", "scripts/deep/r.py", "import no")]
    got = deps.skill_dependencies(spark.createDataFrame(skill, "skill string, path string, text string"))
    assert sorted(map(tuple, got.collect())) == [("a", "conda", "c", "skill_dependencies_json"), ("a", "pip", "p", "skill_dependencies_json"), ("a", "pip", "req[x]", "skill_requirements"), ("b", "pip", "opencv-python", "skill_requirements")]
    steps = [("s", "pip install --user 'q' ; conda install -y -c forge rdkit", None, None), ("s", None, "/a.py", "import json, torch"), ("t", "mamba install -n env x", "/b.md", "import no")]
    run = deps.run_dependencies(spark.createDataFrame(steps, "session string, command string, path string, content string"))
    assert sorted((r.session, r.manager, r.package) for r in run.collect()) == [("s", "conda", "rdkit"), ("s", "pip", "'q'"), ("s", "pip", "torch")]
    assert deps.install_commands(run, "session").collect()[0].asDict() == {"session": "s", "pip": "pip3 install --break-system-packages 'q' torch", "apt": "", "conda": "conda install -y rdkit"}
    frozen = spark.createDataFrame([("s", "New==1"), ("s", "OLD==2"), ("s", "-e git"), (None, "New==1")], "session string, line string")
    base = spark.createDataFrame([("old==1",), ("junk",)], "line string")
    assert sorted(((r.session, r.package) for r in deps.runtime_dependencies(frozen, base).collect()), key=str) == [("s", "New"), (None, "New")]
    assert [(r.package, r.owners) for r in deps.most_needed(run, "session", 2).collect()] == [("'q'", 1), ("rdkit", 1)]


def test_sections(spark):
    answers = ["## task instruction\nA\n##  Execution guide \nB\n## C", "**Goal**: G\n**Key** k", "plain", None, "```\nclass TestX: pass\n```", "intro\nclass TestY: pass", "```python\nx = 1\n```", "# Synthesized Task Instruction\nDo\n---\nrest"]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = {r.i: (r.g.instruction, r.g.guide, r.t, r.c) for r in rows.select("i", sections.goal_and_guide(F.col("a")).alias("g"), sections.task_instruction(F.col("a")).alias("t"), sections.test_code(F.col("a")).alias("c")).collect()}
    assert got[0][:2] == ("A", "B") and got[1][:2] == ("G", "**Key** k") and got[2] == ("plain", "", "plain", None)
    assert got[4][3] == "class TestX: pass" and got[5][3] == "class TestY: pass" and got[6][3] is None and got[7][2] == "Do"


def test_structure_of_written_files(spark):
    rows = spark.createDataFrame([("a.json", "null"), ("b.json", None), ("c.csv", ""), ("d.md", "# a\r\nx"), (None, "x"), ("e.txt", " ")], "p string, c string")
    got = {r.p: r.s.asDict() for r in rows.select("p", sections.output_structure(F.col("p"), F.col("c")).alias("s")).collect()}
    assert got["a.json"]["valid_json"] and got["a.json"]["is_array"] is False and got["a.json"]["keys"] is None
    assert got["b.json"]["valid_json"] is None and got["c.csv"]["row_count"] == 0 and got["c.csv"]["header"] == [""]
    assert got["d.md"]["line_count"] == 2 and got["e.txt"]["line_count"] == 1


def test_paths_names_and_limits(spark, tmp_path):
    for name in ("b.json", "a.json", "c.txt"):
        (tmp_path / name).write_text("x")
    base = str(tmp_path)
    assert files.expand_paths(spark, [f"{base}/c.txt", f"{base}/*.json", f"{base}/?.txt/", "missing", f"{base}/none*"]) == [f"{base}/c.txt", f"{base}/a.json", f"{base}/b.json", "missing"]
    good = spark.createDataFrame([('{"scenarios":[{"scenario_id":1,"canonical_scenario":"a"},{"scenario_id":1},{"canonical_scenario":"b"}],"skill_scenarios":[]}',)], "t string")
    assert [tuple(r) for r in files.scenario_names(good, "t").collect()] == [(1, "")]
    with pytest.raises(Exception, match="must hold the lists"):
        files.scenario_names(spark.createDataFrame([("[]",)], "t string"), "t").collect()
    rows, done = spark.range(10), spark.createDataFrame([(0, True), (1, False)], "id long, ok boolean")
    assert [r.id for r in ranking.first_pending(rows, done, ["id"], F.col("ok"), 3, "id").collect()] == [1, 2, 3]
