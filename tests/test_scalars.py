import time

from pyspark.sql import functions as F

from weft.functions import scalars as s


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_star_count_takes_the_first_that_is_there(spark):
    c = s.star_count("a", "b", "c")
    assert one(spark, c, a=None, b="7", c="1") == 7
    assert one(spark, c, a="x", b="5", c="1") == 0
    assert one(spark, c, a=None, b=None, c=None) == 0


def test_names(spark):
    assert one(spark, s.safe_name(F.col("a")), a="--A b__") == "A-b"
    assert one(spark, s.safe_name(F.col("a")), a="") == "skill"
    assert len(one(spark, s.safe_name(F.col("a")), a="x" * 100)) == 80


def test_clamp(spark):
    assert [one(spark, s.clamp_score(F.col("a")), a=v) for v in ("0", "6", "4", "4.5", None)] == [1, 5, 4, 1, 1]


def test_lists(spark):
    assert one(spark, s.normalize_scenarios(F.col("a")), a=[" X. ", "x", "", "y  z"]) == ["X", "y z"]
    assert one(spark, s.as_int_list(F.col("a")), a=["3", "1", "x", "3"]) == [1, 3]
    assert one(spark, s.default_scenarios(F.col("a"), "none"), a=[]) == ["none"]


def test_model_json(spark):
    for text in ('{"k": 1}', '```json\n{"k": 1}\n```', 'So: {"k": 1}!'):
        assert one(spark, s.parse_model_json(F.col("a"), "k"), a=text) == "1"
    assert one(spark, s.parse_model_json(F.col("a"), "k"), a="garbage") is None


def test_truncation_limits(spark):
    assert one(spark, s.truncate_head_tail(F.col("a")), a="x" * 2000) == "x" * 2000
    cut = one(spark, s.truncate_head_tail(F.col("a")), a="a" * 1400 + "b" + "c" * 600)
    assert cut.startswith("a" * 1400 + "\n") and cut.endswith("c" * 600) and "[1 characters" in cut


def test_commands(spark):
    assert one(spark, s.pip_packages(F.col("a")), a="pip install a b; pip install -q x; python -m pip install z==1") == ["a", "z==1"]
    assert one(spark, s.redirect_targets(F.col("a")), a="echo hi > /o.txt 2>/dev/null") == ["/o.txt"]
    assert one(spark, s.skill_from_path(F.col("a")), a="/x/skills/pdf/SKILL.md") == "pdf"


def test_review(spark):
    row = spark.createDataFrame([(True, True, 1), (True, False, 4), (None, False, 2), (False, False, 1)], "g boolean, r boolean, o int")
    assert [r[0] for r in row.select(s.review_keep(F.col("g"), F.col("r"), F.col("o"))).collect()] == [False, False, True, False]


def test_split_text_reads_each_piece_once(spark):
    """A long text: each window was cut out some twenty times a step, each time from the text's start."""
    text = "".join(f"line {i} \u00e9\n" for i in range(20000))
    want, start = [], 0
    while start < len(text):
        window = text[start : start + 1000]
        last = window.rfind("\n")
        size = last + 1 if start + 1000 < len(text) and last > 500 else len(window)
        want, start = [*want, window[:size].strip()], start + size
    began = time.monotonic()
    assert one(spark, s.split_text(F.col("a"), 1000), a=text) == want
    assert time.monotonic() - began < 10
