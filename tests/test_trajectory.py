"""Judgements of runs and coverage of task graphs on hard cases."""

from weft.operators import trajectory


def test_judgements_of_runs(spark):
    sessions = spark.createDataFrame([("a", True, 0), ("b", None, 1), ("c", False, 0), (None, True, 0)], "s string, success boolean, outputs int")
    steps = spark.createDataFrame(
        [("a", 0, "tool_use", "Write", None), ("a", 1, "text", None, "ERROR: no"), ("a", 2, "text", None, "fine"), ("a", 3, "tool_use", "Bash", "failed to"), ("b", 0, "text", None, "failed to Exception: x"), ("b", 1, "text", None, None), ("x", 0, "text", None, "y")],
        "s string, step_id int, action string, tool string, text string",
    )
    got = {r.s: (r.errors, r.warnings, r.valid) for r in trajectory.validate(sessions, steps, "s").collect()}
    assert got["a"] == ([], ["Potential error detected in step 1"], True)
    assert got["b"] == (["No tool use operations found"], ["Trajectory execution was not successful", "Trajectory has very few steps", "Potential error detected in step 0"], False)
    assert got["c"][0] == ["Trajectory has 0 steps, minimum is 1", "No output files or write operations found", "No tool use operations found", "Trajectory is empty"]
    assert set(got) == {"a", "b", "c", None}
    assert trajectory.validate(sessions, steps, "s", require_output=False).where("s = 'c'").first().errors[0].startswith("Trajectory has 0")


def test_coverage_of_graphs(spark):
    def of(rows, *columns):
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))

    two, three = ("t", "item"), ("t", "skill", "item")
    got = trajectory.dag_coverage(
        of([("a", "p"), ("a", "p"), ("a", "q")], *two), of([("a", "p"), ("a", "x"), ("a", "y"), ("a", "z"), ("b", "p")], *two), of([("a", "e"), ("a", "e"), ("a", "f")], *two), of([("a", "e")], *two),
        of([("a", "s", "f"), ("a", "s", "f"), ("a", "r", "f"), ("c", "s", "g")], *three), of([("a", "s", "f"), ("a", "s", "own"), ("c", "r", "g")], *three), "t",
    )
    assert {r.t: tuple(r)[1:] for r in got.collect()} == {"a": (1.333333, 0.5, 0.333333), "b": (1.0, 1.0, 1.0), "c": (1.0, 1.0, 0.0)}
