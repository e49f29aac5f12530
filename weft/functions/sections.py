"""Named parts of model answers, structure of written files and summaries of runs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _first(text: Column, pattern: str) -> tuple[Column, Column]:
    """Whether a pattern is found, and its first group without blanks at its ends."""
    return text.rlike(pattern), _strip(F.regexp_extract(text, pattern, 1))


def task_instruction(answer: Column) -> Column:
    """What follows the heading of a synthesized instruction, up to the next heading or rule; all of an answer without it."""
    there, body = _first(answer, r"(?is)#\s*Synthesized\s*Task\s*Instruction\s*\n(.*)")
    for mark in ("# ", "## ", "---"):
        body = _strip(F.substring_index(body, mark, 1))
    return F.when(there, body).otherwise(_strip(answer))


def goal_and_guide(answer: Column) -> Column:
    """(instruction, guide) of an answer: its two sections, else its goal and what follows, else all of it and nothing."""
    task, instruction = _first(answer, r"(?is)##\s*Task\s*Instruction\s*\n(.*?)(?=##\s*Execution\s*Guide|\z)")
    guided, guide = _first(answer, r"(?is)##\s*Execution\s*Guide\s*\n(.*?)(?=##|\z)")
    goal_rule = r"(?s)\*\*Goal\*\*:\s*(.*?)(?=\*\*Expected|\*\*Key|\z)"
    goal, aim = _first(answer, goal_rule)
    whole = F.regexp_extract(answer, goal_rule, 0)
    after = _strip(F.substring(answer, F.position(whole, answer) + F.length(whole), F.length(answer)))
    by_goal = ~task & goal
    return F.struct(
        F.when(by_goal, aim).when(task, instruction).otherwise(_strip(answer)).alias("instruction"), F.when(by_goal, after).when(guided, guide).otherwise("").alias("guide")
    )


def test_code(answer: Column) -> Column:
    """Python tests of an answer: its first fence that holds some, else the answer from its first line of code; NULL without tests."""
    def tests(text: Column) -> Column:
        return F.contains(text, F.lit("def test_")) | F.contains(text, F.lit("class Test"))

    fences = [F.regexp_extract(answer, rule, 1) for rule in (r"(?s)```python\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```")]
    lines = F.split(answer, "\n")
    begins = F.array_position(F.transform(lines, lambda x: x.rlike('^(?:import |from |"""|class )')), F.lit(True)).cast("int")
    bare = F.array_join(F.slice(lines, F.greatest(begins, F.lit(1)), F.size(lines)), "\n")
    return F.when(tests(fences[0]), fences[0]).when(tests(fences[1]), fences[1]).when(tests(answer), bare)


STRUCTURE = "extension string, content_length int, valid_json boolean, is_array boolean, keys array<string>, header array<string>, row_count int, line_count int, headers array<string>"


def output_structure(path: Column, content: Column) -> Column:
    """What a written file holds, by ending: keys of JSON, header and rows of CSV, lines and headings of text."""
    def json_parts(texts: pd.Series) -> pd.DataFrame:
        out = {"valid": [], "array": [], "keys": []}
        for t in texts:
            try:
                data, good = (None, None) if t is None else (json.loads(t), True)
            except (json.JSONDecodeError, RecursionError):
                data, good = None, False
            out["valid"].append(good)
            out["array"].append(isinstance(data, list) if good else None)
            out["keys"].append(list(data) if isinstance(data, dict) else None)
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in out.items()})

    ending = F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")
    parts = F.pandas_udf(json_parts, "valid boolean, array boolean, keys array<string>")(F.when(ending == "json", content))
    lines = F.split(_strip(content), "\n")
    text = ending.isin("md", "txt")
    return F.struct(
        ending.alias("extension"), F.length(content).alias("content_length"), parts["valid"].alias("valid_json"), parts["array"].alias("is_array"), parts["keys"].alias("keys"),
        F.when(ending == "csv", F.split(F.get(lines, 0), ",")).alias("header"), F.when(ending == "csv", F.size(lines) - 1).alias("row_count"), F.when(text, F.size(lines)).alias("line_count"),
        F.when(ending == "md", F.slice(F.filter(lines, lambda x: F.startswith(x, F.lit("#"))), 1, 5)).alias("headers"),
    )


def run_summary(session: Column, steps: Column, success: Column, tools: Column, created: Column, inputs: Column) -> Column:
    """A run in words: its tools with their counts (an array of (name, n), told by name), the first five files it made, its inputs."""
    used = F.array_join(F.transform(F.array_sort(tools), lambda t: F.concat_ws(":", t["name"], t["n"].cast("string"))), ", ")
    made = F.array_join(F.transform(F.slice(created, 1, 5), lambda f: F.concat(F.lit("\n  - "), f)), "")
    more = F.when(F.size(created) > 5, F.concat(F.lit("\n  ... and "), F.size(created) - 5, F.lit(" more"))).otherwise("")
    return F.concat(
        F.lit("Session: "), session, F.lit("\nSteps: "), steps, F.lit("\nSuccess: "), F.initcap(success.cast("string")), F.when(F.size(tools) > 0, F.concat(F.lit("\nTools used: "), used)).otherwise(""),
        F.when(F.size(created) > 0, F.concat(F.lit("\nFiles created: "), F.size(created), made, more)).otherwise(""), F.when(F.size(inputs) > 0, F.concat(F.lit("\nInput files: "), F.size(inputs))).otherwise(""),
    )


# The fields of an alignment's evidence and of a task's topology.
EVIDENCE = ["alignment_id", "source_post_scenario_id", "source_post_scenario", "target_pre_scenario_id", "target_pre_scenario", "retrieval_score", "alignment_type", "confidence", "reason"]
TOPOLOGY = ["skills", "skill_connections", "structure_type", "category", "difficulty"]


def edge_evidence() -> Column:
    """The evidence of an alignment row as one struct."""
    return F.struct(*EVIDENCE)


def task_topology() -> Column:
    """The shape of a task row as one struct; missing lists are empty."""
    empty = F.array().cast("array<string>")
    return F.struct(*[F.coalesce(c, empty).alias(c) if c.startswith("skill") else F.col(c) for c in TOPOLOGY])
