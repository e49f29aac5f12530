"""Tool uses of sessions: what each step read, wrote, searched and ran; results by id; loop summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: For each tool, the field of its input that counts and what it is.
OPERATIONS = [
    ("Write", "file_path", ["output"]),
    ("Edit", "file_path", ["edited", "output"]),
    ("NotebookEdit", "notebook_path", ["notebook", "output"]),
    ("Read", "file_path", ["input"]),
    ("Glob", "pattern", ["glob"]),
    ("Grep", "pattern", ["grep"]),
    ("Skill", "skill", ["skill"]),
    ("Bash", "command", ["command"]),
    ("WebFetch", "url", ["url"]),
    ("WebSearch", "query", ["query"]),
]
FILE_OPERATIONS = {"Write": "create", "Edit": "edit", "Read": "read", "NotebookEdit": "notebook_edit"}
OUTPUT_ROOT = "/root/output"
LIMIT = 10_000  # characters of a result that are kept


def track_operations(steps: DataFrame, session: str, ordinal: str, tool: str = "tool_name", given: str = "tool_input") -> DataFrame:
    """(session, ordinal, kind, value) of steps whose ``given`` is a map of the tool's input; empty values count for nothing."""
    kinds, value = F.array().cast("array<string>"), F.lit(None).cast("string")
    for name, field, said in OPERATIONS:
        here = F.col(tool) == name
        kinds = F.when(here, F.array(*[F.lit(k) for k in said])).otherwise(kinds)
        value = F.when(here, F.try_element_at(F.col(given), F.lit(field))).otherwise(value)
    told = steps.select(session, ordinal, kinds.alias("_k"), value.alias("value")).where(F.coalesce("value", F.lit("")) != "")
    return told.select(session, ordinal, F.explode("_k").alias("kind"), "value")


def of_kind(operations: DataFrame, session: str, *kinds: str) -> DataFrame:
    """(session, value) as often as it occurs."""
    return operations.where(F.col("kind").isin(*kinds)).select(session, "value")


def filtered_files(operations: DataFrame, session: str, root: str = OUTPUT_ROOT) -> DataFrame:
    """(session, side, path): outputs that look like files or were never read, inputs not below the output root."""
    written, read = (of_kind(operations, session, k).distinct() for k in ("output", "input"))
    dotted = F.contains(F.regexp_extract("value", r"([^/]*)$", 1), F.lit("."))
    bare = written.where(~dotted).join(read, [session, "value"], "left_anti")
    outputs = written.where(dotted).unionByName(bare).select(session, F.lit("output").alias("side"), F.col("value").alias("path"))
    inputs = read.where(~F.col("value").startswith(root)).select(session, F.lit("input").alias("side"), F.col("value").alias("path"))
    return outputs.unionByName(inputs)


def file_operations(steps: DataFrame, session: str, ordinal: str, tool: str = "tool_name", given: str = "tool_input") -> DataFrame:
    """(session, ordinal, operation, path): files that steps create, edit or read."""
    name = F.create_map(*[F.lit(x) for pair in FILE_OPERATIONS.items() for x in pair])
    path = F.coalesce(F.try_element_at(F.col(given), F.lit("file_path")), F.try_element_at(F.col(given), F.lit("notebook_path")))
    return steps.where(F.col(tool).isin(*FILE_OPERATIONS) & (F.coalesce(path, F.lit("")) != "")).select(session, ordinal, name[F.col(tool)].alias("operation"), path.alias("path"))


def used_skills(operations: DataFrame, session: str, internal: tuple[str, ...] = ()) -> DataFrame:
    """(session, skill): invoked ones and those whose folders were read or searched, without internal ones."""
    from_path = F.regexp_extract("value", r"/skills/([^/*]+)", 1)
    named = F.when(F.col("kind") == "skill", F.col("value")).when(F.col("kind").isin("input", "glob", "command"), from_path)
    return operations.select(session, named.alias("skill")).where((F.coalesce("skill", F.lit("")) != "") & ~F.col("skill").isin(*internal)).distinct()


def loop_summary(operations: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """(keys, reads, writes, edits): the different files of each loop in order of first use."""
    first = operations.groupBy(*keys, "kind", "value").agg(F.min(ordinal).alias("_o"))

    def of(kind: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_o", "value")))), lambda x: x["value"])

    return first.groupBy(*keys).agg(of("input").alias("reads"), of("output").alias("writes"), of("edited").alias("edits"))


def pair_by_use(uses: DataFrame, results: DataFrame, session: str, use: str, ordinal: str, text: str, limit: int = LIMIT) -> DataFrame:
    """Each tool use with the first later result of its id, cut to ``limit`` characters; NULL without one.

    Uses and results of an id pass one window, last first, that carries the latest result met: no use is joined with all
    later ones. Of results at one place the smallest text counts; a NULL session or id pairs with none.
    """
    kept = F.struct(*uses.columns)
    both = uses.select(F.col(session).alias("_s"), F.col(use).alias("_u"), F.col(ordinal).alias("_o"), F.lit(0).alias("_k"), kept.alias("_row"), F.lit(None).cast("string").alias("_t")).unionByName(
        results.select(F.col(session).alias("_s"), F.col(use).alias("_u"), F.col(ordinal).alias("_o"), F.lit(1).alias("_k"), F.lit(None).cast(uses.select(kept.alias("r")).schema["r"].dataType).alias("_row"), F.substring(text, 1, limit).alias("_t"))
    )
    # At one place uses come before results, which are not later.
    later = Window.partitionBy("_s", "_u").orderBy(F.desc("_o"), "_k", F.desc("_t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = F.last(F.when(F.col("_k") == 1, F.struct("_t")), ignorenulls=True).over(later)
    known = F.col("_s").isNotNull() & F.col("_u").isNotNull()
    found = both.withColumn("output", F.when(known, met["_t"])).where("_k = 0")
    return found.select("_row.*", "output")


def empty_sessions(sessions: DataFrame, steps: DataFrame, session: str) -> DataFrame:
    """(session, steps): every session, those without a step too."""
    n = steps.groupBy(session).agg(F.count(F.lit(1)).alias("steps"))
    return sessions.select(session).distinct().join(n, session, "left").fillna(0, ["steps"])


def last_text(blocks: DataFrame, session: str, ordinal: str, text: str, prefixes: list[str], default: str) -> DataFrame:
    """The last non-empty text of each session without a known prefix, else the default."""
    plain = F.trim(F.regexp_replace(F.trim(text), "^(?:" + "|".join(prefixes) + r")\s*", ""))
    return blocks.groupBy(session).agg(F.coalesce(F.max_by(plain, F.when(F.trim(text) != "", F.col(ordinal))), F.lit(default)).alias("summary"))


def step_preview(steps: DataFrame, session: str, ordinal: str, action: str, response: str, most: int = 20) -> DataFrame:
    """The first and last halves of each session's steps, with previews of 500 and 300 characters."""
    w = Window.partitionBy(session)
    numbered = steps.withColumns({"_n": F.row_number().over(w.orderBy(ordinal)), "_m": F.count(F.lit(1)).over(w)})
    kept = numbered.where((F.col("_m") <= most) | (F.col("_n") <= most // 2) | (F.col("_n") > F.col("_m") - most // 2))
    return kept.select(session, ordinal, F.substring(action, 1, 500).alias("action"), F.substring(response, 1, 300).alias("response"), (F.col("_m") > most).alias("cut"))
