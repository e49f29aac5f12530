"""Event-log operators: steps, tool results, summaries, progress and task graphs."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weft.functions import scalars as s
from weft.session import materialize

WALKED = 64  # rows of a graph that is walked in one row


def number_steps(events: DataFrame, session: str, ordinal: str, is_step: Column) -> DataFrame:
    """The steps of each session, numbered from 0 in order."""
    w = Window.partitionBy(session).orderBy(ordinal)
    return events.where(is_step).withColumn("step_id", F.row_number().over(w) - 1)


def pair_results(events: DataFrame, session: str, ordinal: str, is_action: Column, is_result: Column, text: str) -> DataFrame:
    """Each action with the first result after it and before the next action, if any: one window, no self join."""
    w = Window.partitionBy(session).orderBy(ordinal)
    numbered = events.withColumn("_a", F.sum(F.when(is_action, 1).otherwise(0)).over(w)).where("_a > 0")
    grouped = numbered.groupBy(session, F.col("_a").alias("action")).agg(
        F.min_by(text, F.when(is_action, F.col(ordinal))).alias("input"),
        F.min_by(text, F.when(is_result, F.col(ordinal))).alias("output"),
    )
    return grouped.withColumn("action", F.col("action").cast("long"))


def first_result_wins(results: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One result per tool use: the earliest."""
    return results.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(ordinal))).where("_n = 1").drop("_n")


def tool_usage(steps: DataFrame, session: str, tool: str) -> DataFrame:
    return steps.where(F.col(tool).isNotNull()).groupBy(session, tool).agg(F.count(F.lit(1)).alias("uses"))


def tools_by_category(steps: DataFrame, session: str, tool: str, ordinal: str) -> DataFrame:
    """Different tools of each category in order of first use."""
    first = steps.groupBy(session, s.tool_category(F.col(tool)).alias("category"), tool).agg(F.min(ordinal).alias("_o"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("_o", tool))), lambda x: x[tool])
    return first.groupBy(session, "category").agg(named.alias("tools"))


def summary(steps: DataFrame, session: str, tool: str) -> DataFrame:
    """Per session: steps and how many read, write, run commands, use skills or the web."""

    def of(*tools: str) -> Column:
        return F.count_if(F.col(tool).isin(*tools))

    return steps.groupBy(session).agg(
        F.count(F.lit(1)).alias("steps"), F.count_distinct(tool).alias("tools"), of(*s.TOOL_CATEGORIES["file_read"]).alias("reads"),
        of(*s.TOOL_CATEGORIES["file_write"]).alias("writes"), of("Bash").alias("commands"), of("Skill").alias("skills"), of(*s.TOOL_CATEGORIES["web"]).alias("web"),
    )


def validate(sessions: DataFrame, steps: DataFrame, session: str, min_steps: int = 1, require_output: bool = True) -> DataFrame:
    """(session, errors, warnings, valid) of sessions (session, success, outputs) from their steps (session, step_id, action, tool, text).

    ``outputs`` counts a session's output files; a step is a tool use or a text. Sessions without steps are judged too; an unknown
    success is no success.
    """
    writes = F.col("tool").isin(*s.TOOL_CATEGORIES["file_write"])
    uses = F.col("action") == "tool_use"
    wrong = (F.col("action") == "text") & F.lower("text").rlike("error:|exception:|failed to")
    told = steps.groupBy(session).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(uses).alias("_uses"), F.count_if(uses & writes).alias("_writes"), F.array_sort(F.collect_list(F.when(wrong, F.col("step_id")))).alias("_wrong")
    )
    n = F.coalesce("_n", F.lit(0))
    # The messages.
    errors = F.array_compact(F.array(
        F.when(n < min_steps, F.concat(F.lit("Trajectory has "), n, F.lit(f" steps, minimum is {min_steps}"))),
        F.when(F.lit(require_output) & (F.coalesce("outputs", F.lit(0)) == 0) & (F.coalesce("_writes", F.lit(0)) == 0), F.lit("No output files or write operations found")),
        F.when(F.coalesce("_uses", F.lit(0)) == 0, F.lit("No tool use operations found")), F.when(n == 0, F.lit("Trajectory is empty")),
    ))
    suspect = F.transform(F.coalesce("_wrong", F.array().cast("array<int>")), lambda i: F.concat(F.lit("Potential error detected in step "), i))
    warnings = F.array_compact(F.array(F.when(~F.coalesce("success", F.lit(False)), F.lit("Trajectory execution was not successful")), F.when((n > 0) & (n <= 2), F.lit("Trajectory has very few steps"))))
    judged = sessions.select(session, "success", "outputs").join(told, session, "left")
    return judged.select(session, errors.alias("errors"), F.concat(warnings, suspect).alias("warnings"), (F.size(errors) == 0).alias("valid"))


def clip_middle(steps: DataFrame, session: str, most: int) -> DataFrame:
    """Of longer sessions the first and last half of ``most`` steps, and one row that counts the rest."""
    n = F.count(F.lit(1)).over(Window.partitionBy(session))
    head, tail = most // 2, most - most // 2
    sized = steps.withColumn("_n", n)
    kept = sized.where((F.col("_n") <= most) | (F.col("step_id") < head) | (F.col("step_id") >= F.col("_n") - tail))
    notes = sized.where((F.col("_n") > most) & (F.col("step_id") == 0)).select(session, F.lit(head).alias("step_id"), F.concat((F.col("_n") - most).cast("string"), F.lit(" steps left out")).alias("note"))
    return kept.select(session, "step_id", F.lit(None).cast("string").alias("note")).unionByName(notes)


def no_progress_run(progress: DataFrame, session: str, chunk: str, tested: str, stop_at: int = 3) -> DataFrame:
    """Per chunk: how many chunks in a row, up to it, brought no more tested items, and whether to go on."""
    w = Window.partitionBy(session).orderBy(chunk)
    moved = F.coalesce(F.col(tested) > F.lag(tested).over(w), F.lit(True))
    runs = progress.withColumn("_r", F.sum(F.when(moved, 1).otherwise(0)).over(w))
    n = F.row_number().over(Window.partitionBy(session, "_r").orderBy(chunk)) - 1
    return runs.withColumn("no_progress", n).withColumn("go_on", F.col("no_progress") < stop_at).drop("_r")


def coverage_ratio(documented: DataFrame, tested: DataFrame, key: str, item: str) -> DataFrame:
    """(key, documented, tested, coverage): the share of documented items that are tested; 1 if none is documented."""
    hit = tested.select(key, item).distinct().withColumn("_hit", F.lit(1))
    return (
        documented.select(key, item).distinct().join(hit, [key, item], "left").groupBy(key)
        .agg(F.count(item).alias("documented"), F.count("_hit").alias("tested"))
        .withColumn("coverage", F.when(F.col("documented") == 0, 1.0).otherwise(F.round(F.col("tested") / F.col("documented"), 6)))
    )


def ends(edges: DataFrame, task: str) -> DataFrame:
    """(task, node, is_source, is_sink) of each task graph's nodes."""
    parts = edges.select(task, F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                                 F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    tally = parts.groupBy(task, F.col("e.node").alias("node")).agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
    return tally.select(task, "node", (F.col("i") == 0).alias("is_source"), (F.col("o") == 0).alias("is_sink"))


def _grown(edges: DataFrame, task: str, nodes: DataFrame) -> DataFrame:
    """:func:`all_paths` of graphs of any size: paths grow by a step a round, each round written; it ends when none grows."""
    role = materialize(ends(edges, task))
    sinks = role.where("is_sink").select(task, F.col("node").alias("_end"))
    step = materialize(edges.select(task, F.col("source").alias("_s"), F.col("target").alias("_t")).distinct())
    grown = role.where("is_source").select(task, F.array("node").alias("path"))
    found, rounds = role.where("false").select(task, F.array("node").alias("path")), []
    while True:
        longer = (
            grown.withColumn("_s", F.element_at("path", -1)).join(step, [task, "_s"])
            .where(~F.array_contains("path", F.col("_t"))).select(task, F.concat("path", F.array("_t")).alias("path"))
        )
        grown = materialize(longer)
        if not grown.limit(1).count():
            break
        rounds.append(grown)
    for some in rounds:
        done = some.withColumn("_end", F.element_at("path", -1)).join(sinks, [task, "_end"], "left_semi").select(task, "path")
        found = found.unionByName(done)
    every = role.select(task, "node").unionByName(nodes.select(task, "node")).distinct()
    lone = every.join(found.select(task).distinct(), task, "left_anti").select(task, F.array("node").alias("path"))
    return found.unionByName(lone)


def _walked(graphs: DataFrame, task: str) -> DataFrame:
    """:func:`all_paths` of small graphs, (task, _s, _t, _edge) or lone nodes _s: each is walked in its row, its paths leave by batches."""

    def paths(rows: list):
        every, after, before, ends_in, starts = set(), {}, {}, set(), set()
        for s, t, edge in rows:
            every.add(s)
            if edge:
                every.add(t)
                starts.add(s)
                ends_in.add(t)
                if s is not None and t is not None:
                    after.setdefault(s, []).append(t)
                    before.setdefault(t, []).append(s)
        useful = list(ends_in - starts - {None})  # sinks, then what leads to them
        seen = set(useful)
        for n in useful:
            for m in before.get(n, ()):
                if m not in seen:
                    seen.add(m)
                    useful.append(m)
        none = True
        for source in starts - ends_in:
            path, ways = [source], [iter(after.get(source, ()))]
            while ways:
                n = next(ways[-1], ways)
                if n is ways:
                    ways.pop()
                    path.pop()
                elif n in seen and n not in path:
                    if n not in starts:
                        none = False
                        yield [*path, n]
                    else:
                        path.append(n)
                        ways.append(iter(after[n]))
        if none:
            yield from ([n] for n in every)

    kinds = {c: graphs.schema[c].dataType for c in (task, "_s")}
    listed = graphs.groupBy(task).agg(F.collect_set(F.struct("_s", "_t", "_edge")).alias("_g"))
    node = to_arrow_type(kinds["_s"])

    def run(batches):
        for batch in batches:
            at, offsets, flat = [], [0], []

            def made():
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, node))
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), lists], [task, "path"])

            graphs, parts = batch.column(1), batch.column(1).flatten()
            parts = list(zip(*(parts.field(c).to_pylist() for c in ("_s", "_t", "_edge"))))
            ends = np.cumsum(graphs.value_lengths().to_numpy()).tolist()
            for i, (lo, hi) in enumerate(zip([0, *ends], ends)):
                for path in paths(parts[lo:hi]):
                    at.append(i)
                    flat += path
                    offsets.append(len(flat))
                    if len(flat) > 1 << 16:
                        yield made()
                        at, offsets, flat = [], [0], []
            if at:
                yield made()

    return listed.mapInArrow(run, f"`{task}` {kinds[task].simpleString()}, path array<{kinds['_s'].simpleString()}>")


def all_paths(edges: DataFrame, task: str, nodes: DataFrame | None = None) -> DataFrame:
    """(task, path): every path from a source to a sink over different nodes, of any length.

    A task without such a path, one of cycles or of lone ``nodes`` (task, node), has each of its nodes
    as a path; so has a NULL task. Graphs of at most ``WALKED`` edges and nodes are walked in one row each, larger ones
    in rounds of joins.
    """
    given = edges.select(task, F.col("source").alias("_s"), F.col("target").alias("_t"), F.lit(True).alias("_edge"))
    if nodes is not None:
        given = given.unionByName(nodes.select(task, F.col("node").alias("_s"), F.lit(None).cast(edges.schema["target"].dataType).alias("_t"), F.lit(False).alias("_edge")))
    given = materialize(given)
    large = materialize(given.groupBy(task).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > WALKED) | F.col(task).isNull()).select(F.col(task).alias("_large")))
    if not large.limit(1).count():
        return _walked(given, task)
    apart = F.col(task).eqNullSafe(F.col("_large"))
    many = given.join(large, apart, "left_semi")
    rest = _grown(many.where("_edge").select(task, F.col("_s").alias("source"), F.col("_t").alias("target")), task, many.where("NOT _edge").select(task, F.col("_s").alias("node")))
    return _walked(given.join(large, apart, "left_anti"), task).unionByName(rest)


def topological_order(edges: DataFrame, task: str) -> DataFrame:
    """(task, place, node): the smallest ready node first; nodes on cycles are left out. A row holds one task graph."""

    def ordered(pairs: set) -> list:
        """The nodes of an edge set, the smallest ready one first."""
        after: dict = {}
        waits = dict.fromkeys({n for p in pairs for n in p}, 0)
        for a, b in pairs:
            after.setdefault(a, []).append(b)
            waits[b] += 1
        ready, out = [n for n, w in waits.items() if not w], []
        heapq.heapify(ready)
        while ready:
            n = heapq.heappop(ready)
            out.append(n)
            for b in after.get(n, ()):
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(ready, b)
        return out

    kinds = {c: edges.schema[c].dataType.simpleString() for c in (task, "source")}
    graphs = edges.groupBy(task).agg(F.collect_set(F.struct("source", "target")).alias("_e"))
    node = to_arrow_type(edges.schema["source"].dataType)

    def run(batches):
        for batch in batches:
            listed = [ordered({(e["source"], e["target"]) for e in es}) for es in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(listed, pa.list_(node))], [task, "nodes"])

    made = graphs.mapInArrow(run, f"`{task}` {kinds[task]}, nodes array<{kinds['source']}>")
    return made.select(task, F.posexplode("nodes").alias("place", "node"))


def pytest_summary(output: DataFrame, text: str, code: str) -> DataFrame:
    """Counts of a test run's summary line, its rate and whether all passed."""

    def count(word: str) -> Column:
        return F.coalesce(F.regexp_extract(text, rf"(\d+) {word}", 1).try_cast("int"), F.lit(0))

    counted = output.withColumns({"passed": count("passed"), "failed": count("failed"), "errors": count("error"), "skipped": count("skipped")})
    total = F.expr("passed + failed + errors + skipped")
    return counted.withColumns({
        "total": total, "duration": F.coalesce(F.regexp_extract(text, r"in ([0-9.]+)s", 1).try_cast("double"), F.lit(0.0)),
        "success_rate": F.when(total == 0, 0.0).otherwise(F.round(F.col("passed") / total, 6)),
        "all_passed": (F.col(code) == 0) & (F.col("passed") > 0) & (F.col("failed") == 0) & (F.col("errors") == 0),
    })


def retrieval_metrics(predicted: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    """(key, precision, recall, complete) of predicted against gold items."""
    p, g = predicted.select(key, item).distinct().withColumn("_p", F.lit(1)), gold.select(key, item).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [key, item], "full_outer").groupBy(key).agg(F.count("_p").alias("p"), F.count("_g").alias("g"), F.count(F.col("_p") + F.col("_g")).alias("hit"))
    return both.select(
        key, F.when(F.col("p") > 0, F.round(F.col("hit") / F.col("p"), 6)).otherwise(0.0).alias("precision"),
        F.when(F.col("g") > 0, F.round(F.col("hit") / F.col("g"), 6)).otherwise(1.0).alias("recall"), (F.col("hit") == F.col("g")).alias("complete"),
    )


def dag_coverage(paths: DataFrame, tested_paths: DataFrame, edges: DataFrame, tested_edges: DataFrame, functions: DataFrame, tested_functions: DataFrame, task: str) -> DataFrame:
    """(task, path_coverage, edge_coverage, core_function_coverage) of every task that any table names.

    Paths and edges are (task, item): all paths count as often as they are listed, tested ones and edges once, unknown ones
    too, so a share can be over 1. Functions are (task, skill, item): of a skill's, as often as listed, those tested. What a task
    has none of is covered.
    """
    def counted(df: DataFrame, name: str, distinct: bool) -> DataFrame:
        item = F.count_distinct("item") if distinct else F.count("item")
        return df.groupBy(task).agg(item.alias(name))

    hit = functions.select(task, "skill", "item").distinct().join(tested_functions.select(task, "skill", "item").distinct(), [task, "skill", "item"], "left_semi")
    parts = [
        counted(paths, "p", False), counted(tested_paths, "tp", True), counted(edges, "e", True), counted(tested_edges, "te", True),
        counted(functions, "f", False), hit.groupBy(task).agg(F.count(F.lit(1)).alias("tf")),
    ]
    long = None
    for part in parts:
        name = part.columns[-1]
        row = part.select(task, *[(F.col(name) if c == name else F.lit(None).cast("bigint")).alias(c) for c in ("p", "tp", "e", "te", "f", "tf")])
        long = row if long is None else long.unionByName(row)
    whole = long.groupBy(task).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("p", "tp", "e", "te", "f", "tf")])

    def share(tested: str, every: str) -> Column:
        return F.when(F.col(every) == 0, 1.0).otherwise(F.round(F.col(tested) / F.col(every), 6))

    return whole.select(task, share("tp", "p").alias("path_coverage"), share("te", "e").alias("edge_coverage"), share("tf", "f").alias("core_function_coverage"))
