"""Readers and writers of the shapes that tools leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def query_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(index, query) of JSON files holding ``query_seeds``: a list of strings."""
    raw = spark.read.schema("query_seeds array<string>").json(path, multiLine=True)
    return raw.select(F.posexplode("query_seeds").alias("index", "query"))


def rows_of(payload: Column, key: str, row_type: str) -> Column:
    """Rows of a JSON text that is an array of objects, or an object holding one under ``key``; anything else gives none."""
    listed = F.from_json(payload, f"array<{row_type}>")
    held = F.from_json(payload, f"struct<{key}: array<{row_type}>>")[key]
    return F.when(F.startswith(F.ltrim(payload), F.lit("[")), listed).otherwise(held)


def polymorphic_rows(payloads: DataFrame, text: str, key: str, row_type: str) -> DataFrame:
    """The payloads' other columns with each row's fields; payloads without rows vanish."""
    rest = [c for c in payloads.columns if c != text]
    return payloads.select(*rest, F.explode(rows_of(F.col(text), key, row_type)).alias("_r")).where("_r IS NOT NULL").select(*rest, "_r.*")


def read_polymorphic(spark: SparkSession, path: str, key: str, row_type: str) -> DataFrame:
    return polymorphic_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "_t"), "_t", key, row_type)


_ENTITY = "task_id: string, entity_record_id: string, entity_name: string, name: string, entity_url: string, url: string, entity_type: string, type: string, keep: boolean"


def entities(payloads: DataFrame, text: str, require_keep: bool = True) -> DataFrame:
    """(task_id, entity_record_id, entity_name, entity_type, url, keep) of entity payloads in their six shapes.

    An object holds rows under ``entities`` or ``evaluations``, tasks with their ``upstream_input_entities`` under ``tasks``,
    those of one task, or is one row itself; an array holds tasks with their entities, if one has some, or rows.
    An entity of a task has its task's id and number unless it names its own. Rows without task or address are left out,
    with ``require_keep`` those whose ``keep`` is false; a NULL one stays. Payloads of no such shape give no rows.
    """
    row, under = f"struct<{_ENTITY}>", "upstream_input_entities"
    whole = F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("{")), F.col(text)), f"struct<entities: array<string>, evaluations: array<string>, tasks: array<string>, {under}: array<string>, {_ENTITY}>")
    listed = F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("[")), F.col(text)), "array<string>")
    names = [x.split(":")[0] for x in _ENTITY.split(", ")]

    def objects(items: Column, kind: str) -> Column:
        """Items of a list as objects, NULL in the place of others."""
        return F.transform(items, lambda x: F.from_json(F.when(F.startswith(F.ltrim(x), F.lit("{")), x), kind))

    def of_task(task: Column) -> Column:
        own = F.coalesce(task["task_id"], F.lit(""))

        def one(e: Column, i: Column) -> Column:
            told = {"task_id": F.coalesce(e["task_id"], own), "entity_record_id": F.coalesce(e["entity_record_id"], F.format_string("%s::entity-%03d", own, i + 1))}
            return F.when(e.isNotNull(), F.struct(*[told.get(n, e[n]).alias(n) for n in names]))

        return F.transform(objects(F.coalesce(task[under], F.array().cast("array<string>")), row), one)

    def of_tasks(items: Column) -> Column:
        tasks = objects(items, f"struct<task_id: string, {under}: array<string>>")
        return F.flatten(F.transform(F.filter(tasks, lambda t: t.isNotNull()), of_task))

    parents = F.exists(objects(listed, f"struct<{under}: array<string>>"), lambda x: x[under].isNotNull())
    shapes = F.coalesce(
        objects(whole["entities"], row), objects(whole["evaluations"], row), of_tasks(whole["tasks"]), F.when(whole[under].isNotNull(), of_task(whole)),
        F.when(whole["task_id"].isNotNull(), F.array(F.struct(*[whole[n].alias(n) for n in names]))), F.when(parents, of_tasks(listed)), objects(listed, row),
    )
    rows = payloads.select(F.explode(shapes).alias("r")).where("r IS NOT NULL").select("r.*")
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    out = rows.select(F.trim("task_id").alias("task_id"), "entity_record_id", F.coalesce(first("entity_name", "name"), F.lit("")).alias("entity_name"), F.coalesce(first("entity_type", "type"), F.lit("")).alias("entity_type"), F.trim(first("entity_url", "url")).alias("url"), "keep")
    out = out.where("task_id <> '' AND url <> ''")
    made = F.concat("task_id", F.lit("::"), F.substring(F.sha1("url"), 1, 12))
    out = out.withColumn("entity_record_id", F.coalesce(F.nullif("entity_record_id", F.lit("")), made))
    return out.where("keep IS NULL OR keep") if require_keep else out


def session_events(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON event logs as (path, line, type, message); blank and broken lines are skipped."""
    raw = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = raw.select("path", F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.message").alias("message"))
    return parsed.where("type IS NOT NULL")


def stream_output(lines: Column) -> Column:
    """Text of a tool's streamed output: a JSON object's ``content``, any other line as it is."""
    return F.array_join(F.transform(F.split(lines, "\n"), lambda x: F.coalesce(F.get_json_object(x, "$.content"), x)), "\n")


def skill_files(spark: SparkSession, root: str, name: str = "SKILL.md") -> DataFrame:
    """(skill_id, path, text): files of a name under ``root``, numbered from 1 by path."""
    from weft.operators.graph import with_dense_id

    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    return with_dense_id(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), "skill_id", "path")


def _separator(sample: list[str]) -> str:
    """The separator that most lines hold equally often, more often being better; a comma if none does."""
    best = (0, 0, ",")
    for mark in ("|", ";", "\t", ","):
        counts = [line.count(mark) for line in sample]
        common = max(set(counts), key=counts.count) if counts else 0
        if common:
            best = max(best, (counts.count(common), common, mark))
    return best[2]


def delimited(spark: SparkSession, path: str, separator: str | None = None, limit: int | None = 1000, many_lines: bool = False) -> DataFrame:
    """Rows of delimited files with one header line each, as texts, with ``_file`` and ``_row``, their order in it.

    The separator is a tab for .tsv, a comma for .csv, else, or if ``separator`` is "detect", found by counting in the
    first lines. Rows with too many fields are skipped, with too few filled up with NULLs; bytes that are no
    text are left out; ``limit`` rows of each file are returned, all if it is None.
    """
    if separator is None:
        separator = "\t" if path.endswith(".tsv") else "," if path.endswith(".csv") else "detect"
    if separator == "detect":
        separator = _separator([r.value for r in spark.read.text(path).where("trim(value) <> ''").limit(50).collect()])
    options = {"sep": separator, "header": True, "multiLine": many_lines, "nullValue": "\x00", "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, "_extra"])
    rows = spark.read.options(**options).schema(fields).csv(path)
    place = rows.select(*[F.replace(F.col(f"`{n.replace('`', '``')}`"), F.lit("\ufffd"), F.lit("")).alias(n) for n in names], "_extra", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    kept = place.where("_extra IS NULL").drop("_extra")
    if limit is not None:
        first = Window.partitionBy("_file").orderBy("_block", "_row")
        kept = kept.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")
    return kept.drop("_block")


# The fields of a kept exploration state and their types; maps are by skill.
STATE_FIELDS = {
    "skill_names": "array<string>", "session_id": "string", "started_at": "string", "total_steps": "bigint", "checkpoint_count": "bigint",
    "documented_functions": "map<string, array<string>>", "discovered_functions": "map<string, array<string>>", "tested_functions": "map<string, array<string>>",
    "workflows": "array<variant>", "last_new_discovery_step": "bigint", "consecutive_no_progress": "bigint", "exploration_complete": "boolean", "completion_reason": "string",
}
_EMPTY = {"array": "[]", "map": "{}", "string": '""', "bigint": "0", "boolean": "false"}


def states(texts: DataFrame, text: str) -> DataFrame:
    """The other columns with the fields of the exploration state in ``text``, a JSON object; rows without one are left out.

    Older shapes are brought to today's: ``skill_name`` becomes a list of names, and a list of functions
    a map of the first skill's, "unknown" if there is none. Unknown and computed fields are dropped, missing ones
    and those of another type have their defaults. ``coverage_ratio`` is computed anew: of documented functions
    those tested, 1 if none is documented.
    """
    rest = [c for c in texts.columns if c != text]
    state = texts.select(*rest, F.try_parse_json(text).alias("_v")).where(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")))

    def get(name: str, kind: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", kind)

    def default(kind: str) -> Column:
        empty = _EMPTY[kind.partition("<")[0]]
        return F.try_variant_get(F.parse_json(F.lit(empty)), "$", kind)

    old_name = get("skill_name", "string")
    names = F.coalesce(get("skill_names", "array<string>"), F.when(F.coalesce(old_name, F.lit("")) != "", F.array(old_name)))
    columns = {}
    for name, kind in STATE_FIELDS.items():
        value = names if name == "skill_names" else get(name, kind)
        if name.endswith("functions"):
            listed = get(name, "array<string>")
            value = F.coalesce(value, F.when(listed.isNotNull(), F.create_map(F.coalesce(F.get(names, 0), F.lit("unknown")), listed)))
        columns[name] = F.coalesce(value, default(kind))
    out = state.select(*rest, *[c.alias(n) for n, c in columns.items()])
    told = F.flatten(F.map_values("documented_functions"))
    done = F.aggregate(F.map_entries("documented_functions"), F.lit(0), lambda n, e: n + F.size(F.array_intersect(e["value"], F.coalesce(F.col("tested_functions")[e["key"]], F.array().cast("array<string>")))))
    return out.withColumn("coverage_ratio", F.when(F.size(told) == 0, 1.0).otherwise(done / F.size(told)))


def state_json() -> Column:
    """A row of :func:`states` as the JSON object that it is kept as."""
    return F.to_json(F.struct(*STATE_FIELDS, "coverage_ratio"))


def expand_paths(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Paths of some patterns, sorted inside each, every path once, where it first occurs; a name without wildcards is itself, there or not."""
    out: dict[str, str] = {}
    for pattern in patterns:
        found = [pattern]
        if any(c in pattern for c in "*?["):
            path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
            system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
            found = sorted(x.getPath().toUri().getPath() for x in system.globStatus(path) or [])
        for p in found:
            out.setdefault(p.replace("\\", "/").rstrip("/"), p)
    return list(out.values())


def scenario_names(payloads: DataFrame, text: str) -> DataFrame:
    """(scenario_id, canonical_scenario) of de-duplication payloads, the last of repeated ids; a payload of another shape is an error."""
    shape = "struct<scenarios: array<struct<scenario_id: bigint, canonical_scenario: string>>, skill_scenarios: array<string>>"
    held = F.from_json(text, shape)
    good = held["scenarios"].isNotNull() & held["skill_scenarios"].isNotNull()
    checked = F.when(good, held["scenarios"]).otherwise(F.raise_error(F.lit("a payload must hold the lists 'scenarios' and 'skill_scenarios'")))
    rows = payloads.select(F.posexplode(checked).alias("i", "s")).where("s.scenario_id IS NOT NULL")
    return rows.groupBy(F.col("s.scenario_id").alias("scenario_id")).agg(F.coalesce(F.max_by("s.canonical_scenario", "i"), F.lit("")).alias("canonical_scenario"))


def folder(spark: SparkSession, path: str, extensions: list[str] | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, sha256) of files below a folder, without those under an ignored name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in (*ignore, "")])) | F.lit(not ignore))
    if extensions:
        kept = kept.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(extensions))
    return kept.select("path", "length", F.sha2("content", 256).alias("sha256"))


def embedding_misses(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(key, text): each different text whose key the cache does not hold."""
    from weft.functions.scalars import text_cache_key

    keyed = texts.select(text_cache_key(model, F.col(text)).alias("key"), text).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def write_keep_reject(df: DataFrame, keep: Column, path: str) -> None:
    """All rows once, in two folders told apart by a ``part`` column."""
    df.withColumn("part", F.when(keep, "keep").otherwise("reject")).write.partitionBy("part").mode("overwrite").parquet(path)


def write_with_meta(df: DataFrame, path: str, **meta: str) -> None:
    """Rows as JSON lines, and a one-row table of what is said about them."""
    df.write.mode("overwrite").json(f"{path}/rows")
    row = df.sparkSession.range(1).select(*[F.lit(str(v)).alias(k) for k, v in meta.items()] or [F.lit("").alias("note")])
    row.write.mode("overwrite").json(f"{path}/meta")
