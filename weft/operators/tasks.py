"""Task records: skills, connections, evidence, entities and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.parsers import parse_connection


def join_manifest(folders: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """Folders with their manifest row's name and stars; the folder's own name and no stars without one."""
    m = manifest.groupBy(path).agg(F.max(F.struct("ord", "skill_name", "stars")).alias("_m"))  # the last row of a path counts
    own = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return folders.join(m, path, "left").select(
        *folders.columns, F.coalesce(F.nullif(F.col("_m.skill_name"), F.lit("")), own).alias("skill_name"), F.coalesce("_m.stars", F.lit(0)).alias("stars")
    )


def retained(rows: DataFrame, listing: DataFrame, path: str, ordinal: str, given: str) -> DataFrame:
    """(id, rows): rows whose file exists, the first of each path, ids by position where none is given, in order of id."""
    there = rows.join(listing.select(path).distinct(), path, "left_semi")
    first = there.groupBy(path).agg(F.min_by(F.struct(*[c for c in rows.columns if c != path]), ordinal).alias("_r"))
    out = first.select(path, "_r.*")
    return out.withColumn("skill_id", F.coalesce(F.nullif(F.col(given), F.lit(0)), F.col(ordinal) + 1))


def quality_keep(rows: DataFrame, listing: DataFrame, key: str, candidates: list[str], path: str = "path") -> DataFrame:
    """Rows not refused, each with the first of its candidate paths that exists; one row a path, the first by ``key``."""
    kept = rows.where(F.col("keep").isNull() | F.col("keep"))
    probes = kept.select(key, F.posexplode(F.array(*candidates)).alias("_p", path)).where(F.coalesce(path, F.lit("")) != "")
    found = probes.join(listing.select(path).distinct(), path, "left_semi")
    first = found.groupBy(key).agg(F.min_by(path, "_p").alias(path))
    return first.groupBy(path).agg(F.min(key).alias(key))


def entities_in_tasks(entities: DataFrame, tasks: DataFrame, task: str) -> DataFrame:
    return entities.join(tasks.select(task), task, "left_semi")


def node_list(tasks: DataFrame, nodes: DataFrame, task: str, ids: str) -> DataFrame:
    """(task, names): the names of a task's ids in order, empty where a node is unknown."""
    each = tasks.select(task, F.posexplode(ids).alias("_p", "id")).join(nodes.select("id", "name"), "id", "left")
    pairs = F.array_sort(F.collect_list(F.struct("_p", F.coalesce("name", F.lit("")).alias("name"))))
    return each.groupBy(task).agg(F.transform(pairs, lambda x: x["name"]).alias("names"))


def item_keys(ids: Column) -> Column:
    """The different whole-number ids of a task's texts; others are passed over."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: x.try_cast("long")), lambda x: x.isNotNull()))


def record_key(record: Column, task: Column, url: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(record, F.lit("")), F.concat_ws("::", task, url, name))


def limited_evidence(edges: DataFrame, task: str, ordinal: str, evidence: str, per_edge: int = 3, most: int = 12) -> DataFrame:
    """(task, n, item): the first evidence of a task's edges, ``per_edge`` of each, in order of edges, ``most`` in all."""
    each = edges.select(task, ordinal, F.posexplode(F.slice(evidence, 1, per_edge)).alias("_p", "item"))
    n = F.row_number().over(Window.partitionBy(task).orderBy(ordinal, "_p", "item"))
    return each.withColumn("n", n).where(F.col("n") <= most).select(task, "n", "item")


def _ends(tasks: DataFrame, task: str) -> DataFrame:
    """(task, target): names that connections (task, connection) lead to."""
    return tasks.select(task, parse_connection(F.col("connection")).alias("c")).where(F.col("c").isNotNull()).select(task, F.col("c.target").alias("name")).distinct()


def upstream_roots(skills: DataFrame, connections: DataFrame, task: str) -> DataFrame:
    """(task, id, name): skills that no connection of their task leads to; all of them where none is left."""
    led = _ends(connections, task).withColumn("_led", F.lit(True))
    marked = skills.select(task, "id", "name").join(led, [task, "name"], "left").withColumn("_root", F.col("_led").isNull())
    any_root = F.max("_root").over(Window.partitionBy(task))
    return marked.withColumn("_any", any_root).where(F.col("_root") | ~F.col("_any")).select(task, "id", "name")


def infer_entity_skill(entities: DataFrame, skills: DataFrame, connections: DataFrame, task: str, key: str) -> DataFrame:
    """(task, key, skill): an entity's skill by id, else by name, else its task's only root, else NULL."""
    s = skills.select(task, "id", "name")
    by_id = s.groupBy(task, F.col("id").alias("for_id")).agg(F.min("id").alias("_a"))
    by_name = s.groupBy(task, F.col("name").alias("for_name")).agg(F.min("id").alias("_b"))
    roots = upstream_roots(skills, connections, task).groupBy(task).agg(F.min("id").alias("_c"), F.count(F.lit(1)).alias("_n"))
    joined = entities.join(by_id, [task, "for_id"], "left").join(by_name, [task, "for_name"], "left").join(roots, task, "left")
    return joined.select(task, key, F.coalesce("_a", "_b", F.when(F.col("_n") == 1, F.col("_c"))).alias("skill"))


def entity_fit(fit: Column, own: Column, told: Column, least: float = 3.0) -> Column:
    """(fit_score, keep, decision, value): the score within 1 to 5, kept from ``least``; an entity's own field before the model's."""
    score = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(fit.try_cast("double"), F.lit(1.0))))
    return F.struct(
        score.alias("fit_score"), (score >= least).alias("keep"), F.when(score >= least, "keep").otherwise("reject").alias("decision"),
        F.coalesce(F.nullif(own, F.lit("")), F.nullif(told, F.lit("")), F.lit("")).alias("value"),
    )


def suggested_task(suggestion: Column) -> Column:
    """(title, input, workflow, expected_output, verification) of a suggestion in JSON: texts trimmed, a step told as one text a
    list of it, empty steps left out; all empty for what is no object."""
    parsed = F.from_json(F.when(F.startswith(F.ltrim(suggestion), F.lit("{")), suggestion), "struct<title: string, input: string, workflow: string, expected_output: string, verification: string>")

    def text(name: str) -> Column:
        return F.coalesce(F.trim(parsed[name]), F.lit("")).alias(name)

    def steps(name: str) -> Column:
        raw = parsed[name]
        listed = F.coalesce(F.from_json(F.when(F.startswith(raw, F.lit("[")), raw), "array<string>"), F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))
        return F.filter(F.transform(listed, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "").alias(name)

    return F.struct(text("title"), text("input"), steps("workflow"), text("expected_output"), steps("verification"))


def first_edge(edges: DataFrame, keys: list[str], ordinal: str, value: str) -> DataFrame:
    """The first edge between two ends."""
    return edges.groupBy(*keys).agg(F.min_by(value, ordinal).alias(value))


def best_starts(edges: DataFrame, first: int = 4) -> DataFrame:
    """(node, best, total, place): nodes by their best out-edge, with the sum of the first edges."""
    w = Window.partitionBy("source").orderBy(F.desc("edge_score"), "target")
    few = edges.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    out = few.groupBy(F.col("source").alias("node")).agg(F.max("edge_score").alias("best"), F.round(F.sum("edge_score"), 6).alias("total"))
    return out


def capped(rows: DataFrame, category: str, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each category."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def copy_plan(tasks: DataFrame, records: DataFrame, task: str, ordinal: str) -> DataFrame:
    """(task, ordinal, name, status): missing skills, repeated names, and those to be copied."""
    found = tasks.join(records.select("id", "name"), "id", "left")
    n = F.row_number().over(Window.partitionBy(task, "name").orderBy(ordinal))
    status = F.when(F.col("name").isNull(), "missing").when(n > 1, "duplicate_skill_name_skipped").otherwise("copied")
    return found.select(task, ordinal, F.coalesce("name", F.lit("")).alias("name"), status.alias("status"))


def candidate_paths(given: Column, folder: Column, name: Column, root: str) -> Column:
    """Where a skill's text may lie, in the order in which it is looked for; missing parts give no candidate."""
    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    parts = [filled(given), F.concat(F.lit(f"{root}/"), filled(given)), F.concat(filled(folder), F.lit("/SKILL.md")), F.concat(F.lit(f"{root}/"), filled(name), F.lit("/SKILL.md"))]
    return F.array_distinct(F.array_compact(F.array(*parts)))


def skill_text(name: Column, description: Column, queries: Column, body: Column) -> Column:
    """The text that is embedded for a skill: labelled name, description and queries, then its body."""
    return F.concat(
        F.lit("Skill name: "), F.coalesce(name, F.lit("")), F.lit("\nDescription: "), F.coalesce(description, F.lit("")),
        F.lit("\nQueries: "), F.coalesce(F.array_join(queries, ", "), F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")),
    )


def sorted_clusters(members: DataFrame, cluster: str, member: str) -> DataFrame:
    """(cluster, size, first): clusters by size, then first member, largest first."""
    out = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.min(member).alias("first"))
    return out.orderBy(F.desc("size"), F.desc("first"))


def joined_texts(rows: DataFrame, key: str, ordinal: str, text: str, separator: str) -> DataFrame:
    """(key, text): the texts of a key in order, joined."""
    listed = F.array_sort(F.collect_list(F.struct(ordinal, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[text]), separator).alias("text"))


def nested_document(steps: DataFrame, key: str, ordinal: str, columns: list[str]) -> DataFrame:
    """(key, document): a session and its steps in order as one JSON text."""
    listed = F.array_sort(F.collect_list(F.struct(ordinal, *columns)))
    return steps.groupBy(key).agg(listed.alias("steps")).select(key, F.to_json(F.struct(key, F.size("steps").alias("n"), "steps")).alias("document"))


def dag_state(edges: DataFrame, paths: DataFrame, task: str) -> DataFrame:
    """(task, edges, paths): what of a task graph is still to be covered: all labels of its edges and paths, sorted."""
    label = F.concat_ws("->", "source", "target")
    e = edges.select(task, label.alias("l")).groupBy(task).agg(F.array_sort(F.collect_set("l")).alias("edges"))
    p = paths.select(task, F.array_join("path", "->").alias("l")).groupBy(task).agg(F.array_sort(F.collect_set("l")).alias("paths"))
    return p.join(e, task, "left").select(task, F.coalesce("edges", F.array().cast("array<string>")).alias("edges"), "paths")


def go_on(complete: Column, path_coverage: Column) -> Column:
    """Whether an exploration goes on: not complete, and paths left where there are any."""
    return ~complete & (path_coverage.isNull() | (path_coverage < 1.0))


def notebook_profile(document: Column) -> Column:
    """(cells, code, markdown, has_outputs) of a notebook's JSON; NULL if it is none."""
    shape = "struct<cells: array<struct<cell_type: string, outputs: array<string>>>>"
    cells = F.from_json(document, shape)["cells"]

    def of(kind: str) -> Column:
        return F.size(F.filter(cells, lambda c: c.cell_type == kind))

    outputs = F.exists(cells, lambda c: F.coalesce(F.size(c.outputs), F.lit(0)) > 0)
    return F.when(cells.isNotNull(), F.struct(F.size(cells).alias("cells"), of("code").alias("code"), of("markdown").alias("markdown"), outputs.alias("has_outputs")))
