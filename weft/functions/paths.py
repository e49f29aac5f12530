"""Rewriting of workspace paths to container paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.parsers import script_paths

ROOT = "/root"

# The workspace layouts to rewrite, in the order in which rules apply.
FLAT_RULES = [
    "/root/harbor_workspaces/[^/]+/input/",
    "/root/harbor_workspaces/[^/]+/final_res/",
    "/root/harbor_workspaces/[^/]+/output/",
    "/root/harbor_workspaces/[^/]+/",
    "/tmp/harbor_exploration/[^/]+/input/",
    "/tmp/harbor_exploration/[^/]+/output/",
    "/tmp/harbor_exploration/[^/]+/",
    "/tmp/solve_verify_[^/]+/",
    r"/ossfs/workspace/[^\s\"'`\]\)\n]+/input/",
    r"/ossfs/workspace/[^\s\"'`\]\)\n]+/output/",
]
FLAT_FOLDERS = ["/root/input/", "/root/output/", "/root/final_res/"]
FILE_RULES = [
    r"/tmp/harbor_exploration/[^\s\"'`\]\)\n]+/input/([^\s\"'`\]\)\n]+)",
    r"/tmp/harbor_exploration/[^\s\"'`\]\)\n]+/output/([^\s\"'`\]\)\n]+)",
    r"/root/harbor_workspaces/[^\s\"'`\]\)\n]+/input/([^\s\"'`\]\)\n]+)",
    r"/root/harbor_workspaces/[^\s\"'`\]\)\n]+/output/([^\s\"'`\]\)\n]+)",
    r"/dtai/[^\s\"'`\]\)\n]+/([^\s\"'`\]\)/\n]+\.[a-zA-Z0-9]+)",
    r"/ossfs/workspace/[^\s\"'`\]\)\n]+/input/([^\s\"'`\]\)\n]+)",
    r"/ossfs/workspace/[^\s\"'`\]\)\n]+/output/([^\s\"'`\]\)\n]+)",
    r"(?<![a-zA-Z0-9])/[^\s\"'`\[\(\n]+/input/([^\s\"'`\]\)\n]+\.[a-zA-Z0-9]+)",
]
SCRIPT_RULES = [
    r"/root/harbor_workspaces/[^/\s\"']+/",
    r"/root/\.harbor/workspaces/[^/\s\"']+/",
    r"/root/harbor_workspaces/[^/\s\"']+",
    r"/tmp/harbor_[^/\s\"']+/",
]
SCRIPT_FOLDERS = ["input/", "output/", "final_res/", "workspace/"]
HEREDOC = r"(?ms)python3?\s*<<\s*['\"]?(\w+)['\"]?\s*(.*?)^\1"


def base_name(path: Column) -> Column:
    """The last part of a path; a trailing slash does not count."""
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def flatten_workspace(text: Column, workspace: Column | None = None) -> Column:
    """Workspace folders become the container's root; its input and output folders are flattened. NULL stays NULL."""
    out = text
    if workspace is not None:
        own = F.rtrim(workspace, F.lit("/"))
        moved = F.replace(F.replace(out, F.concat(own, F.lit("/")), F.lit(f"{ROOT}/")), own, F.lit(ROOT))
        out = F.when(F.coalesce(workspace, F.lit("")) != "", moved).otherwise(out)
    for rule in FLAT_RULES:
        out = F.regexp_replace(out, rule, f"{ROOT}/")
    for folder in FLAT_FOLDERS:
        out = F.replace(out, F.lit(folder), F.lit(f"{ROOT}/"))
    return F.regexp_replace(out, f"{ROOT}/+", f"{ROOT}/")


def rewrite_known_paths(text: Column, known: Column) -> Column:
    """Known paths, longest first, become files of the container's root, then the rules for unknown workspaces apply.

    ``known`` is an array of a text's paths. Paths of one length apply in their order; NULL and empty
    ones do not count; a replaced path may be matched again by a shorter one, as the order of rules says.
    """
    paths = F.array_distinct(F.filter(F.coalesce(known, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != ""))
    keyed = F.transform(paths, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))
    longest = F.transform(F.array_sort(keyed), lambda s: s["p"])
    root = F.lit(f"{ROOT}/")
    out = F.aggregate(longest, text, lambda t, p: F.replace(t, p, F.concat(root, base_name(p))))
    for rule in FILE_RULES:
        out = F.regexp_replace(out, rule, f"{ROOT}/$1")
    names = F.array_distinct(F.transform(paths, base_name))
    return F.aggregate(names, out, lambda t, n: F.replace(t, F.concat(F.lit(f"{ROOT}/output/"), n), F.concat(root, n)))


def _single_slashes(text: Column) -> Column:
    return F.regexp_replace(text, "(?<!:)//+", "/")


def _script_rules(text: Column) -> Column:
    for rule in SCRIPT_RULES:
        text = F.regexp_replace(text, rule, f"{ROOT}/")
    return _single_slashes(text)


def normalize_script(script: Column) -> Column:
    """Workspace paths of a shell script, also in its Python heredocs, whose first line is written anew."""
    out = _script_rules(script)
    for folder in SCRIPT_FOLDERS:
        out = F.regexp_replace(out, f"{ROOT}/{folder}([^/\\s\"']+)", f"{ROOT}/$1")
    between = F.split(out, HEREDOC, -1)
    ends, codes = (F.regexp_extract_all(out, F.lit(HEREDOC), g) for g in (1, 2))
    blocks = F.zip_with(ends, codes, lambda e, c: F.concat(F.lit("python3 << '"), e, F.lit("'"), _script_rules(c), e))
    whole = F.zip_with(between, blocks, lambda t, b: F.concat(t, F.coalesce(b, F.lit(""))))
    return F.array_join(whole, "")


def _quoted(text: str | Column) -> Column:
    """A regular expression that matches a text as it is."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_/])", r"\\$1")


def normalize_for_container(script: Column, inputs: Column) -> Column:
    """As :func:`normalize_script`, then each input file, quoted or not, becomes a quoted file of the container's root."""
    def one(text: Column, path: Column) -> Column:
        name = _quoted(base_name(path))
        target = F.concat(F.lit(f'"{ROOT}/'), F.regexp_replace(base_name(path), r"([\\$])", r"\\$1"), F.lit('"'))
        for rule in (F.concat(F.lit("[\"']?"), _quoted(path), F.lit("[\"']?")), F.concat(F.lit("/root/input/"), name), F.concat(F.lit("/root/workspace/"), name)):
            text = F.regexp_replace(text, rule, target)
        return text

    paths = F.filter(F.coalesce(inputs, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != "")
    out = F.aggregate(paths, normalize_script(script), one)
    return _single_slashes(F.regexp_replace(out, "/root/output/([^/\\s\"']+)", "/root/$1"))


def invalid_paths(script: Column, inputs: Column) -> Column:
    """Messages, in order of the paths: workspace paths that are left, and input files named as if they were folders."""
    names = F.transform(F.coalesce(inputs, F.array().cast("array<string>")), base_name)

    def told(p: Column) -> Column:
        # The messages.
        left = F.when(p.rlike("^(?:" + "|".join(SCRIPT_RULES) + ")"), F.concat(F.lit("Workspace path not normalized: "), p))
        other = F.array_contains(names, base_name(p)) & ~p.endswith(F.concat(F.lit("/"), base_name(p)))
        wrong = F.when(other, F.concat(F.lit("Input file path mismatch: "), p, F.lit(f" (expected {ROOT}/"), base_name(p), F.lit(")")))
        return F.array_compact(F.array(left, wrong))

    return F.flatten(F.transform(script_paths(script), told))
