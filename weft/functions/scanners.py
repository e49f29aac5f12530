"""Scanners of scripts and model answers: one pass over characters or lines with a bracket depth, in Arrow batches."""

from __future__ import annotations

import ast
import bisect
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What imports of test modules and constants look like.
TEST_IMPORTS = [r"^from\s+expectation_tests\s+import\s+", r"^from\s+test_\w+\s+import\s+", r"^import\s+expectation_tests", r"^import\s+test_\w+"]
CONSTANT = r"^([A-Z][A-Z0-9_]*)\s*="
_TEST_IMPORT = re.compile("|".join(TEST_IMPORTS))
_CONSTANT = re.compile(CONSTANT)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL)
_BRACE = re.compile(r"[{}]")
_IMPORT = re.compile(r"^(?:from|import)\s+(\w+)", re.MULTILINE)


def first_braces(text: str, deepest: int = 3) -> str | None:
    """The first balanced {...} whose braces nest at most ``deepest`` levels; every brace counts, in strings too."""
    heights, open_at, found = [], [], None
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            open_at.append(m.start())
            heights.append(1)
        elif open_at:
            start, height = open_at.pop(), heights.pop()
            if heights:
                heights[-1] = max(heights[-1], height + 1)
            if height <= deepest and (found is None or start < found[0]):
                found = (start, m.end())
        if found and not (open_at and open_at[0] < found[0]):
            break  # nothing that is still open can begin before it
    return text[found[0] : found[1]] if found else None


def _mapped(one):
    """A text function over Arrow batches; NULL stays NULL."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")


def _json(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except (json.JSONDecodeError, RecursionError):
        return None


def _filter_json(answer: str) -> str | None:
    fenced = _FENCE.search(answer)
    for text in (lambda: answer, lambda: fenced and fenced[1], lambda: first_braces(answer)):
        value = _json(text())
        if value is not None:
            return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return None


def parse_filter_json(answer: Column) -> Column:
    """The JSON of an answer, with sorted keys: all of it, else of its first fence, else its first braces of three levels at most; NULL if none is JSON."""
    return _mapped(_filter_json)(answer)


def _sanitized(script: str) -> str:
    kept, depth = [], 0
    for line in script.split("\n"):
        bare = line.strip()
        balance = bare.count("(") - bare.count(")")
        if depth > 0:
            depth += balance
        elif _TEST_IMPORT.match(bare):
            depth = balance
        else:
            kept.append(line)
    return "\n".join(kept)


def sanitize_script(script: Column) -> Column:
    """Scripts without lines that import test modules, to the end of their parentheses. NULL stays NULL."""
    return _mapped(_sanitized)(script)


def _constants(source: str) -> str:
    out, held, depth = [], None, 0
    for line in source.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith(("#", "class ", "def ")):
            continue
        balance = sum(line.count(c) for c in "[{(") - sum(line.count(c) for c in "]})")
        if held is not None:
            held.append(line)
            depth += balance
            if depth <= 0:
                out += [*held, ""]
                held = None
        elif _CONSTANT.match(line):
            if balance > 0:
                held, depth = [line], balance
            else:
                out.append(line)
    return "\n".join(out)  # what never closes is left out


def extract_constants(source: Column) -> Column:
    """Upper-case constants at module level, to the end of their brackets and then an empty line; comments inside are left out."""
    return _mapped(_constants)(source)


#: Languages by file ending.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".sh": "bash",
}
PROFILE = "line_count int, programming_language string, function_count int, function_names array<string>, class_count int, class_names array<string>, imports array<string>"


_STATEMENT = re.compile(r"(?:^|(?<=\n))(?:def|class|import|from)\b|(?:^|(?<=\n))@")


def _trees(source: str, size: int = 1 << 16):
    """The syntax trees of parts of a source that parse, so that a long source's tree is never held whole.

    Parts end before statements that no other can continue into. A part that does not parse, as it ends inside a text or
    bracket, takes in what follows, twice as much each time; if the rest does not parse, the source does not.
    """
    starts = [m.start() for m in _STATEMENT.finditer(source)]
    at, grow = 0, size
    while at < len(source):
        i = bisect.bisect_left(starts, at + grow)
        end = starts[i] if i < len(starts) else len(source)
        try:
            tree = ast.parse(source[at:end])
        except SyntaxError:
            if end == len(source):
                raise
            grow = 2 * (end - at)
            continue
        yield tree
        at, grow = end, size


def _profile(path: str | None, source: str | None) -> dict:
    dot = re.search(r"[^/.][^/]*?(\.[^/.]+)$", path or "")
    ending = dot[1].lower() if dot else ""
    out = {"line_count": None if source is None else source.count("\n") + 1, "programming_language": LANGUAGES.get(ending, "unknown")}
    if ending != ".py" or source is None:
        return out
    functions, classes, modules = [], [], set()  # names by depth
    try:
        for tree in _trees(source):
            level, depth = [tree], 0
            while level:
                if depth == len(functions):
                    functions.append([])
                    classes.append([])
                functions[depth] += [n.name for n in level if isinstance(n, ast.FunctionDef)]
                classes[depth] += [n.name for n in level if isinstance(n, ast.ClassDef)]
                modules |= {a.name.split(".")[0] for n in level if isinstance(n, ast.Import) for a in n.names}
                modules |= {n.module.split(".")[0] for n in level if isinstance(n, ast.ImportFrom) and n.module}
                level, depth = [c for n in level for c in ast.iter_child_nodes(n)], depth + 1
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out | {"imports": sorted(set(_IMPORT.findall(source)))[:15]}
    functions, classes = sum(functions, []), sum(classes, [])
    return out | {
        "function_count": len(functions), "function_names": functions[:10], "class_count": len(classes), "class_names": classes[:5], "imports": sorted(modules)[:15],
    }


def code_profile(path: Column, source: Column) -> Column:
    """Lines, language by ending and, of Python, functions, classes (outer ones first) and imported packages, sorted.

    Python that does not parse has the imports of its lines alone; async functions are not counted; a NULL
    source has no lines.
    """
    names = [x.split()[0] for x in PROFILE.split(", ")]

    def run(paths: pd.Series, sources: pd.Series) -> pd.DataFrame:
        found = [_profile(p, s) for p, s in zip(paths, sources, strict=True)]
        return pd.DataFrame({n: pd.Series([x.get(n) for x in found], dtype="Int32" if n.endswith("count") else object) for n in names})

    return F.pandas_udf(run, PROFILE)(path, source)


PRM = "is_valid boolean, issues array<string>, feedback string"
_PRM_PARTS = [re.compile(r"```json\s*(.*?)\s*```", re.DOTALL), re.compile(r"```\s*(.*?)\s*```", re.DOTALL), re.compile(r'(\{[^{}]*"is_valid"[^{}]*\})', re.DOTALL)]
# What is searched for in answers without JSON, and what is said of those without either.
_YES, _NO = ('is_valid": true', "is_valid: true"), ('is_valid": false', "is_valid: false")
_UNREAD = "Could not parse PRM result, assuming valid."


def _prm(answer: str) -> tuple:
    for part in _PRM_PARTS:
        found = part.search(answer)
        data = _json(found and found[1])
        if isinstance(data, dict):
            issues = data.get("issues") or []
            return bool(data.get("is_valid", False)), [str(x) for x in (issues if isinstance(issues, list) else [issues])], str(data.get("feedback") or "")
    low = answer.lower()
    if any(x in low for x in _YES):
        return True, [], ""
    if any(x in low for x in _NO):
        issues = []
        for line in answer.split("\n"):
            bare = line.strip()
            if bare.startswith(("- ", "* ")):
                issues.append(bare[2:])
            elif "issue" in line.lower() or "error" in line.lower():
                issues.append(bare)
        return False, issues[:10], answer[:2000]
    return True, [], _UNREAD


def parse_prm_result(answer: Column) -> Column:
    """(is_valid, issues, feedback) of a review: of its first JSON object, fenced or bare, else of signals in the text, else valid.

    Issues that are no list are one issue; NULL is read as an empty answer.
    """

    def run(answers: pd.Series) -> pd.DataFrame:
        rows = [_prm(a or "") for a in answers]
        return pd.DataFrame({"is_valid": [r[0] for r in rows], "issues": pd.Series([r[1] for r in rows], dtype=object), "feedback": [r[2] for r in rows]})

    return F.pandas_udf(run, PRM)(answer)
