"""Addresses, answers and connections taken apart, Column to Column; NULL where a text has not the shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions import scalars

#: Fixed value: what a connection looks like, with its data in brackets.
CONNECTION = r"(.+?)\s*->\s*(.+?)(?:\s*\(|$)"


def _unquoted(part: Column) -> Column:
    """Percent-decoding; a plus stays one."""
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def parse_repository_url(url: Column, host: str) -> Column:
    """(owner, repo, mode, ref, path) of an address of a file or folder at a code host, else NULL."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)) == host
    path = F.trim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))
    parts = F.transform(F.split(path, "/"), _unquoted)
    mode = F.get(parts, 2)
    rest = F.array_join(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), "/")
    whole = found & (F.size(parts) >= 5) & mode.isin("blob", "tree") & (F.get(parts, 0) != "") & (F.get(parts, 1) != "") & (F.get(parts, 3) != "") & (rest != "")
    return F.when(whole, F.struct(F.get(parts, 0).alias("owner"), F.get(parts, 1).alias("repo"), mode.alias("mode"), F.get(parts, 3).alias("ref"), rest.alias("path")))


def quote(text: Column, safe_slash: bool = True) -> Column:
    """Percent-encoding; slashes stay unless told otherwise."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    out = F.replace(out, F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if safe_slash else out


def contents_url(api: str, owner: Column, repo: Column, path: Column, ref: Column) -> Column:
    return F.concat(F.lit(f"{api}/repos/"), owner, F.lit("/"), repo, F.lit("/contents/"), quote(path), F.lit("?ref="), quote(ref, False))


def raw_url(raw: str, owner: Column, repo: Column, path: Column, ref: Column) -> Column:
    return F.concat(F.lit(f"{raw}/"), owner, F.lit("/"), repo, F.lit("/"), quote(ref, False), F.lit("/"), quote(path))


def parse_connection(text: Column) -> Column:
    """(source, target) of "a -> b (data)", else NULL."""
    a, b = (F.trim(F.regexp_extract(text, CONNECTION, i)) for i in (1, 2))
    return F.when(text.rlike(CONNECTION), F.struct(a.alias("source"), b.alias("target")))


def _object(text: Column) -> Column:
    """The text if it is a JSON object."""
    whole = F.trim(text)
    return F.when(whole.startswith("{") & F.try_parse_json(whole).isNotNull(), whole)


def review_json(response: Column) -> Column:
    """The JSON object of an answer: fenced, else the whole, else from the first brace to the last, else ``{}``."""
    fenced = F.regexp_extract(response, r"(?s)```json\s*(.*?)\s*```", 1)
    text = F.when(response.rlike(r"(?s)```json\s*.*?\s*```"), fenced).otherwise(F.trim(response))
    start, back = F.instr(text, "{"), F.instr(F.reverse(text), "}")
    inner = F.when((start > 0) & (back > 0) & (F.length(text) - back + 1 >= start), F.substring(text, start, F.length(text) - back + 2 - start))
    return F.coalesce(_object(text), _object(inner), F.lit("{}"))


def label_of(response: Column, labels: list[str], default: str) -> Column:
    """The label that an answer is, else the first that it contains, else the default."""
    low = F.lower(F.trim(response))
    out = F.lit(default)
    for label in reversed(labels):
        out = F.when(F.contains(low, F.lit(label)), label).otherwise(out)
    return F.when(low.isin(labels), low).otherwise(out)


def test_name(path: Column) -> Column:
    """A file's name as a name of a test function."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    plain = F.regexp_replace(stem, "[^a-zA-Z0-9_]", "_")
    return F.when(plain == "", "output").when(plain.rlike("^[0-9]"), F.concat(F.lit("file_"), plain)).otherwise(plain)


def list_value(values: Column) -> Column:
    """The first five of a list and how many more there are; N/A for NULL."""
    head = F.array_join(F.slice(values, 1, 5), ", ")
    more = F.when(F.size(values) > 5, F.concat(F.lit("... (+"), (F.size(values) - 5).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(values.isNull(), "N/A").otherwise(F.concat(head, more))


def failure_summary(total: Column, passed: Column, failed: Column, errors: Column, code: Column, failures: Column, stdout: Column, stderr: Column) -> Column:
    """What a test run says to whoever fixes it; ``failures`` are (test_name, error_message)."""
    n = F.coalesce(F.size(failures), F.lit(0))
    none, out, err = n <= 0, F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit(""))
    empty = F.lit("No tests collected (test file may be empty or have no test functions)")
    told = F.concat(errors.cast("string"), F.lit(" test error(s) "))
    lines = F.concat(F.lit("Failed "), n.cast("string"), F.lit(" test(s):\n"), F.array_join(F.transform(failures, lambda f: F.concat(F.lit("  - "), f.test_name, F.lit(": "), f.error_message)), "\n"))
    return (
        F.when((total == 0) & (code == 0) & (out != ""), F.concat(empty, F.lit(". Output:\n"), F.substring(out, 1, 500)))
        .when((total == 0) & (code == 0), empty)
        .when((errors > 0) & none & (err != ""), F.concat(told, F.lit("(collection/import). Details:\n"), F.substring(err, 1, 500)))
        .when((errors > 0) & none & (out != ""), F.concat(told, F.lit("(collection/import). Output:\n"), F.substring(out, 1, 500)))
        .when((errors > 0) & none, F.concat(told, F.lit("occurred (collection/import errors, return_code="), code.cast("string"), F.lit(")")))
        .when((failed > 0) & none, F.concat(failed.cast("string"), F.lit(" test(s) failed (no detailed failure info available)")))
        .when(none & (passed > 0), "All tests passed.")
        .when(none, F.format_string("No test results (passed=%d, failed=%d, errors=%d)", passed, failed, errors))
        .otherwise(lines)
    )


#: What files of an extension are about.
DOMAINS = {
    "pdf": "document analysis", "doc": "document processing", "docx": "document processing", "xlsx": "data analysis", "xls": "data analysis",
    "csv": "data analysis", "json": "data processing", "xml": "data processing", "py": "software engineering", "js": "software engineering",
    "ts": "software engineering", "java": "software engineering", "sql": "database", "md": "technical writing", "stl": "3D modeling",
}
#: Packages that are installed from another channel.
CONDA_PREFERRED = ["rdkit", "pysam", "pymatgen", "biopython", "anndata", "scanpy", "cobra", "scikit-bio"]
#: Tags by extension, and how instructions give their implementation away.
EXTENSION_TAGS = {"data-processing": ["json", "csv", "xlsx"], "text-processing": ["md", "txt"], "document-analysis": ["pdf"], "code-generation": ["py", "js", "ts"]}
GIVEAWAYS = ["step 1:", "step 2:", "first,", "then,", "finally,", "```python", "```bash", "def ", "import "]


def _suffix(path: Column) -> Column:
    """What follows the last dot of a path, in lower case; empty without one."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.regexp_extract(path, r"([^.]*)$", 1))).otherwise("")


def domain_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _suffix(path)), F.lit("general"))


def conda_packages(requirements: Column) -> Column:
    """Of a list of requirements, the names that another channel has, in order."""
    names = F.transform(requirements, lambda r: F.regexp_extract(F.lower(r), r"^(.*?)(?:\[.*|>=.*|==.*)?$", 1))
    return F.filter(names, lambda n: n.isin(CONDA_PREFERRED))


def script_paths(script: Column) -> Column:
    """Different paths in a script, sorted: quoted ones, those below /root and /tmp; no addresses."""
    found = [F.regexp_extract_all(script, F.lit(p), 1) for p in ("[\"'](/[^\"'<>\\s]+)[\"']", "\\s(/root/[^\\s\"'<>]+)", "(/tmp/[^\\s\"'<>]+)")]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*found), lambda p: ~p.endswith(":") & ~F.contains(p, F.lit("://")))))


def tags_of(skills: Column, outputs: Column, uses_shell: Column) -> Column:
    """Up to five tags, sorted: skills, kinds of written files, and the shell."""
    def kind(path: Column) -> Column:
        out = F.lit(None).cast("string")
        for tag, endings in EXTENSION_TAGS.items():
            out = F.when(_suffix(path).isin(endings), tag).otherwise(out)
        return out

    shell = F.when(uses_shell, F.array(F.lit("shell"))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(F.concat(skills, F.transform(outputs, kind), shell)))), 1, 5)


def instruction_issues(instruction: Column, outputs: Column, inputs: Column) -> Column:
    """What speaks against an instruction: files it does not mention, and implementation details."""
    low = F.lower(instruction)

    def missing(paths: Column, side: str) -> Column:
        names = F.transform(paths, lambda p: F.regexp_extract(p, r"([^/]*)$", 1))
        left = F.filter(names, lambda n: ~F.contains(low, F.lower(n)))
        return F.transform(left, lambda n: F.concat(F.lit(f"{side} file '"), n, F.lit("' not mentioned in instruction")))

    told = F.filter(F.array(*[F.lit(k) for k in GIVEAWAYS]), lambda k: F.contains(low, k))
    details = F.transform(told, lambda k: F.concat(F.lit("Possible implementation detail: '"), k, F.lit("'")))
    return F.concat(missing(outputs, "Output"), missing(inputs, "Input"), details)


# Words that are headings, and method names that say nothing.
HEADINGS = (
    "overview introduction quick start getting started installation setup usage example examples reference python command line tools common next steps "
    "advanced basic summary conclusion requirements dependencies configuration config settings notes troubleshooting faq api methods functions classes"
).split()
PLAIN_METHODS = "pdf pages page open write read close append extend".split()


def documented_functions(document: Column) -> Column:
    """Operations that a skill's document names, each once ignoring case, as first spelt: headings of the fourth level, then
    defined functions, calls of classes, of methods, and inline calls; without heading words. NULL has none."""
    text = F.coalesce(document, F.lit(""))
    headings = F.transform(F.regexp_extract_all(text, F.lit(r"(?dmU)^####\s+(.+)$"), 1), lambda h: F.regexp_replace(h, r"(?U)^\s+|\s+$", ""))
    defined, classes, methods, inline = (
        F.regexp_extract_all(text, F.lit(p), 1)
        for p in (r"(?U)def\s+(\w+)\s*\(", r"(?U)\b([A-Z][a-zA-Z0-9]+)\s*\(", r"(?U)\.([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", r"(?U)`(\w+)\(\)`")
    )
    told = F.filter(methods, lambda m: ~F.lower(m).isin(PLAIN_METHODS) & (F.length(m) > 2))
    names = F.filter(F.concat(headings, defined, classes, told, inline), lambda n: (n != "") & ~F.lower(n).isin(HEADINGS))
    return scalars.first_spellings(names)
