"""Scalar functions, Column to Column; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which tools belong to which category, file and path lists, gates.
TOOL_CATEGORIES = {
    "file_read": ["Read", "Glob", "Grep"],
    "file_write": ["Write", "Edit", "NotebookEdit"],
    "command": ["Bash"],
    "skill": ["Skill"],
    "web": ["WebFetch", "WebSearch"],
    "task": ["Task", "TaskOutput", "TaskStop", "TodoWrite"],
    "plan": ["EnterPlanMode", "ExitPlanMode"],
    "worktree": ["EnterWorktree", "ExitWorktree"],
    "cron": ["CronCreate", "CronDelete", "CronList"],
    "interaction": ["AskUserQuestion"],
}
ENTITY_EXTENSIONS = [
    ("csv", ".csv"), ("xlsx", ".xlsx"), ("excel", ".xlsx"), ("json", ".json"), ("pdf", ".pdf"), ("zip", ".zip"), ("vcf", ".vcf"),
    ("bam", ".bam"), ("fasta", ".fasta"), ("fastq", ".fastq"), ("image", ".png"), ("audio", ".wav"), ("video", ".mp4"),
]
DATE_PATTERN = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{2}-\w{3}-\d{2,4})"
FORM_WORDS = ["form", "fillable", "field", "input", "checkbox", "dropdown", "signature", "w-4", "w-9", "application", "submit", "填写"]
TABLE_WORDS = ["table", "row", "column", "spreadsheet", "xlsx", "csv", "data", "cell", "header", "表格", "数据"]
CODE_WORDS = ["function", "class", "import", "def ", "const ", "var ", "code", "script", "programming", "syntax"]
CODE_EXTENSIONS = [".py", ".js", ".ts", ".java", ".cpp", ".go", ".rs"]
ALIGNMENT_TYPE_DEFAULTS = ("incompatible", "data_state_handoff")
SYSTEM_PACKAGES = [
    (r"poppler|pdftotext|pdftoppm|pdfimages", ["poppler-utils"]),
    (r"tesseract|pytesseract", ["tesseract-ocr", "tesseract-ocr-chi-sim"]),
    (r"ffmpeg", ["ffmpeg"]),
    (r"ghostscript|gs\s", ["ghostscript"]),
    (r"imagemagick|convert\s|magick", ["imagemagick"]),
    (r"pandoc", ["pandoc"]),
    (r"graphviz|dot\s", ["graphviz"]),
    (r"libgl|opencv|cv2", ["libgl1-mesa-glx", "libglib2.0-0"]),
    (r"wkhtmlto", ["wkhtmltopdf"]),
    (r"chromium|chrome|puppeteer", ["chromium-browser"]),
    (r"libreoffice|soffice", ["libreoffice"]),
]
QUALITY_WEIGHTS, QUALITY_LIMITS = (0.30, 0.45, 0.25), (2, 3, 3.5, 3)


def star_count(*names: str) -> Column:
    """The first name that is not NULL as a whole number; 0 if that one is none."""
    return F.coalesce(F.coalesce(*[F.col(n).cast("string") for n in names]).try_cast("bigint"), F.lit(0).cast("long"))


def safe_name(v: Column, default: str = "skill", longest: int = 80) -> Column:
    joined = F.regexp_replace(F.trim(v), "[^A-Za-z0-9._-]+", "-")
    return F.substring(F.coalesce(F.nullif(F.btrim(joined, F.lit("-._")), F.lit("")), F.lit(default)), 1, longest)


def sanitize_name(v: Column, fallback: str = "file", longest: int = 120) -> Column:
    one = F.regexp_replace(F.regexp_replace(v, r'[\\/:*?"<>|]+', "_"), r"\s+", "_")
    return F.substring(F.coalesce(F.nullif(F.btrim(one, F.lit("._ ")), F.lit("")), F.lit(fallback)), 1, longest)


def normalize_path(v: Column) -> Column:
    return F.rtrim(F.replace(v, F.lit("\\"), F.lit("/")), F.lit("/"))


def normalize_scenario(v: Column) -> Column:
    return F.btrim(F.regexp_replace(v, r"\s+", " "), F.lit(" .;:-"))


def first_spellings(values: Column) -> Column:
    """Different texts of an array ignoring case, as first spelt, in order; by sorting, so that long arrays cost no more than that."""
    told = F.transform(values, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x")))

    def firsts(listed: Column) -> Column:  # bound to a name, so that it is sorted once and not for each element
        kept = F.filter(listed, lambda s, i: (i == 0) | (F.get(listed, i - 1)["low"] != s["low"]))
        return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["i"], s["x"]))), lambda s: s["x"])

    return F.element_at(F.transform(F.array(F.array_sort(told)), firsts), 1)


def normalize_scenarios(values: Column) -> Column:
    """Cleaned, without empty ones, the first spelling of each kept in order."""
    clean = F.filter(F.transform(values, normalize_scenario), lambda x: x != "")
    return first_spellings(clean)


def default_scenarios(values: Column, sentence: str) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.array(F.lit(sentence))).otherwise(values)


def text_cache_key(model: str, text: Column) -> Column:
    return F.concat(F.lit(model + ":"), F.sha2(text, 256))


def url_record_id(task: Column, url: Column) -> Column:
    return F.concat(task, F.lit("::"), F.substring(F.sha1(url), 1, 12))


def clamp_int(v: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(v.try_cast("int"), F.lit(default))))


def clamp_score(v: Column) -> Column:
    return clamp_int(v, 1, 5, 1)


def safe_float(v: Column, default: float = 0.0) -> Column:
    return F.coalesce(v.try_cast("double"), F.lit(default))


def as_int_list(values: Column) -> Column:
    """Sorted different whole numbers; what is none is left out."""
    cast = F.transform(values, lambda x: x.try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(cast, lambda x: x.isNotNull())))


def normalize_string_list(values: Column) -> Column:
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")


def strip_fence(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(v), r"(?i)^```(json)?\s*", ""), r"\s*```$", "")


def parse_model_json(v: Column, field: str) -> Column:
    """A top-level field of the object in a model's answer: as it stands, unfenced, or from the first to the last brace."""
    whole = strip_fence(v)
    braces = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    return F.coalesce(F.get_json_object(whole, f"$.{field}"), F.get_json_object(braces, f"$.{field}"))


def truncate_head_tail(v: Column, most: int = 2000) -> Column:
    """Over ``most`` characters: 70 % from the start, a note of how many are gone, 30 % from the end."""
    head, tail = int(0.7 * most), int(0.3 * most)
    n = F.length(v)
    note = F.concat(F.lit("\n... ["), (n - head - tail).cast("string"), F.lit(" characters truncated] ...\n"))
    return F.when(n <= most, v).otherwise(F.concat(F.substring(v, 1, head), note, F.right(v, F.lit(tail))))


def truncate_prefix(v: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.substring(v, 1, most), F.lit(mark)))


def looks_like_date(v: Column) -> Column:
    return v.rlike(DATE_PATTERN)


def classify_content(summary: Column, filename: Column) -> Column:
    low, name = F.lower(summary), F.lower(filename)

    def has(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    ends = F.lit(False)
    for e in CODE_EXTENSIONS:
        ends = ends | F.endswith(name, F.lit(e))
    return F.when(has(FORM_WORDS), "form").when(has(TABLE_WORDS), "table").when(has(CODE_WORDS) | ends, "code").otherwise("text")


def tool_category(v: Column) -> Column:
    out = F.lit("other")
    for name, tools in TOOL_CATEGORIES.items():
        out = F.when(v.isin(tools), name).otherwise(out)
    return out


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(filename(path), r"\.([^.]*)$", 1))


def guess_extension(path: Column, kind: Column) -> Column:
    """The path's own suffix if short, else by the kind of entity, else .dat."""
    own = F.regexp_extract(filename(path), r"[^.](\.[^.]+)$", 1)
    by_kind = F.lit(".dat")
    for token, ext in reversed(ENTITY_EXTENSIONS):
        by_kind = F.when(F.contains(F.lower(kind), F.lit(token)), ext).otherwise(by_kind)
    return F.when((own != "") & (F.length(own) <= 12), own).otherwise(by_kind)


def pip_packages(command: Column) -> Column:
    """First package of each pip install in a command, as written."""
    found = F.regexp_extract_all(command, F.lit(r"pip3?\s+install\s+(?:--[^\s]+\s+)*([^\s&|;#]+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~F.startswith(x, F.lit("-")))))


def apt_packages(command: Column) -> Column:
    found = F.regexp_extract_all(command, F.lit(r"apt(?:-get)?\s+install\s+(?:-y\s+)?([^\s&|;#]+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~F.startswith(x, F.lit("-")))))


def redirect_targets(command: Column) -> Column:
    """Files that a shell command writes by redirection, without devices."""
    found = F.regexp_extract_all(command, F.lit(r">\s*([^\s&|;>]+)"), 1)
    return F.filter(found, lambda x: ~F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("/dev/")))


def skill_from_path(path: Column) -> Column:
    found = F.regexp_extract(path, r"/skills/([^/\s]+)", 1)
    return F.when(found.isin("*", "**"), "").otherwise(found)


def system_packages(text: Column) -> Column:
    low = F.lower(text)
    parts = [F.when(low.rlike(p), F.array(*[F.lit(x) for x in names])).otherwise(F.array().cast("array<string>")) for p, names in SYSTEM_PACKAGES]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def requirement_names(text: Column) -> Column:
    """Names in a requirements file, without comments and options."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[#-]"))
    return F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_.-]+(?:\[[^\]]*\])?)", 1)), lambda x: x != "")


def quality_record(env: Column, ver: Column, doc: Column) -> dict[str, Column]:
    """Overall score and whether the record stays; limits hold before rounding."""
    overall = QUALITY_WEIGHTS[0] * env + QUALITY_WEIGHTS[1] * ver + QUALITY_WEIGHTS[2] * doc
    e, v, d, o = QUALITY_LIMITS
    return {"overall_score": F.round(overall, 3), "keep": (env >= e) & (ver >= v) & (doc >= d) & (overall >= o)}


def task_evaluation(comp: Column, ver: Column, limit: float = 4.0) -> dict[str, Column]:
    overall = 0.5 * comp + 0.5 * ver
    keep = (comp >= limit) & (ver >= limit) & (overall >= limit)
    return {"overall_score": F.round(overall, 3), "keep": keep, "decision": F.when(keep, "keep").otherwise("reject")}


def alignment_type(compatible: Column, kind: Column, known: list[str]) -> Column:
    wrong, right = ALIGNMENT_TYPE_DEFAULTS
    return F.when(kind.isin(known), kind).when(compatible, right).otherwise(wrong)


def review_keep(given: Column, redundant: Column, overlap: Column, drop_at: int = 4) -> Column:
    """The reviewer's word if there is one, but never for redundant or much overlapping pairs."""
    gone = redundant | (overlap >= drop_at)
    return F.when(gone, False).otherwise(F.coalesce(given, ~gone))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_text(text: Column, most: int = 12_000) -> Column:
    """Non-empty pieces of at most ``most`` characters, trimmed; the whole text if it is short or none is left.

    A piece ends after the last line end in its second half, if there is one.
    """
    def pieces(n: Column) -> Column:
        def cut(state: Column, _: Column) -> Column:
            def at(window: Column, size: Column) -> Column:
                piece = F.trim(F.substr(window, F.lit(1), size), F.lit(" \t\n\r\x0b\f"))
                told = lambda p: F.struct((state.start + size).alias("start"), F.when(p != "", F.concat(state.pieces, F.array(p))).otherwise(state.pieces).alias("pieces"))
                return _bound(piece, told)

            def sized(window: Column, back: Column) -> Column:
                line = F.length(window) - back + 1  # characters up to and with the last line end
                size = F.when((state.start + most < n) & (back > 0) & (line - 1 > most // 2), line).otherwise(F.length(window))
                return _bound(size, lambda size: at(window, size))

            window = F.substr(text, state.start + 1, F.lit(most))
            return F.when(state.start < n, _bound(window, lambda w: _bound(F.instr(F.reverse(w), "\n"), lambda back: sized(w, back)))).otherwise(state)

        begin = F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("pieces"))
        steps = F.sequence(F.lit(0), F.ceil(n * 2 / most).cast("int"))  # every piece but the last is longer than half
        return _bound(F.aggregate(steps, begin, cut).pieces, lambda p: F.when(F.size(p) == 0, F.array(text)).otherwise(p))

    return F.when(F.length(text) <= most, F.array(text)).otherwise(_bound(F.length(text), pieces))
