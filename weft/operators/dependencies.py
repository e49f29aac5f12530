"""Packages that skills and runs need: declared, installed by command, imported, or found at run time."""

from __future__ import annotations

import ast
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import scalars, scanners

#: Modules of the standard library: this Python's, and those that older ones had.
STANDARD = sorted(
    set(sys.stdlib_module_names)
    | set("aifc asynchat asyncore audioop binhex cgi cgitb chunk crypt distutils imghdr imp lib2to3 mailcap nis nntplib ossaudiodev pipes smtpd sndhdr spwd sunau telnetlib test uu xdrlib".split())
)

# Packages whose name is not that of their module.
PACKAGES = {
    "PIL": "Pillow", "cv2": "opencv-python", "sklearn": "scikit-learn", "skimage": "scikit-image", "yaml": "PyYAML", "bs4": "beautifulsoup4", "dotenv": "python-dotenv",
    "dateutil": "python-dateutil", "wx": "wxPython", "serial": "pyserial", "usb": "pyusb", "Bio": "biopython", "cv": "opencv-python", "docx": "python-docx", "pptx": "python-pptx",
    "fitz": "PyMuPDF", "tabula": "tabula-py", "camelot": "camelot-py", "flask": "Flask", "django": "Django", "sqlalchemy": "SQLAlchemy", "psycopg2": "psycopg2-binary", "google": "google-cloud",
}
INSTALLERS = {"pip": "pip3 install --break-system-packages ", "apt": "apt-get install -y ", "conda": "conda install -y "}


def imports_to_packages(imports: Column, standard: list[str] | None = None) -> Column:
    """Packages of an array of modules, sorted: those of the standard library are left out, others mapped or named alike."""
    known = F.create_map(*[F.lit(x) for kv in PACKAGES.items() for x in kv])
    own = F.filter(imports, lambda m: ~m.isin(STANDARD if standard is None else standard))
    return F.array_sort(F.array_distinct(F.transform(own, lambda m: F.coalesce(known[m], m))))


def _imports(source: str) -> list[str]:
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return sorted({m for line in source.splitlines() for m in scanners._IMPORT.findall(line.strip())[:1]})
    found = {a.name.split(".")[0] for n in nodes if isinstance(n, ast.Import) for a in n.names}
    return sorted(found | {n.module.split(".")[0] for n in nodes if isinstance(n, ast.ImportFrom) and n.module})


def imports_of(source: Column) -> Column:
    """Top-level modules that Python source imports, anywhere in it, sorted; of source that does not parse those of its lines."""

    def run(sources: pd.Series) -> pd.Series:
        return sources.map(_imports, na_action="ignore")

    return F.pandas_udf(run, "array<string>")(source)


def conda_packages(command: Column) -> Column:
    """First package of each conda or mamba install in a command, as written."""
    found = F.regexp_extract_all(command, F.lit(r"(?:conda|mamba)\s+install\s+(?:-y\s+)?(?:-c\s+\w+\s+)?([^\s&|;#]+)"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~F.startswith(x, F.lit("-")))))


def _rows(df: DataFrame, owner: str, found: list[tuple[str, str, Column]]) -> DataFrame:
    """(owner, manager, package, source) of arrays of packages."""
    def told(manager: str, source: str, packages: Column) -> Column:
        return F.transform(F.coalesce(packages, F.array().cast("array<string>")), lambda p: F.struct(F.lit(manager).alias("manager"), p.alias("package"), F.lit(source).alias("source")))

    each = F.flatten(F.array(*[told(*f) for f in found]))
    return df.select(owner, F.explode(each).alias("d")).select(owner, "d.*").where(F.coalesce("package", F.lit("")) != "").distinct()


def skill_dependencies(files: DataFrame, owner: str = "skill", path: str = "path", text: str = "text") -> DataFrame:
    """(owner, manager, package, source) of the files of skills: requirements, declared dependencies, system packages
    that the document speaks of, and imports of scripts.

    Files of other names, NULL texts and broken JSON give nothing; equal rows are one.
    """
    name = F.regexp_extract(path, "([^/]*)$", 1)
    body = F.col(text)
    declared = F.from_json(F.when(name == "dependencies.json", body), "struct<pip: array<string>, apt: array<string>, conda: array<string>>")
    script = F.col(path).rlike(r"(^|/)scripts/[^/]+\.py$")
    return _rows(files.withColumn("_i", imports_of(F.when(script, body))), owner, [
        ("pip", "skill_requirements", F.when(name == "requirements.txt", scalars.requirement_names(body))),
        ("pip", "skill_dependencies_json", declared["pip"]), ("apt", "skill_dependencies_json", declared["apt"]), ("conda", "skill_dependencies_json", declared["conda"]),
        ("apt", "skill_md_analysis", F.when(name == "SKILL.md", scalars.system_packages(body))), ("pip", "skill_requirements", imports_to_packages(F.col("_i"))),
    ])


def run_dependencies(steps: DataFrame, owner: str = "session", command: str = "command", path: str = "path", content: str = "content") -> DataFrame:
    """(owner, manager, package, source) of a run's steps: installs by command and imports of the Python files that it wrote."""
    written = F.when(F.col(path).endswith(".py"), F.col(content))
    return _rows(steps.withColumn("_i", imports_of(written)), owner, [
        ("pip", "trajectory_commands", scalars.pip_packages(F.col(command))), ("apt", "trajectory_commands", scalars.apt_packages(F.col(command))),
        ("conda", "trajectory_commands", conda_packages(F.col(command))), ("pip", "trajectory_imports", imports_to_packages(F.col("_i"))),
    ])


def runtime_dependencies(frozen: DataFrame, baseline: DataFrame, owner: str = "session", line: str = "line") -> DataFrame:
    """(owner, manager, package, source) of pinned packages that the baseline's lines do not have, ignoring case."""
    def names(df: DataFrame) -> DataFrame:
        return df.where(F.contains(F.col(line), F.lit("=="))).withColumn("package", F.trim(F.substring_index(line, "==", 1)))

    had = names(baseline).select(F.lower("package").alias("_had")).distinct()
    new = names(frozen).join(had, F.lower("package") == F.col("_had"), "left_anti")
    return new.select(owner, F.lit("pip").alias("manager"), "package", F.lit("runtime_freeze").alias("source")).where("package <> ''").distinct()


def install_commands(packages: DataFrame, owner: str) -> DataFrame:
    """(owner, pip, apt, conda): the command that installs an owner's packages, sorted; empty without any."""
    def command(manager: str) -> Column:
        listed = F.array_sort(F.collect_set(F.when(F.col("manager") == manager, F.col("package"))))
        return F.when(F.size(listed) == 0, "").otherwise(F.concat(F.lit(INSTALLERS[manager]), F.array_join(listed, " "))).alias(manager)

    return packages.groupBy(owner).agg(*[command(m) for m in INSTALLERS])


def most_needed(packages: DataFrame, owner: str, n: int = 10) -> DataFrame:
    """(manager, package, owners): the packages that most owners need, ties by name."""
    counted = packages.groupBy("manager", "package").agg(F.count_distinct(owner).alias("owners"))
    return counted.orderBy(F.desc("owners"), "package", "manager").limit(n)
