"""Profiles of files: columns of tables, code, notebooks, data and science formats, routed by type."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import filetypes, scalars, scanners

#: What stands for a missing value in delimited files.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def column_profile(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, position, name, n, different, kind, missing_ratio) of the columns of tables given as cells (by, row, position, name, value).

    A column is numeric if all its values are numbers (so one without values), bool if all cells are truth
    values, datetime if one of its first five values by ``row`` looks like a date, categorical if it has
    fewer different values than half its rows, else text. NULL and the usual marks are missing, and count as rows.
    """
    key = [*(by or []), "position", "name"]
    there = F.col("value").isNotNull() & ~F.col("value").isin(MISSING)
    known = cells.withColumn("value", F.when(there, F.col("value")))
    truth = F.lower("value").isin("true", "false")
    tally = known.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("different"), F.count("value").alias("values"),
        F.count_if(F.col("value").try_cast("double").isNotNull()).alias("numbers"), F.count_if(truth).alias("truths"),
    )
    first = Window.partitionBy(*key).orderBy("row")  # each map task keeps five rows a column
    head = known.where("value IS NOT NULL").withColumn("_r", F.row_number().over(first)).where("_r <= 5")
    dated = head.groupBy(*key).agg(F.max(scalars.looks_like_date(F.col("value"))).alias("dated"))
    kind = (
        F.when(F.col("numbers") == F.col("values"), "numeric").when(F.col("truths") == F.col("n"), "bool").when(F.col("dated"), "datetime")
        .when(F.col("different") < 0.5 * F.col("n"), "categorical").otherwise("text")
    )
    joined = tally.join(dated, key, "left")
    return joined.select(*key, "n", "different", kind.alias("kind"), F.round((F.col("n") - F.col("values")) / F.col("n"), 3).alias("missing_ratio"))


def notebook_profile(document: Column) -> Column:
    """(cell_count, code_cell_count, markdown_cell_count, has_outputs, imports, programming_language) of a notebook's JSON; NULL if it is none."""
    shape = "struct<cells: array<struct<cell_type: string, source: string, outputs: array<string>>>, metadata: struct<kernelspec: struct<language: string>>>"
    book = F.from_json(document, shape)
    cells = F.coalesce(book["cells"], F.from_json(F.lit("[]"), "array<struct<cell_type: string, source: string, outputs: array<string>>>"))
    code = F.filter(cells, lambda c: c.cell_type == "code")

    def text(cell: Column) -> Column:  # a source is a text or a list of texts
        return F.coalesce(F.array_join(F.from_json(cell.source, "array<string>"), ""), cell.source, F.lit(""))

    imports = F.flatten(F.transform(code, lambda c: F.regexp_extract_all(text(c), F.lit(r"(?m)^(?:from|import)\s+(\w+)"), 1)))
    return F.when(book.isNotNull() & F.startswith(F.ltrim(document), F.lit("{")), F.struct(
        F.size(cells).alias("cell_count"), F.size(code).alias("code_cell_count"), F.size(F.filter(cells, lambda c: c.cell_type == "markdown")).alias("markdown_cell_count"),
        F.exists(code, lambda c: F.coalesce(F.size(c.outputs), F.lit(0)) > 0).alias("has_outputs"), F.slice(F.array_sort(F.array_distinct(imports)), 1, 15).alias("imports"),
        F.coalesce(book["metadata"]["kernelspec"]["language"], F.lit("python")).alias("programming_language"),
    ))


# Fields of science by ending.
DOMAINS = {"fasta": "bioinformatics", "fa": "bioinformatics", "fastq": "bioinformatics", "fq": "bioinformatics", "vcf": "bioinformatics", "sam": "bioinformatics", "bam": "bioinformatics", "fits": "astronomy", "geojson": "geospatial"}


def science_profile(path: Column, content: Column) -> Column:
    """(scientific_domain, data_format, sample_count, feature_count, coordinate_system): sequences of FASTA and FASTQ, features of GeoJSON."""
    ending = filetypes.suffix(path)
    lines = F.size(F.split(content, "\n")) - F.endswith(content, F.lit("\n")).cast("int")
    geo = F.from_json(content, "struct<features: array<string>, crs: struct<properties: struct<name: string>>>")
    samples = F.when(ending.isin("fasta", "fa"), F.size(F.filter(F.split(content, "\n"), lambda x: F.startswith(x, F.lit(">"))))).when(ending.isin("fastq", "fq"), F.floor(lines / 4).cast("int"))
    is_geo = (ending == "geojson") & F.startswith(F.ltrim(content), F.lit("{"))
    domain = F.coalesce(F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])[ending], F.lit("unknown"))
    return F.struct(
        domain.alias("scientific_domain"), ending.alias("data_format"), samples.alias("sample_count"),
        F.when(is_geo & geo.isNotNull(), F.coalesce(F.size(geo["features"]), F.lit(0))).alias("feature_count"),
        F.when(is_geo, F.nullif(geo["crs"]["properties"]["name"], F.lit(""))).alias("coordinate_system"),
    )


def _table(path: str, content: bytes) -> dict:
    """The first 1,000 rows of a delimited file, read as data frames read it: rows too long are skipped, broken bytes ignored."""
    df = pd.read_csv(io.BytesIO(content), delimiter="\t" if path.lower().endswith(".tsv") else ",", nrows=1000, on_bad_lines="skip", encoding_errors="ignore")
    kinds: dict[str, str] = {}
    for c in df.columns[:20]:
        kind = str(df[c].dtype)
        if "int" in kind or "float" in kind:
            kinds[str(c)] = "numeric"
        elif kind == "bool":
            kinds[str(c)] = "bool"
        elif any(re.match(scalars.DATE_PATTERN, x) for x in df[c].dropna().head(5).astype(str)):
            kinds[str(c)] = "datetime"
        else:
            kinds[str(c)] = "categorical" if df[c].nunique() < len(df) * 0.5 else "text"
    of = lambda k, n: [c for c, kind in kinds.items() if kind == k][:n]
    out = {
        "row_count": len(df), "column_count": len(df.columns), "column_names": [str(c) for c in df.columns[:20]], "column_types": kinds,
        "numeric_columns": of("numeric", 10), "date_columns": of("datetime", 5), "categorical_columns": of("categorical", 10),
    }
    return out | ({"missing_value_ratio": round(float(df.isna().sum().sum()) / df.size, 3)} if df.size else {})


def _data(path: str, content: bytes) -> dict:
    """Kind and size of JSON, root and children of XML."""
    if path.lower().endswith(".json"):
        data = json.loads(content.decode())
        if isinstance(data, list):
            return {"data_structure": "array", "item_count": len(data)}
        return {"data_structure": "object", "top_level_keys": list(data)[:10]} if isinstance(data, dict) else {}
    if path.lower().endswith(".xml"):
        root = ET.fromstring(content)
        return {"root_tag": root.tag, "child_count": len(root)}
    return {}


def _in_batches(read) -> Column:
    """JSON of ``read(path, content)``; what it raises is told in at most 100 characters."""

    def one(path, content):
        if path is None or content is None:
            return None
        try:
            return json.dumps(read(path, bytes(content)), ensure_ascii=False)
        except Exception as e:  # noqa: BLE001  a profile never fails its file
            return json.dumps({"extraction_error": str(e)[:100]}, ensure_ascii=False)

    def run(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([one(p, c) for p, c in zip(paths, contents, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")


def profile_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Files (path, binary content) with ``category`` and ``metadata``: a JSON object of the size and of what the category's profiler tells.

    One scan: each row is routed to the profiler of its type, and the objects of different keys are merged. Types
    without a profiler here (images, office documents) have their size alone; NULL contents have a NULL size.
    """
    path, content = F.col(path_col), F.col(content_col)
    kind, text = filetypes.category(path), content.cast("string")
    table = (kind == "table") & filetypes.suffix(path).isin("csv", "tsv")
    only = lambda which, c: F.when(which, c)  # noqa: E731  other files' contents are not sent to Python
    told = (
        F.when(table, _in_batches(_table)(only(table, path), only(table, content)))
        .when(kind == "code", F.to_json(scanners.code_profile(only(kind == "code", path), only(kind == "code", text))))
        .when(kind == "notebook", F.coalesce(F.to_json(notebook_profile(text)), F.lit('{"extraction_error":"no notebook"}')))
        .when(kind == "scientific", F.to_json(science_profile(path, text)))
        .when(kind == "data", _in_batches(_data)(only(kind == "data", path), only(kind == "data", content)))
    )
    size = F.concat(F.lit('{"file_size_bytes":'), F.coalesce(F.octet_length(content).cast("string"), F.lit("null")))
    merged = F.when(F.coalesce(told, F.lit("{}")) == "{}", F.concat(size, F.lit("}"))).otherwise(F.concat(size, F.lit(","), F.substring(told, 2, 2**31 - 2)))
    return files.withColumns({"category": kind, "metadata": merged})


# The fields told first, and those never told.
PRIORITY = [
    "domain", "document_type", "language", "complexity_level", "page_count", "row_count", "column_count", "sheet_count",
    "column_names", "numeric_columns", "has_tables", "has_formulas", "field_count", "is_fillable", "potential_operations",
]
UNTOLD = {"extraction_error", "llm_extraction_error", "extraction_note", "file_size_bytes"}


def _value(v) -> str:
    if isinstance(v, list):
        return ", ".join(map(str, v[:5])) + (f"... (+{len(v) - 5} more)" if len(v) > 5 else "")
    if isinstance(v, dict):
        return json.dumps(v, ensure_ascii=False)[:150]
    if isinstance(v, bool):
        return "yes" if v else "no"
    return "N/A" if v is None else str(v)


def format_metadata_value(value: Column) -> Column:
    """A JSON value as text: the first five of a list, 150 characters of an object, yes or no, N/A for null; NULL stays NULL."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _value(json.loads(v)), na_action="ignore")

    return F.pandas_udf(run, "string")(value)


def metadata_text(name: Column, content_type: Column, path: Column, summary: Column, metadata: Column) -> Column:
    """A file's entry for a prompt: its summary, then its metadata's fields by priority, then others under 200 characters."""

    def lines(text: str | None) -> str:
        fields = json.loads(text) if text else {}
        if not fields:
            return ""
        told = [k for k in PRIORITY if k in fields]
        rest = [k for k in fields if k not in told and k not in UNTOLD and len(_value(fields[k])) < 200]
        return "\n\n**Metadata**:" + "".join(f"\n  - {k}: {_value(fields[k])}" for k in (*told, *rest))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lines)

    head = F.concat(F.lit("### "), name, F.lit("\n- **Content Type**: "), content_type, F.lit("\n- **Path**: "), path, F.lit("\n- **Summary**: "), summary)
    return F.concat(head, F.pandas_udf(run, "string")(metadata), F.lit("\n\n"))
