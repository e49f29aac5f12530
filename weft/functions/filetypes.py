"""File types by ending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The type of files by ending, and which profiler reads them.
FILE_TYPES = {
    "document": "pdf doc docx", "text": "txt md rst", "spreadsheet": "xlsx xls", "data": "csv json xml yaml yml toml",
    "code": "py js ts java cpp c h hpp go rs rb php sh bash sql html css", "image": "png jpg jpeg gif svg webp",
    "archive": "zip tar gz rar", "binary": "stl obj bin",
}
CATEGORIES = {
    "table": "csv xlsx xls xlsm xltx tsv", "document": "pdf docx doc txt md rtf", "code": "py js ts java cpp c go rs rb php sh", "notebook": "ipynb",
    "image": "png jpg jpeg gif tiff bmp webp", "scientific": "fasta fa fastq fq vcf sam bam fits geojson", "presentation": "pptx ppt",
    "data": "json xml yaml yml", "markup": "html",
}


def suffix(path: Column) -> Column:
    """The lower-case ending without its dot; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^/.]+)/*$", 1))


def _of(kinds: dict[str, str], ending: Column) -> Column:
    pairs = [F.lit(x) for kind, endings in kinds.items() for e in endings.split() for x in (e, kind)]
    return F.coalesce(F.create_map(*pairs)[ending], F.lit("unknown"))


def file_type(path: Column) -> Column:
    """document, text, spreadsheet, data, code, image, archive, binary or unknown."""
    return _of(FILE_TYPES, suffix(path))


def category(path: Column) -> Column:
    """The profiler that reads a file, or unknown."""
    return _of(CATEGORIES, suffix(path))
