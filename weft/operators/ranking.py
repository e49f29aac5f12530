"""Ranking, de-duplication, set and join operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, min_value: Column | None = None) -> DataFrame:
    """The first k rows of each key; rows failing ``min_value`` are left out before the ranking."""
    kept = df if min_value is None else df.where(min_value)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_k(df, keys, order, 1).drop("rank")


def ordered_distinct(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """(key, values): each key's different values in order of first occurrence."""
    first = df.groupBy(key, value).agg(F.min(ordinal).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias("values"))


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key by ``ordinal``."""
    return keep_first(df, keys, [F.desc(ordinal)])


def keep_and_reject(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are kept (strictly true) and all others."""
    strict = F.coalesce(keep, F.lit(False))
    return df.where(strict), df.where(~strict)


def pending(candidates: DataFrame, done: DataFrame, keys: list[str], succeeded: Column) -> DataFrame:
    """Candidates that no earlier run has finished: failed ones come again."""
    return candidates.join(done.where(succeeded).select(keys).distinct(), keys, "left_anti")


def first_pending(candidates: DataFrame, done: DataFrame, keys: list[str], succeeded: Column, n: int, *order: Column | str) -> DataFrame:
    """At most ``n`` candidates that no earlier run has finished, the first in order."""
    return pending(candidates, done, keys, succeeded).orderBy(*order).limit(n)


def download_status(requests: DataFrame, task: str, url: str, content_hash: str, ordinal: str) -> DataFrame:
    """Status of each request of a task: first of its URL, same content under another URL, or stored."""
    by_url = Window.partitionBy(task, url).orderBy(ordinal)
    numbered = requests.withColumn("_u", F.row_number().over(by_url))
    firsts = F.when(F.col("_u") == 1, F.col(ordinal))
    by_content = Window.partitionBy(task, content_hash)
    status = (
        F.when(F.col(url).isNull() | (F.col(url) == ""), "missing_url")
        .when(F.col("_u") > 1, "duplicate_url")
        .when(F.col(ordinal) > F.min(firsts).over(by_content), "duplicate_content")
        .otherwise("downloaded")
    )
    return numbered.withColumn("status", status).drop("_u")


def numbered_names(df: DataFrame, stem: str, ordinal: str) -> DataFrame:
    """Add ``unique_name``: the stem, and from its second use on with __2, __3 and so on."""
    n = F.row_number().over(Window.partitionBy(stem).orderBy(ordinal))
    return df.withColumn("unique_name", F.when(n == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("__"), n.cast("string"))))
