"""Seeded samples that depend on rows alone, not on their partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ticket(key: str, seed: int) -> Column:
    """Rows are drawn by their ticket: SHA-256 of seed and key, so that any engine draws the same."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, all if fewer, each set of them equally likely over seeds. ``key`` tells rows apart; equal rows are drawn by chance of order.

    A map task keeps its ``n`` smallest tickets and sends only those.
    """
    return rows.withColumn("_t", _ticket(key, seed)).orderBy("_t", key).limit(n).drop("_t")


def sample_per_group(rows: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """Rows with their rank in the draw: ``n`` of each group, all if fewer. Map tasks keep a group's ``n`` smallest tickets before the shuffle."""
    w = Window.partitionBy(*by).orderBy("_t", key)
    return rows.withColumn("_t", _ticket(key, seed)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_t")
