"""Deterministic stand-ins for model judgements, as plug-in expressions.

A judge is a function from columns to columns. These answer by fixed rules, so that
whole runs can be repeated offline; a caller with a model passes its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Judge = Callable[[DataFrame], DataFrame]


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A unit-free vector of word hashes: one signed count per bucket."""
    words = F.split(F.lower(text), " ")
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.aggregate(words, F.lit(0.0), lambda a, w: a + F.when(F.pmod(F.xxhash64(w), F.lit(size)) == i, F.when(F.crc32(w.cast("binary")) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)),
    )


def judge_quality(text: Column) -> dict[str, Column]:
    """Three scores from 1 to 5 by length and structure."""
    n = F.length(text)
    return {
        "environment_cost_score": F.when(F.contains(text, F.lit("sudo")), 1).otherwise(4),
        "verifiability_score": F.greatest(F.lit(1), F.least(F.lit(5), (n / 500).cast("int") + 1)),
        "documentation_quality_score": F.greatest(F.lit(1), F.least(F.lit(5), F.size(F.split(text, "\n")))),
    }


def judge_alignment(score: Column) -> dict[str, Column]:
    """Compatible from a retrieval score of 0.3, confidence by fifths."""
    return {
        "compatible": score >= 0.3,
        "confidence": F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(score * 5).cast("int"))),
        "alignment_type": F.when(score >= 0.3, "data_state_handoff").otherwise("incompatible"),
    }


def safely(judge: Judge, defaults: dict[str, Column]) -> Judge:
    """A judge whose NULL answers become the given ones, with an error noted."""

    def run(df: DataFrame) -> DataFrame:
        out = judge(df)
        failed = F.lit(False)
        for name in defaults:
            failed = failed | F.col(name).isNull()
        return out.withColumn("error", F.when(failed, "no answer")).withColumns({n: F.coalesce(F.col(n), d) for n, d in defaults.items()})

    return run
