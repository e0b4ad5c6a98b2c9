"""Score expressions, rounding as each place of use does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_probability(p: Column) -> Column:
    """round-half-even(1e6 * ln(p)), p kept within [1e-12, 1]."""
    return F.rint(F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))) * 1e6).cast("long")


def frequency_score(f: Column) -> Column:
    """round-half-away(1024 * ln(f + 1))."""
    return F.round(F.log(f + 1) * 1024).cast("long")


def heap_frequency_score(f: Column) -> Column:
    return F.when(f > 0, F.floor(F.log2(f.cast("double"))) * 6).otherwise(0).cast("long")


def skeleton_score(distance: Column, f: Column) -> Column:
    return (F.rint(F.log10(f + 1) * 600) - distance * 1000).cast("long")


def finite(score: Column) -> Column:
    low = F.lit(float("-inf"))
    return F.when(F.isnan(score) | score.isin(float("inf"), float("-inf")), low).otherwise(score)


def sentence_hash(tokens: Column) -> Column:
    return F.sha2(F.concat_ws("␟", tokens), 256)


def reciprocal_rank(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))
