"""Guarded ratios used by the metric jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int) -> Column:
    """Round a double half away from zero by scaling, without the detour over decimals that round() takes."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    scale = float(10**digits)
    return F.when(x < 0, -F.floor(0.5 - x * scale) / scale).otherwise(F.floor(x * scale + 0.5) / scale)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, or 0 on an empty denominator."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / both).otherwise(F.lit(0.0))
