"""Columns whose expressions later rewrites must not copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_sealed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and the new columns, made by inlining a one-row array.

    A filter or join on a plain derived column makes the optimizer copy its expression below the projection, which
    repeats costly pattern tests. Output of a generator is not copied, so each expression runs once per row.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
