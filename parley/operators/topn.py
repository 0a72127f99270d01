"""First rows per group, and positions over a whole table, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import stage

SALTS = 64
# Up to this many rows per group the planner limits each group before its first shuffle.
EARLY_LIMIT = 1000


def _salt_levels(df: DataFrame, n: int) -> list[int]:
    """Numbers of parts that a group is cut into, step by step."""
    if n <= EARLY_LIMIT:
        return [SALTS]
    # No early limit: spread a group over all tasks first, then merge in steps of about equal size.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [tasks, max(2, round(tasks**0.5))]


def first_per_group(
    df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank", spread: Column | None = None
) -> DataFrame:
    """The first n rows of each group in the given order, with their rank from 1.

    A group may hold a large part of the table, so it is cut into salted parts first; only n rows per part
    reach the next step. `spread` is hashed for the salt (default: all columns).
    """
    key = [spread] if spread is not None else [F.col(c) for c in df.columns]
    few = df
    for parts in _salt_levels(df, n):
        window = Window.partitionBy(*group, "_salt").orderBy(*order)
        few = (
            few.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(parts)))
            .withColumn("_part_rank", F.row_number().over(window))
            .where(F.col("_part_rank") <= n)
            .drop("_salt", "_part_rank")
        )
    whole = Window.partitionBy(*group).orderBy(*order)
    return few.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)


def number_rows(df: DataFrame, order: list[str], position: str = "position") -> DataFrame:
    """Add each row's position from 1 in the given total order.

    Range partitions are numbered on their own and shifted by the row counts of the partitions before them.
    The partitioned rows are staged, because range bounds come from a sample and must not be drawn twice.
    """
    parts = stage(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition.
    shifts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        parts.join(F.broadcast(shifts), "_part")
        .withColumn(position, F.row_number().over(inside) + F.col("_shift"))
        .drop("_part", "_shift")
    )


def running_sums(
    df: DataFrame, order: list[str], sums: dict[str, Column], position: str = "position", total: str | None = None
) -> DataFrame:
    """Cumulative sums (and the position) in the given total order, one prefix per range partition.

    `total` names a column for the number of all rows.
    """
    parts = stage(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    totals = parts.groupBy("_part").agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_total_{name}") for name, c in sums.items()]
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    shifts = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), zero).alias("_shift"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
        *[F.coalesce(F.sum(f"_total_{name}").over(before), zero).alias(f"_shift_{name}") for name in sums],
    )
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(shifts), "_part").withColumn(
        position, F.count("*").over(upto) + F.col("_shift")
    )
    for name, c in sums.items():
        out = out.withColumn(name, F.sum(c).over(upto) + F.col(f"_shift_{name}"))
    final = [F.col("_all").alias(total)] if total else []
    return out.select(*df.columns, position, *sums, *final)
