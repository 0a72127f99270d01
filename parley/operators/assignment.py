"""Sequential selection rules of any size, settled in parallel rounds.

Items (a reply, a pair) have options in an order, and every group takes its first items up to a cap. In a round each item
asks for its first open option and each group keeps its first ones. A full group will never take anything behind its last
kept item, so those options are closed; items that lose one ask for their next. When a round closes nothing, the
selection is that of the walk over all options in order: both are the one stable assignment of these orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.topn import first_per_group
from parley.session import drop_staged, stage_counted

# Rows that one task walks in order; larger selections are settled in rounds.
WALK_ROWS = 1_000_000


def assign(options: DataFrame, item: str, group: str, choice: str, pos: str, cap: Column, most: int) -> DataFrame:
    """The options taken. `choice` orders the options of an item, `pos` those of a group; caps are at most `most`.

    Groups are few: the last kept place of each full one is sent to every task.
    """
    open_, n = stage_counted(options.withColumn("_cap", cap).where("_cap > 0"), "options", F.count("*"))
    row = F.struct(*[F.col(c) for c in open_.columns])
    while True:
        asked = open_.groupBy(item).agg(F.min_by(row, F.struct(choice, group)).alias("_row")).select("_row.*")
        kept = first_per_group(asked, [group], [F.col(pos)], most, rank="_rank", spread=F.col(item)).where("_rank <= _cap")
        kept, _ = stage_counted(kept.drop("_rank"), "kept", F.count("*"))
        ends = kept.groupBy(group).agg(F.count("*").alias("_n"), F.first("_cap").alias("_full"), F.max(pos).alias("_end"))
        ends = ends.where("_n >= _full").select(group, "_end")
        still = open_.join(F.broadcast(ends), group, "left").where(F.col("_end").isNull() | (F.col(pos) <= F.col("_end")))
        before, old = n, open_
        open_, n = stage_counted(still.select(*open_.columns), "options", F.count("*"))
        drop_staged(old)
        if n == before:
            return kept.drop("_cap")
        drop_staged(kept)
