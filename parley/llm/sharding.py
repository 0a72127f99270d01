"""Sharding over fixed virtual slots, with DataFrame functions only.

A record's slot is a hash of its content and never changes. The bytes of each slot are summed, and a versioned map
assigns slots to shards so that shard sizes come out nearly equal. Rebalancing edits the map: a new shard only
receives slots, and no slot moves between old shards.

Cases: null text has no bytes, `size` is then the overhead alone and `text_crc32` is 0. Null ids hash like any value.
Repeated rows share a slot. An empty table gives an empty result. Columns besides `doc_id` and `text` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.session import stage

SLOTS = 8192
OVERHEAD = 8


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(F.encode(text, "utf-8"))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        crc.alias("text_crc32"),
        # The text is hashed too, so that repeated ids do not fill one slot.
        F.pmod(F.xxhash64("doc_id", crc), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def assign_slots(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Slot-to-shard map: largest slot first, each to the shard with the fewest bytes so far."""
    load = [0] * shards
    where = {}
    for slot, size in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        shard = min(range(shards), key=lambda s: (load[s], s))
        where[slot] = shard
        load[shard] += size
    return where


def add_shard(where: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Edit of the map for one more shard: it takes slots from the fullest shards until it has an equal share."""
    new, load, held = dict(where), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in where.items():
        load[shard] += sizes[slot]
        held[shard].append(slot)
    for slots in held:
        slots.sort(key=lambda s: (-sizes[s], s))
    share, got = sum(load) / (shards + 1), 0
    while got < share:
        fullest = max(range(shards), key=lambda s: (load[s], -s))
        fitting = next((i for i, s in enumerate(held[fullest]) if got + sizes[s] <= share), None)
        if fitting is None:
            break
        slot = held[fullest].pop(fitting)
        new[slot] = shards
        load[fullest] -= sizes[slot]
        got += sizes[slot]
    return new


def _rows(spark: SparkSession, version: int, where: dict[int, int], sizes: dict[int, int]) -> DataFrame:
    """Table of one map version; the values travel as one literal per column, at most a row per slot."""
    lines = ",".join(f"{s} {where[s]} {sizes[s]}" for s in sorted(where))
    return (
        spark.range(1)
        .select(F.explode(F.split(F.lit(lines), ",")).alias("line"))
        .select(F.split("line", " ").alias("p"))
        .where(F.size("p") == 3)
        .select(
            F.lit(version).alias("version"),
            F.col("p")[0].cast("int").alias("virtual_slot"),
            F.col("p")[1].cast("int").alias("shard"),
            F.col("p")[2].cast("long").alias("bytes"),
        )
    )


def shard(docs: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Rows with their shard and position in it, and the stored map (version 1: `shards`; version 2: one more)."""
    spark = docs.sparkSession
    rows = stage(records(docs, slots), "shard-records")
    # One row per virtual slot: bounded by the number of slots.
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    sizes = {r["virtual_slot"]: r["bytes"] for r in sums}
    first = assign_slots(sizes, shards)
    second = add_shard(first, sizes, shards)
    versions = stage(_rows(spark, 1, first, sizes).union(_rows(spark, 2, second, sizes)), "slot-map")
    # Rows before each slot, within its shard.
    counts, before, seen = {r["virtual_slot"]: r["n"] for r in sums}, {}, [0] * shards
    for slot in sorted(first):
        before[slot] = seen[first[slot]]
        seen[first[slot]] += counts[slot]
    start = _rows(spark, 0, first, before).select("virtual_slot", F.col("bytes").alias("before"))
    current = versions.where("version = 1").select("virtual_slot", "shard")
    grown = versions.where("version = 2").select("virtual_slot", F.col("shard").alias("rebalanced_shard"))
    places = current.join(F.broadcast(grown), "virtual_slot").join(F.broadcast(start), "virtual_slot")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = (
        rows.withColumn("position", F.row_number().over(inside) - 1)
        .join(F.broadcast(places), "virtual_slot")
        .withColumn("slot", F.col("before") + F.col("position"))
    )
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot", "rebalanced_shard"), versions
