"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text.

Each level only looks at the rows whose group of the level before has more than one member: a prefix is hashed where
another text has the same length, the whole text where another one has the same length and prefix hash, and only those
take part in the last grouping.

Cases: null text counts as empty. Of equal texts the row with the largest id stays; null ids come last, and of
repeated rows with that id exactly one stays. An empty table gives an empty result. Columns named like the
operator's own may be carried, because they travel inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import stage, stage_counted

PREFIX = 256
# A table of up to so many lengths, or pairs of length and prefix hash, 16 bytes each, is sent to every task.
BROADCAST_PAIRS = 500_000


def _repeated(rows: DataFrame, keys: list[str], mark: str, name: str) -> DataFrame:
    """Keys with more than one row, marked; counts are summed before the shuffle."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias(mark))
    found, n = stage_counted(found, name, F.count("*"))
    return F.broadcast(found) if n <= BROADCAST_PAIRS else found


def exact_groups(
    docs: DataFrame, carry: Column, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX
) -> DataFrame:
    """One row per input row: doc_id, carried, sha256 (null where no level found a partner), keep_id, group_size, kept.

    `carry` is evaluated where the text is read, and travels with the row.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # Built from the input alone, so that columns of any name can be carried.
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), carry.alias("carried"), whole.alias("_whole"), F.octet_length(whole).alias("_bytes")
    )
    # Level 1: lengths.
    lengths = _repeated(rows.select("_bytes"), ["_bytes"], "_long", "dup-lengths")
    # Level 2: hash of a prefix, of the rows whose length is not alone.
    head = F.when(F.col("_long"), F.xxhash64(F.substring(F.encode(F.col("_whole"), "utf-8"), 1, prefix)))
    rows = rows.join(lengths, "_bytes", "left").withColumn("_head", head)
    open_pairs = _repeated(rows.where("_long").select("_bytes", "_head"), ["_bytes", "_head"], "_open", "dup-pairs")
    # Level 3: the whole text, for survivors.
    sha = F.when(F.col("_open"), F.sha2(F.encode(F.col("_whole"), "utf-8"), 256))
    narrow = stage(
        rows.join(open_pairs, ["_bytes", "_head"], "left").select(
            "doc_id",
            "carried",
            sha.alias("sha256"),
            F.monotonically_increasing_id().alias("_tag"),
        ),
        "dup-rows",
    )
    alone = narrow.where(F.col("sha256").isNull()).select(
        "doc_id",
        "carried",
        "sha256",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    some = narrow.where(F.col("sha256").isNotNull())
    # Staged, so that the join shuffles both sides directly and a text with very many copies can be split.
    groups = stage(
        some.groupBy("sha256").agg(F.max(F.struct("doc_id", "_tag")).alias("_stays"), F.count("*").alias("group_size")),
        "dup-groups",
    )
    grouped = some.join(groups, "sha256").select(
        "doc_id",
        "carried",
        "sha256",
        F.col("_stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_tag") == F.col("_stays._tag")).alias("kept"),
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the copies, all columns kept."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return exact_groups(docs, row, doc_id, text).where("kept").select("carried.*")
