"""Most frequent values of a large column, with few of its values shuffled.

Two rounds: values are counted by hash bucket first, so a task sends at most BUCKETS numbers and no value. The bucket's
total bounds the count of every value in it. The heaviest buckets are then counted by value; the k-th best of these counts
is one that the result cannot fall below, so only values of buckets that reach it are counted at last.

Digests: long texts are counted by two digests of 192 bits together, and the texts of the winners alone are fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import stage

BUCKETS = 1 << 20
# Heaviest buckets that are counted by value to find the least count of the result, for each value asked for.
FIRST_BUCKETS = 4
# Inputs of more partitions than this are counted in two rounds: they are read three times to shuffle less.
LARGE_PARTITIONS = 1_000


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets))


def candidates(values: DataFrame, column: str, top_k: int, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the values that can be among the k most frequent."""
    rows = values.where(F.col(column).isNotNull()).withColumn("_bucket", _bucket(column, buckets))
    # At most `buckets` rows.
    totals = stage(rows.groupBy("_bucket").agg(F.count("*").alias("_total")), "buckets")
    first = totals.orderBy(F.desc("_total"), "_bucket").limit(FIRST_BUCKETS * top_k).select("_bucket")
    some = rows.join(F.broadcast(first), "_bucket").groupBy(column).agg(F.count("*").alias("n"))
    best = some.orderBy(F.desc("n")).limit(top_k).agg(F.when(F.count("*") >= top_k, F.min("n")).alias("kth")).first()
    heavy = totals.where(F.col("_total") >= (best["kth"] or 0)).select("_bucket")
    return rows.join(F.broadcast(heavy), "_bucket", "left_semi").drop("_bucket")


def most_frequent(values: DataFrame, column: str, top_k: int, two_rounds: bool | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(column, n) of the k most frequent values; ties go to the smaller value. Both ways give the same rows."""
    if two_rounds is None:
        two_rounds = values.rdd.getNumPartitions() > LARGE_PARTITIONS
    rows = candidates(values, column, top_k, buckets) if two_rounds else values.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(top_k)


def digest_counts(df: DataFrame, column: str) -> DataFrame:
    """_md5, _hash, n: rows per distinct text; a null text has a null _md5. Equal md5 with another hash is another text."""
    digests = df.select(F.unhex(F.md5(F.col(column))).alias("_md5"), F.xxhash64(column).alias("_hash"))
    return digests.groupBy("_md5", "_hash").agg(F.count("*").alias("n"))


def most_frequent_texts(df: DataFrame, column: str, top_k: int) -> DataFrame:
    """(value, n) of the k most frequent texts. Only texts with the k-th count or more are shuffled."""
    counts = stage(digest_counts(df, column).where("_md5 IS NOT NULL"), "digests")
    kth = counts.orderBy(F.desc("n")).limit(top_k).agg(F.min("n").alias("kth")).first()["kth"]
    winners = counts.where(F.col("n") >= F.lit(kth))
    texts = df.select(
        F.col(column).alias("value"), F.unhex(F.md5(F.col(column))).alias("_md5"), F.xxhash64(column).alias("_hash")
    )
    found = texts.join(winners, ["_md5", "_hash"]).groupBy("_md5", "_hash", "n").agg(F.min("value").alias("value"))
    return found.select("value", "n").orderBy(F.desc("n"), "value").limit(top_k)
