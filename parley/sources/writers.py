"""Writers. Large outputs stay spread over files; nothing is merged into one."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.threads import head_pairs, sort_pairs
from parley.operators.topn import number_rows

# Records of one file of arrays: a reader takes a file as a whole.
ARRAY_RECORDS = 10_000


def write_pairs(pairs: DataFrame, folder: str, sample: int = 50) -> None:
    """Pairs as snappy parquet and CSV, and the first rows as a small CSV. They are sorted once."""
    ordered = sort_pairs(pairs).persist(StorageLevel.DISK_ONLY)
    csv = {"header": True, "escape": '"', "encoding": "UTF-8"}
    try:
        ordered.write.mode("overwrite").option("compression", "snappy").parquet(f"{folder}/pairs")
        ordered.write.mode("overwrite").options(**csv).csv(f"{folder}/pairs_csv")
    finally:
        ordered.unpersist()
    kept = pairs.sparkSession.read.schema(pairs.schema).parquet(f"{folder}/pairs")
    head_pairs(kept, sample).write.mode("overwrite").options(**csv).csv(f"{folder}/pairs_sample")


def write_precedents(docs: DataFrame, path: str, by_category: bool = False) -> None:
    writer = docs.write.mode("overwrite")
    (writer.partitionBy("category") if by_category else writer).parquet(path)


def write_gold(gold: DataFrame, path: str) -> None:
    """JSON lines, one record per line, characters as they are."""
    gold.write.mode("overwrite").json(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_record_arrays(df: DataFrame, path: str, order: list[str], size: int = ARRAY_RECORDS) -> None:
    """JSON arrays of records, one array of bounded size per line and file, in the given order."""
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    placed = number_rows(df.select(*order, record.alias("_record")), order)
    part = F.floor((F.col("position") - 1) / size).alias("part")
    lists = placed.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("position", "_record"))).alias("r"))
    text = F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["_record"]), ","), F.lit("]"))
    lists.select("part", text.alias("value")).repartition("part").write.mode("overwrite").partitionBy("part").text(path)
