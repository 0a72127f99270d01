"""Readers with declared schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import schemas
from parley.functions import text as tx
from parley.operators.gold import GOLD_COLUMNS
from parley.operators.topn import number_rows
from parley.sources import csv_ranges


_CSV = "*.[cC][sS][vV]"
_LARGE = 10_000_000


def _csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and name of the CSV files below a folder, or of one file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _CSV)
    return files.load(folder).select("path", "length", F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"))


def locate_dump(spark: SparkSession, folder: str) -> str:
    """Path of the message dump below a folder: a CSV file named so or large, else the first CSV file.

    A table written in parts is one dump: its folder is returned. Raises FileNotFoundError where there is no CSV file.
    """
    likely = F.col("name").contains("twcs") | (F.col("length") > _LARGE)
    first = _csv_files(spark, folder).orderBy(likely.desc(), "path").first()
    if first is None:
        raise FileNotFoundError(f"no CSV file below {folder}")
    return first.path.rsplit("/", 1)[0] if first.name.startswith("part-") else first.path


def _exact_id(column: str) -> Column:
    """Id text to a long: blank is null, a trailing .0 is cut, anything else that is no whole number is an error."""
    value = tx.strip(F.col(column))
    whole = F.regexp_extract(value, r"^(-?[0-9]+)(\.0*)?$", 1)
    wrong = F.raise_error(F.concat(F.lit(f"{column} is not a whole number: "), value)).cast("long")
    return F.when(value.isNull() | (value == ""), F.lit(None).cast("long")).when(whole != "", whole.cast("long")).otherwise(wrong)


def read_messages(
    spark: SparkSession, path: str, columns: list[str] | None = None, n: int | None = None, name: str | None = None
) -> DataFrame:
    """Message dump in CSV form with quoted line breaks.

    By default `locate_dump` chooses below `path`, which may also be a file. `name` is a file name pattern, matched
    ignoring case; all files that match are read then. Raises FileNotFoundError where nothing is found.
    Files are read by byte ranges, also inside quoted line breaks. `n` gives the first rows in file order.
    """
    # Carriage returns stay with their lines, so that those inside quotes are kept.
    reader = spark.read.option("lineSep", "\n")
    if name is None:
        lines = reader.text(locate_dump(spark, path))
    else:
        pattern = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)
        found = _csv_files(spark, path).where(F.col("name").rlike(_glob(name.lower())))
        if found.isEmpty():
            raise FileNotFoundError(f"no file {name} below {path}")
        lines = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    # The parent id is written as a float where the column has gaps, so it is read as text.
    schema = schemas.MESSAGES.replace("in_response_to_tweet_id long", "in_response_to_tweet_id string")
    df = csv_ranges.read_csv(lines, schema)
    if n:
        df = df.orderBy("file", "start", "at").limit(n)
    df = df.drop("file", "start", "at").withColumn("in_response_to_tweet_id", _exact_id("in_response_to_tweet_id"))
    return df.select(*columns) if columns else df


def _glob(name: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in name) + "$"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAIRS).parquet(path)


def load_precedents(spark: SparkSession, path: str) -> DataFrame:
    """Precedent documents; an absent path gives an empty table. Where no doc_ord is stored, doc_id gives the order."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(location):
        return spark.createDataFrame([], "doc_ord long, " + schemas.PRECEDENTS)
    df = spark.read.schema("doc_ord long, " + schemas.PRECEDENTS).parquet(path)
    df = df.withColumn("is_policy", F.coalesce("is_policy", F.lit(False)))
    if df.where("doc_ord is null").isEmpty():
        return df
    return number_rows(df.drop("doc_ord"), ["doc_id"]).withColumn("doc_ord", F.col("position") - 1).drop("position")


def gold_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to records; blank lines and comment lines are skipped."""
    line = tx.strip(F.col(column))
    schema = f"{schemas.GOLD}, {schemas.GOLD_ALIASES}"
    return (
        lines.where((line != "") & ~line.startswith("#"))
        .select(F.from_json(line, schema).alias("r"))
        .select("r.*")
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return gold_records(spark.read.text(path)).select(*GOLD_COLUMNS)


def read_records(spark: SparkSession, path: str, schema: str = schemas.EVALUATED, lines: bool = False) -> DataFrame:
    """A JSON array of records per file, or with `lines` one record per line. Only lines can be split among tasks."""
    return spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True).json(path)


def read_baseline_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested baseline results to one row per system."""
    metrics = (
        "intent_accuracy double, escalation_accuracy double, escalation_precision double, escalation_recall double, "
        "false_escalation_rate double, missed_escalation_rate double, total_samples long"
    )
    confusion = "true_positives:long,false_positives:long,true_negatives:long,false_negatives:long"
    inner = metrics.replace(" ", ":").replace(",:", ",") + f",escalation_confusion:struct<{confusion}>"
    raw = spark.read.schema(f"baselines map<string, struct<{inner}>>").option("multiLine", True).json(path)
    return raw.select(F.explode("baselines").alias("system", "m")).select(
        F.regexp_replace("system", "^trivial_baseline_", "trivial_").alias("system"),
        "m.*",
        F.col("m.escalation_confusion.true_positives").alias("tp"),
        F.col("m.escalation_confusion.false_positives").alias("fp"),
        F.col("m.escalation_confusion.true_negatives").alias("tn"),
        F.col("m.escalation_confusion.false_negatives").alias("fn"),
    ).drop("escalation_confusion")
