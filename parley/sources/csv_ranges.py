"""CSV records with quoted line breaks, read by byte ranges.

A line break inside quotes cannot be told from one between records by looking at a range alone. So the first pass only
counts quotes: their parity per range, summed over the ranges before, says whether a range begins inside quotes. The
second pass reads each range where it lies and puts lines together to records. A record that crosses ranges comes in
fragments, at most one at either end of a range; those alone are shuffled and joined.

Quotes inside a field are doubled and such fields are quoted, as CSV writers do; a file with an odd number of quotes is an
error. Lines end in line feeds. The first record of a file is its header; records of white space alone are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# One row per byte range is sent to every task.
MAX_RANGES = 1_000_000
RANGE = ["file", "start", "length"]
PIECES = "file string, start long, at long, text string, kind string"
# A whole record, or a fragment: the head ends a record of an earlier range, the tail begins one that a later range ends,
# and a range that lies inside one record is its middle.
WHOLE, HEAD, MIDDLE, TAIL = "whole", "head", "middle", "tail"


def _lines(reader) -> DataFrame:
    """Lines in file order within each range. `reader` loads a table of text lines, given its format."""
    return reader.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        "value",
    )


def _parities(lines: DataFrame) -> DataFrame:
    """RANGE and `inside`: does the range begin inside quotes?"""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = lines.groupBy(*RANGE).agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    odd = F.raise_error(F.concat(F.lit("odd number of quotes in "), F.col("file"))).cast("long")
    checked = F.when(F.sum("quotes").over(whole) % 2 == 0, F.coalesce(F.sum("quotes").over(before), F.lit(0))).otherwise(odd)
    return ranges.select(*RANGE, (checked % 2 == 1).alias("inside"))


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of ranges, in order, to records and fragments."""
    now: tuple | None = None
    opened: list[str] = []  # lines of a record that is not closed yet
    inside = headless = False
    at = 0

    def rest() -> list[tuple]:
        """What the end of a range leaves open."""
        return [(now[0], now[1], at, "\n".join(opened), MIDDLE if headless else TAIL)] if opened else []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        parts = zip(*rows) if rows else ([],) * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], ("file", "start", "at", "text", "kind"))

    for batch in batches:
        file, start, length, value, begins = (batch.column(i) for i in range(5))
        n = batch.num_rows
        if not n:
            continue
        if begins.null_count:
            raise RuntimeError("the byte ranges of a file changed between two reads; run the job again")
        odd = (pc.count_substring(value, '"').to_numpy() % 2).astype(np.int64)
        starts, files = start.to_numpy(), file.dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1]) | (files[1:] != files[:-1])])).tolist() + [n]
        for a, b in zip(edges, edges[1:]):
            key = (file[a].as_py(), start[a].as_py(), length[a].as_py())
            rows: list[tuple] = []
            if key != now:
                rows += rest()
                now, opened, at = key, [], 0
                inside = headless = begins[a].as_py()
            # Is a record open behind each line?
            open_after = (np.cumsum(odd[a:b]) + inside) % 2
            closed = np.flatnonzero(open_after == 0)
            lines = value.slice(a, b - a).to_pylist()
            line = 0
            for end in closed.tolist():
                text = "\n".join([*opened, *lines[line : end + 1]]) if opened or end > line else lines[end]
                rows.append((key[0], key[1], at, text, HEAD if headless else WHOLE))
                opened, headless, line = [], False, end + 1
                at += 1
            opened += lines[line:]
            inside = bool(open_after[-1])
            yield batch_of(rows)
    if now is not None:
        yield batch_of(rest())


def records(reader) -> DataFrame:
    """file, start, at, record: whole records without the headers, (start, at) in file order.

    `reader` is a DataFrame of text lines: spark.read.option("lineSep", "\\n").text(...).
    """
    lines = _lines(reader)
    ranges = _parities(lines)
    n = ranges.count()
    if n > MAX_RANGES:
        raise ValueError(f"{n} byte ranges are too many to send to every task; raise spark.sql.files.maxPartitionBytes")
    # A broadcast join leaves the lines of a range in their order.
    pieces = lines.join(F.broadcast(ranges), RANGE, "left").select(*RANGE, "value", "inside").mapInArrow(_pieces_of, PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "start", "at", F.col("text").alias("record"))
    # A record across ranges begins with a tail and ends with the next head.
    order = Window.partitionBy("file").orderBy("start", "at")
    number = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order)
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("number", number)
    first = F.min(F.struct("start", "at")).alias("first")
    texts = F.array_sort(F.collect_list(F.struct("start", "at", "text")))
    across = parts.groupBy("file", "number").agg(first, F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("record"))
    found = whole.unionByName(across.select("file", "first.start", "first.at", "record"))
    header = (F.col("start") == 0) & (F.col("at") == 0)
    return found.where(~header & (F.trim(F.translate("record", "\r\t\n", "   ")) != ""))


def read_csv(reader, schema: str) -> DataFrame:
    """file, start, at and the columns of the schema, by position as in the files."""
    options = {"escape": '"', "multiLine": "true"}
    record = F.regexp_replace("record", "\r$", "")
    return records(reader).select("file", "start", "at", F.from_csv(record, schema, options).alias("r")).select("file", "start", "at", "r.*")
