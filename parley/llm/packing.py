"""Packing of token pieces into sequences of a fixed budget, shortest pack first over the length histogram.

Documents are cut into pieces of at most the budget. Lengths are placed from the longest down: the pieces of one
length go to the packs with the most room left, as many packs at a time as share one pattern. Patterns and their counts
are all that is kept; they are joined back to the pieces by the rank of a piece among those of its length.

Cases: a null or empty text is one piece with the end id. Ties of length are ordered by task and place in it. Repeated
rows are separate documents. An empty table gives no pieces. Columns besides `doc_id` and `text` are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import tokens
from parley.llm.memory import tidy
from parley.session import stage

BUDGET = 4096
PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, rank_in_part long"


def cut(
    docs: DataFrame, tokenizer: str, budget: int = BUDGET, ids: bool = False, cache_words: int = tokens.CACHE_WORDS
) -> DataFrame:
    """Pieces of every document. `ids` adds their little-endian ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = tokens.word_ids(tokenizer, cache_words).encode, TaskContext.get().partitionId()
        seen = [0] * (budget + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary())):
                raw = encode(text.as_py())
                total = len(raw) // 4
                for start in range(0, total, budget):
                    own = raw[4 * start : 4 * (start + budget)]
                    n = len(own) // 4
                    row = (doc_id, start, n, zlib.crc32(own), total, part, seen[n])
                    rows.append(row + (own,) if ids else row)
                    seen[n] += 1
            columns = list(zip(*rows)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in PIECE.split(", ")]
    schema = pa.schema(list(zip(names, kinds)) + ([("ids", pa.binary())] if ids else []))
    return docs.select("doc_id", "text").mapInArrow(tidy(pieces), PIECE + (", ids binary" if ids else ""))


def plan(histogram: dict[int, int], budget: int = BUDGET) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths of one pack) per pattern.

    Every step moves all packs of one pattern, splits one of them, or opens at most two new ones, so the number of
    patterns stays within a few times the number of lengths.
    """
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(room: int, count: int, pattern: tuple[int, ...]) -> None:
        if count:
            packs.setdefault(room, []).append((count, pattern))
            heapq.heappush(rooms, -room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not packs[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else -1
            if room < length:
                # No pack has room: a new one takes pieces of this length until it is full, then the next.
                each = budget // length
                put(budget - each * length, left // each, (length,) * each)
                put(budget - (left % each) * length, 1 if left % each else 0, (length,) * (left % each))
                break
            count, pattern = packs[room].pop()
            moved = min(count, left)
            put(room, count - moved, pattern)
            put(room - length, moved, pattern + (length,))
            left -= moved
    return [p for room in sorted(packs) for p in packs[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Places for the pieces of each length as runs, ordered by length and rank.

    Run j serves `count` pieces of its length: the i-th goes to sequence `base + i` at `offset`.
    """
    runs: list[tuple[int, int, int, int]] = []
    base = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            runs.append((length, count, base, offset))
            offset += length
        base += count
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    length, count = table[:, 0], table[:, 1]
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    return {"length": length, "first": first, "base": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, budget: int = BUDGET) -> DataFrame:
    """pieces with sequence_id and offset. They must be staged: `part` and `rank_in_part` number them per length."""
    spark = pieces.sparkSession
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("_n"))
    # The histogram has one row per length: at most the budget.
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}
    runs = slots(plan(histogram, budget))
    start = {n: int(runs["first"][np.searchsorted(runs["length"], n)]) for n in histogram}
    # Pieces of a length in the parts before: one row per part and length.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_part.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    known = spark.sparkContext.broadcast((runs, start))  # a few runs per length: bounded by the budget

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        table, first = known.value
        at = length.map(first).to_numpy(np.int64) + rank.to_numpy(np.int64)
        run = np.searchsorted(table["first"], at, "right") - 1
        return pd.DataFrame({"sequence_id": table["base"][run] + at - table["first"][run], "offset": table["offset"][run]})

    rank = F.col("rank_in_part") + F.col("_before")
    placed = pieces.join(shifts, ["part", "length"]).withColumn("_at", place("length", rank))
    return placed.select(
        *[c for c in pieces.columns if c not in ("part", "rank_in_part")],
        F.col("_at.sequence_id").alias("sequence_id"),
        F.col("_at.offset").alias("offset"),
    )


def sequences(packed: DataFrame, budget: int = BUDGET, pad: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to the budget, from packed pieces that carry `ids`."""

    def build(pdf):
        import pandas as pd

        row = np.full(budget, pad, "<u4")
        for offset, own in zip(pdf["offset"], pdf["ids"]):
            row[offset : offset + len(own) // 4] = np.frombuffer(own, "<u4")
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [row.tobytes()]})

    return packed.groupBy("sequence_id").applyInPandas(build, "sequence_id long, ids binary")


def pack_documents(
    docs: DataFrame, tokenizer: str, budget: int = BUDGET, ids: bool = False, cache_words: int = tokens.CACHE_WORDS
) -> DataFrame:
    """Cut, stage and pack."""
    return pack(stage(cut(docs, tokenizer, budget, ids, cache_words), "pieces"), budget)
