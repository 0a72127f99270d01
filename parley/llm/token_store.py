"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of those ids
that need one, and so on. One continuation bit per chunk tells whether a next chunk follows, and a directory holds the
number of set bits before each block of 512 bits. The place of a token's next chunk is the rank of its bit, so any
token is read with one directory look-up per level and no block is decoded.

A store is a table of segments. Each row is one self-contained binary segment over whole documents; segments ascend by
document id. A segment holds the number of ids before it in its range partition, the manifest those before the partition.

Cases: a null text holds the end id only. Null ids come first. Documents with the same id are ordered by the hash of
their text. A document of any length stays in one segment. An empty table gives an empty store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import tokens
from parley.session import stage

MAGIC = b"DAC1"
BLOCK = 512
SEGMENT_TOKENS = 1 << 20
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dac_encode(ids: np.ndarray) -> bytes:
    """Code of an array of ids below 2^32."""
    rest = np.ascontiguousarray(ids, "<u4")
    levels = []
    while True:
        chunk, high = (rest & 255).astype(np.uint8), rest >> 8
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ranks = np.zeros(len(bits) // (BLOCK // 8) + 1, "<u4")
        np.cumsum(_POP[bits].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32), out=ranks[1:])
        levels.append((chunk, bits, ranks))
        if not more.any():
            break
        rest = high[more]
    head = MAGIC + struct.pack("<QB", len(ids), len(levels))
    sizes = b"".join(struct.pack("<QQQ", len(c), len(b), len(r)) for c, b, r in levels)
    return head + sizes + b"".join(c.tobytes() + b.tobytes() + r.tobytes() for c, b, r in levels)


def _levels(data: bytes) -> tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    if data[:4] != MAGIC:
        raise ValueError("not a segment of directly addressable codes")
    n, depth = struct.unpack_from("<QB", data, 4)
    at, levels = 13 + 24 * depth, []
    for k in range(depth):
        c, b, r = struct.unpack_from("<QQQ", data, 13 + 24 * k)
        chunk = np.frombuffer(data, np.uint8, c, at)
        bits = np.frombuffer(data, np.uint8, b, at + c)
        ranks = np.frombuffer(data, "<u4", r, at + c + b)
        levels.append((chunk, bits, ranks))
        at += c + b + 4 * r
    return n, levels


def dac_access(data: bytes, places: np.ndarray) -> np.ndarray:
    """Ids at the given places, each by rank look-ups alone."""
    n, levels = _levels(data)
    at = np.asarray(places, np.int64)
    if len(at) and (at.min() < 0 or at.max() >= n):
        raise IndexError("place outside the segment")
    out, who = np.zeros(len(at), np.uint32), np.arange(len(at))
    for k, (chunk, bits, ranks) in enumerate(levels):
        out[who] |= chunk[at].astype(np.uint32) << np.uint32(8 * k)
        go = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        who, at = who[go], at[go]
        if not len(at):
            break
        block = at // BLOCK
        first = block * (BLOCK // 8)
        # Set bits of the block before the place: its bytes, the last one masked.
        around = bits[first[:, None] + np.arange(BLOCK // 8)]
        inside = at - block * BLOCK
        full = np.arange(BLOCK // 8) < (inside >> 3)[:, None]
        part = bits[at >> 3] & ((1 << (inside & 7)) - 1).astype(np.uint8)
        at = ranks[block].astype(np.int64) + (_POP[around] * full).sum(1, dtype=np.int64) + _POP[part].astype(np.int64)
    return out


def dac_decode(data: bytes) -> np.ndarray:
    """All ids of a code."""
    n, levels = _levels(data)
    values = None
    for chunk, bits, _ in reversed(levels):
        low = chunk.astype(np.uint32)
        if values is not None:
            low[np.unpackbits(bits, count=len(low), bitorder="little").view(bool)] |= values << 8
        values = low
    return values


SEGMENT = "part int, segment int, before long, n_tokens long, doc_ids array<long>, ends array<long>, codes binary"


def _segment_writer(path: str, segment_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokens.word_ids(path).encode
        part, segment = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ends: list[int] = []
        blobs: list[bytes] = []
        total = before = 0

        def flush() -> pa.RecordBatch:
            codes = dac_encode(np.frombuffer(b"".join(blobs), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([total], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([ends], pa.list_(pa.int64())),
                    pa.array([codes], pa.binary()),
                ],
                ["part", "segment", "before", "n_tokens", "doc_ids", "ends", "codes"],
            )

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary())):
                ids = encode(text.as_py())
                total += len(ids) // 4
                doc_ids.append(doc_id)
                ends.append(total)
                blobs.append(ids)
                if total >= segment_tokens:
                    yield flush()
                    segment, before, total = segment + 1, before + total, 0
                    doc_ids, ends, blobs = [], [], []
        if doc_ids:
            yield flush()

    return write


def write_store(docs: DataFrame, tokenizer: str, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Encode all texts in ascending id order and write the segments; the result reads the written table."""
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stage(ordered.mapInArrow(_segment_writer(tokenizer, segment_tokens), SEGMENT), "token-store")


def manifest(store: DataFrame) -> DataFrame:
    """Ids before each range partition; one row per partition, whatever the number of segments."""
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("shift"))


DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(store: DataFrame) -> DataFrame:
    """Position, length and checksum of every document, from the decoded segments."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = memoryview(dac_decode(row["codes"]).astype("<u4").tobytes())
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["first"]),
                        pa.array(ends - starts),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    first = (F.col("shift") + F.col("before")).alias("first")
    placed = store.join(F.broadcast(manifest(store)), "part").select("doc_ids", "ends", "codes", first)
    return placed.mapInArrow(read, DOCUMENT)


def tokens_at(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Token of each wanted (doc_id, place in the document); only the segments asked for are opened.

    A place outside its document, or an unknown document, gives no row.
    """
    index = store.select("part", "segment", F.arrays_zip("doc_ids", "ends").alias("d"), "ends").select(
        "part", "segment", F.posexplode("d").alias("i", "d"), "ends"
    )
    begin = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.col("ends")[F.col("i") - 1])
    index = index.select("part", "segment", F.col("d.doc_ids").alias("doc_id"), begin.alias("b"), F.col("d.ends").alias("e"))
    asked = wanted.select("doc_id", "place").join(index, "doc_id").where("place >= 0 AND place < e - b")
    asked = asked.toDF(*[f"asked_{c}" for c in asked.columns])

    def look(segment, places):
        import pandas as pd

        if not len(segment) or not len(places):
            return pd.DataFrame({"doc_id": [], "place": [], "token": []}).astype("int64")
        found = dac_access(segment["codes"].iloc[0], (places["asked_b"] + places["asked_place"]).to_numpy())
        return pd.DataFrame({"doc_id": places["asked_doc_id"], "place": places["asked_place"], "token": found.astype("int64")})

    return (
        store.select("part", "segment", "codes")
        .groupBy("part", "segment")
        .cogroup(asked.groupBy("asked_part", "asked_segment"))
        .applyInPandas(look, "doc_id long, place long, token long")
    )
