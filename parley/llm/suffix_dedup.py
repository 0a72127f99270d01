"""Repeated byte strings of a fixed length, by suffix sorting with the difference cover modulo 3.

1. Every window of LENGTH bytes picks its smallest hashed gram of GRAM bytes, the first of equals. Equal windows pick the
   same one, so windows are dealt by it, and a window whose gram stands nowhere else cannot repeat. Neighbouring
   windows with the same pick form a segment; a text has a few segments per hundred bytes.
2. Equal segments get one name and enter the sort once, by their first place; later ones repeat as a whole.
3. Different segments of one gram are dealt together and suffix sorted in blocks: triples at positions not divisible by
   three are sorted and named, the string of names is sorted the same way until all names differ, the remaining suffixes
   are merged in, and neighbours in suffix order are compared over LENGTH bytes. The first place of each group stays.
4. Repeated windows become maximal runs of bytes per document.

Nothing is gathered by key: names are minima with map-side sums, and joins have both sides shuffled right below them.
A gram with more different segments than a block holds is not sorted in one task; its windows are grouped by a 128-bit
digest instead. Segments fetch their bytes, and documents their runs, by joins on the document alike at every size.

Cases: null text is empty; texts below LENGTH bytes lose nothing. Documents ascend by id, null ids first; rows with one id
by the hash of their text, and rows with the same id and text are one document and get the same result. An empty table
gives an empty result. Texts of any length run in slices. Only the id and the text are read of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.memory import tidy
from parley.session import spread, stage, tasks

LENGTH = 100
GRAM = 32
# Bytes that are hashed at a time, and bytes of one suffix sort.
SLICE = 1 << 21
BLOCK = 1 << 19
# Different segments of one gram that are sorted together.
KEY_SEGMENTS = 2_000
# A segment's place: its first window times PLACE plus the number of its windows.
PLACE = 256
FIRST_ID = -(1 << 63)


# Windows ----------------------------------------------------------------------


def _hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each position."""
    n = len(data) - GRAM + 1
    mixed = np.zeros(n, np.uint64)
    for at in range(0, GRAM, 8):
        word = np.ndarray((n,), "<u8", data, at, (1,)).astype(np.uint64)
        mixed ^= word
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done, reach = values, 1
    while reach * 2 <= width:
        done = np.minimum(done[:-reach], done[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(done[: len(done) - rest], done[rest:]) if rest else done


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and gram hash of each segment in some texts laid end to end."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty
    hashes = _hashes(data)
    # High bits decide, the position breaks ties to the left.
    low = np.uint64(24)
    ranked = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    pick = (_sliding_min(ranked, length - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    inside = np.ones(len(pick), bool)
    for end in ends:  # windows that would cross the end of a text
        inside[max(0, end - length + 1) : end] = False
    places = np.flatnonzero(inside)
    if not len(places):
        return empty, empty, empty
    pick = pick[places]
    cut = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (places[1:] != places[:-1] + 1)]))
    counts = np.diff(np.concatenate([cut, [len(places)]]))
    return places[cut], counts, hashes[pick[cut]].view(np.int64)


SEGMENTS = "doc long, tag long, place long, gram long, name long"


def _segments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc, tag, text (binary) to their segments."""

    def emit(doc: list[int], tag: list[int], first: list[int], texts: list[bytes]) -> pa.RecordBatch:
        """first: position of each part in its document."""
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        starts, counts, grams = segments(np.frombuffer(joined, np.uint8), ends)
        who = np.searchsorted(ends, starts, "right")
        offset = np.array(first, np.int64) - np.concatenate([[0], ends[:-1]])
        view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
        stops = starts + counts + (LENGTH - 1)
        names = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts))
        place = (starts + offset[who]) * PLACE + counts if len(starts) else starts
        columns = [np.array(doc, np.int64)[who], np.array(tag, np.int64)[who], place, grams, names.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ("doc", "tag", "place", "gram", "name"))

    held: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for batch in batches:
        for doc, tag, text in zip(*(batch.column(i) for i in range(3))):
            view = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            # Long texts are cut into parts that share LENGTH - 1 bytes: every window lies in exactly one.
            for at in range(0, max(len(view) - LENGTH + 1, 0), SLICE):
                part = bytes(view[at : at + SLICE + LENGTH - 1])
                for column, value in zip(held, (doc.as_py(), tag.as_py(), at, part)):
                    column.append(value)
                size += len(part)
                if size >= SLICE:
                    yield emit(*held)
                    held, size = ([], [], [], []), 0
    if size:
        yield emit(*held)


# Suffix sort ------------------------------------------------------------------


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Rank from 1 of every suffix of an array of positive integers; at most about a million of them."""
    n = len(text)
    if n < 4:
        order = sorted(range(n), key=lambda i: text[i:].tolist())
        ranks = np.empty(n, np.int64)
        ranks[order] = np.arange(1, n + 1)
        return ranks
    s = np.concatenate([text, np.zeros(3, text.dtype)]).astype(np.int64)
    base = np.int64(s.max() + 1)
    # A position n = 1 (mod 3) closes the first half of the names with a triple of zeros.
    ones, twos, zeros = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([ones, twos])
    triples = (s[sample] * base + s[sample + 1]) * base + s[np.minimum(sample + 2, n + 2)]
    known, names = np.unique(triples, return_inverse=True)
    names = names.astype(np.int64) + 1
    if len(known) < len(sample):
        names = suffix_ranks(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    top = np.int64(len(sample) + 2)
    # Remaining suffixes: by symbol and rank of the sampled suffix behind.
    by_one = s[zeros] * top + rank[zeros + 1]
    zeros = zeros[np.argsort(by_one, kind="stable")]
    by_one = s[zeros] * top + rank[zeros + 1]
    by_two = (s[zeros] * base + s[zeros + 1]) * top + rank[zeros + 2]
    one = ones[ones < n]
    one = one[np.argsort(rank[one])]
    two = twos[np.argsort(rank[twos])]
    # Merge: each remaining suffix against the sampled ones of either kind, by keys both kinds have.
    before = np.searchsorted(s[one] * top + rank[one + 1], by_one) + np.searchsorted(
        (s[two] * base + s[two + 1]) * top + rank[two + 2], by_two
    )
    out = np.empty(n, np.int64)
    out[zeros] = np.arange(len(zeros)) + before + 1
    sampled = np.concatenate([one, two])
    sampled = sampled[np.argsort(rank[sampled])]
    out[sampled] = np.arange(len(sampled)) + np.searchsorted(before, np.arange(len(sampled)), "right") + 1
    return out


def first_windows(strings: list[bytes], counts: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For all windows of some strings, one string after the other: is there an equal window of lower order?"""
    lengths = np.array([len(x) + 1 for x in strings])
    data = np.frombuffer(b"\0".join(strings) + bytes(1 + 8), np.uint8)
    begins = np.cumsum(lengths) - lengths
    body = data[: begins[-1] + lengths[-1]].astype(np.int64) + 1
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    ranks = suffix_ranks(body)
    sort = np.argsort(ranks[starts])
    at = starts[sort]
    # Neighbours in suffix order, compared in words of eight bytes.
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    same = np.ones(len(at) - 1, bool)
    for step in sorted({*range(0, length - 7, 8), length - 8}):
        open_ = np.flatnonzero(same)
        same[open_] = words[at[open_] + step] == words[at[open_ + 1] + step]
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    lowest = np.minimum.reduceat(order[sort], heads)
    later = np.empty(len(at), bool)
    later[sort] = order[sort] != np.repeat(lowest, np.diff(np.concatenate([heads, [len(at)]])))
    return later


RUNS = "doc long, tag long, start long, stop long"


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of gram, doc, tag, place, bytes, all rows of a gram together, to the byte runs that repeat."""

    def sort(doc: list[int], tag: list[int], place: list[int], strings: list[bytes]) -> pa.RecordBatch:
        docs, tags, places = (np.array(x, np.int64) for x in (doc, tag, place))
        firsts, counts = places // PLACE, places % PLACE
        begin = np.cumsum(counts) - counts
        start = np.repeat(firsts - begin, counts) + np.arange(counts.sum())
        who = np.repeat(np.arange(len(docs)), counts)
        # Equal places come from rows with the same id and text, and are one place.
        sort = np.lexsort((start, tags[who], docs[who]))
        a, b = sort[:-1], sort[1:]
        fresh = (start[a] != start[b]) | (tags[who[a]] != tags[who[b]]) | (docs[who[a]] != docs[who[b]])
        order = np.empty(len(start), np.int64)
        order[sort] = np.concatenate([[0], np.cumsum(fresh)])
        found = np.flatnonzero(first_windows(strings, counts, order))
        who, start = who[found], start[found]
        cut = np.concatenate([[True], (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)]) if len(found) else np.empty(0, bool)
        head = np.flatnonzero(cut)
        tail = np.concatenate([head[1:], [len(found)]]).astype(np.int64) - 1 if len(found) else head
        columns = [docs[who[head]], tags[who[head]], start[head], start[tail] + LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ("doc", "tag", "start", "stop"))

    held: tuple[list, list, list, list] = ([], [], [], [])
    size, now = 0, None
    for batch in batches:
        gram, doc, tag, place, data = (batch.column(i).to_pylist() for i in range(5))
        for g, *row in zip(gram, doc, tag, place, data):
            if g != now and size >= BLOCK:
                yield sort(*held)
                held, size = ([], [], [], []), 0
            now = g
            for column, value in zip(held, row):
                column.append(value)
            size += len(row[3])
    if size:
        yield sort(*held)


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of gram, doc, tag, place, bytes to the digest of each window."""
    for batch in batches:
        _, doc, tag, place, data = (batch.column(i).to_pylist() for i in range(5))
        rows = []
        for d, t, p, b in zip(doc, tag, place, data):
            for i in range(p % PLACE):
                high, low = divmod(xxhash.xxh3_128_intdigest(b[i : i + LENGTH]), 1 << 64)
                rows.append((d, t, p // PLACE + i, high - (1 << 63), low - (1 << 63)))
        parts = zip(*rows) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], ("doc", "tag", "start", "high", "low"))


# Jobs -------------------------------------------------------------------------


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, tag, body (binary) of every row. The tag is the hash of the text where ids repeat, else 0."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    repeated = rows.groupBy("doc").count().where("count > 1").limit(1).count()
    tag = F.xxhash64("t") if repeated else F.lit(0).cast("long")
    return rows.select("doc", tag.alias("tag"), F.encode("t", "utf-8").alias("body"))


def _first_place() -> Column:
    return F.min(F.struct("doc", "tag", "place"))


def _bytes_of(reps: DataFrame, documents: DataFrame) -> DataFrame:
    """gram, doc, tag, place, bytes, large of some segments. A list is in proportion to the length of its document."""
    own = F.collect_list(F.struct("gram", "place", "large")).alias("own")
    lists = stage(reps.groupBy("doc", "tag").agg(own), "repeat-lists")
    cut = F.transform(
        "own",
        lambda x: F.struct(
            x["gram"].alias("gram"),
            x["place"].alias("place"),
            x["large"].alias("large"),
            F.col("body").substr((F.floor(x["place"] / PLACE) + 1).cast("int"), (x["place"] % PLACE + LENGTH - 1).cast("int")).alias("bytes"),
        ),
    )
    found = documents.join(lists, ["doc", "tag"]).select("doc", "tag", F.explode(cut).alias("s"))
    return found.select("s.gram", "doc", "tag", "s.place", "s.bytes", "s.large")


def repeated_runs(documents: DataFrame) -> DataFrame:
    """doc, tag, start, stop: runs of bytes under repeated windows, not yet merged."""
    parts = spread(documents).mapInArrow(tidy(_segments_of), SEGMENTS)
    # Grams in one place are settled here: no window under them repeats.
    grams = stage(
        parts.groupBy("gram")
        .agg(F.count("*").alias("n"), (F.min("name") != F.max("name")).alias("mixed"))
        .where("n > 1")
        .select("gram", "mixed"),
        "repeat-grams",
    )
    members = stage(parts.join(grams, "gram"), "repeat-members")
    names = stage(members.groupBy("gram", "name", "mixed").agg(_first_place().alias("first")), "repeat-names")
    stop = F.floor(F.col("place") / PLACE) + F.col("place") % PLACE + (LENGTH - 1)
    copies = (
        members.join(names.select("gram", "name", "first"), ["gram", "name"])
        .where(F.struct("doc", "tag", "place") != F.col("first"))
        .select("doc", "tag", F.floor(F.col("place") / PLACE).alias("start"), stop.alias("stop"))
    )
    mixed = names.where("mixed")
    large = stage(
        mixed.groupBy("gram").count().where(F.col("count") > KEY_SEGMENTS).select("gram", F.lit(True).alias("large")),
        "repeat-large",
    )
    reps = mixed.join(large, "gram", "left").select("gram", "first.*", F.coalesce("large", F.lit(False)).alias("large"))
    data = stage(_bytes_of(reps, documents), "repeat-bytes")
    small = data.where("not large").repartition(tasks(documents.sparkSession), "gram").sortWithinPartitions("gram")
    sorted_ = small.mapInArrow(tidy(_sort_blocks), RUNS)
    windows = data.where("large").mapInArrow(_windows_of, "doc long, tag long, start long, high long, low long")
    windows = stage(windows, "repeat-windows")
    first = windows.groupBy("high", "low").agg(F.min(F.struct("doc", "tag", "start")).alias("first"))
    hot = windows.join(stage(first, "repeat-firsts"), ["high", "low"]).where(F.struct("doc", "tag", "start") != F.col("first"))
    hot = hot.select("doc", "tag", "start", (F.col("start") + LENGTH).alias("stop"))
    return copies.unionByName(sorted_).unionByName(hot)


def _merged(runs: DataFrame) -> DataFrame:
    """Maximal runs per document."""
    order = Window.partitionBy("doc", "tag").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("long")
    marked = runs.withColumn("fresh", fresh)
    number = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", number).groupBy("doc", "tag", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop")
    )


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, body, cuts in zip(*(batch.column(i) for i in range(3))):
            view, digest, at, removed = memoryview(body.as_buffer()), hashlib.sha256(), 0, 0
            spans = [(c["start"], c["stop"]) for c in cuts.as_py() or []]
            for start, stop in spans:
                digest.update(view[at:start])
                at, removed = stop, removed + stop - start
            digest.update(view[at:])
            rows.append((doc.as_py(), len(view), removed, len(spans), digest.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 5, kinds)], names)


def removed_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, tag, body) of every row, and (doc, tag, start, stop): the maximal runs of bytes that repeat earlier ones."""
    documents = _documents(docs, doc_id, text)
    return documents, _merged(repeated_runs(documents))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    documents, runs = removed_spans(docs, doc_id, text)
    cuts = F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts")
    spans = stage(runs.groupBy("doc", "tag").agg(cuts), "repeat-spans")
    own = F.when(F.col("doc") != FIRST_ID, F.col("doc")).alias("doc_id")
    return documents.join(spans, ["doc", "tag"], "left").select(own, "body", "cuts").mapInArrow(_kept, DIGESTS)
