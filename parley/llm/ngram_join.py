"""Self join of documents on the Jaccard similarity of their word shingles, by T-occurrence search.

Two documents with sets of a and b shingles link when 4 * common >= 3 * union, so they share at least three quarters
of the larger set. Only shingles that occur in two different sets can be shared:

1. Sets are hashed to a node; equal sets are one node. Occurrences travel in binary blocks to one of many hash
   buckets, whose number follows from the bytes of all texts. A bucket is one task, which counts the list of every
   shingle part by part; occurrences of lists of length one stop there.
2. A node with fewer shared shingles than three quarters of its set can link with nothing. Of the others, the
   rarest shingles that any partner must hit (the prefix in order of list length) tie nodes into candidate clusters.
3. Inside a cluster the inverted lists are searched for documents with the required number of common shingles T:
   short lists are merged, long lists are probed by binary search (DivideSkip).

Inside a cluster a node that links with an indexed node is attached to it and not indexed itself. With d the Jaccard
distance (a metric) and r the largest distance from an indexed node to those attached to it, nothing attached can link
with a query farther than 1/4 + r, so the search asks for all nodes within that and then tests what is attached. Work
on a group of near copies then grows with its size, not with its square.

Clusters with more than UNIT occurrences are cut into blocks and each pair of blocks is searched as one unit.

Cases: null text, empty text and text without words have an empty set, size 0, and link with nothing. Repeated rows
are equal sets. A null id never names a component unless all its ids are null. An empty table gives an empty result.
Columns besides `doc_id` and `text` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.memory import give_back, tidy
from parley.session import stage, stage_counted

WORDS = 5
NUM, DEN = 3, 4  # a link needs DEN * common >= NUM * union
FLUSH = 300_000
UNIT = 4_000_000
# A bucket gets the occurrences of about so many bytes of text, and so many of them are sorted at once.
BUCKET_BYTES = 24_000_000
PART = 500_000
# Up to so many ids of dropped documents are sent to every task; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    # UTF-8 bytes: lower() changes A-Z alone, split() cuts at space and 09-0D alone.
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(own))
    out = own[: len(own) - width + 1] * _MIX + np.uint64(width)
    for k in range(1, width):
        out = (out ^ own[k : len(own) - width + 1 + k]) * _FOLD
        out ^= out >> np.uint64(32)
    return np.unique(out)


_WIDTHS = (np.uint8, np.uint16, np.uint32)


def _narrow(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    most = int(values.max(initial=0))
    return values.astype(next(w for w in _WIDTHS if most <= np.iinfo(w).max)).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, next(w for w in _WIDTHS if np.dtype(w).itemsize * n == len(data))).astype(np.int32)


_BLOCK = "bucket int, doc_id long, node long, n int, nodes binary, sizes binary, counts binary, hashes binary"


def _blocks(buckets: int, words: int):
    def scatter(sets: dict[int, np.ndarray]) -> Iterator[dict]:
        nodes = np.fromiter(sets, np.int64, len(sets))
        sizes = np.fromiter(map(len, sets.values()), np.int32, len(sets))
        flat = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(nodes)), sizes)
        bucket = (flat % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((owner, bucket))
        flat, owner, bucket = flat[order], owner[order], bucket[order]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in range(buckets):
            a, b = edge[k], edge[k + 1]
            if a < b:
                who, count = np.unique(owner[a:b], return_counts=True)
                yield {
                    "bucket": k,
                    "nodes": nodes[who].tobytes(),
                    "sizes": _narrow(sizes[who]),
                    "counts": _narrow(count),
                    "hashes": flat[a:b].tobytes(),
                }

    schema = pa.schema(
        [("bucket", pa.int32()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32())]
        + [(c, pa.binary()) for c in ("nodes", "sizes", "counts", "hashes")]
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                own = shingles(text.as_py(), words)
                node = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None
                at = (node or 0) % buckets
                rows.append({"bucket": at, "doc_id": doc_id, "node": node, "n": len(own)})
                if node is not None and node not in sets:
                    sets[node] = own
                    held += len(own)
                if held >= FLUSH:
                    yield pa.RecordBatch.from_pylist(list(scatter(sets)), schema)
                    sets, held = {}, 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        if sets:
            yield pa.RecordBatch.from_pylist(list(scatter(sets)), schema)

    return tidy(spread)


_LIST = "doc_id long, node long, n int, shingle long, listed long"


def _count_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of shingles in two or more nodes with the list length, one bucket at a time; documents pass (0)."""
    names = [c.split()[0] for c in _LIST.split(", ")]
    bucket, held = None, []

    def pick(block: list, parts: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node, size and hash of the occurrences of one part of the hashes."""
        mark, n = np.frombuffer(block[3], np.uint64), len(block[0]) // 8
        at = np.flatnonzero((mark >> np.uint64(32)) % np.uint64(parts) == np.uint64(part))
        who = np.repeat(np.arange(n, dtype=np.int32), _wide(block[2], n))[at]
        return np.frombuffer(block[0], np.int64)[who], _wide(block[1], n)[who], mark[at].view(np.int64)

    def close() -> Iterator[pa.RecordBatch]:
        # A bucket is widened and sorted by parts, so only its blocks as they were sent are held whole.
        parts = -(-sum(len(r[3]) // 8 for r in held) // PART)
        for part in range(parts):
            node, size, mark = (np.concatenate(c) for c in zip(*(pick(r, parts, part) for r in held)))
            order = np.lexsort((node, mark))
            node, size, mark = node[order], size[order], mark[order]
            first = np.ones(len(mark), bool)
            first[1:] = (mark[1:] != mark[:-1]) | (node[1:] != node[:-1])
            node, size, mark = node[first], size[first], mark[first]
            if not len(mark):
                continue
            length = np.diff(np.r_[np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]]), len(mark)])
            listed = np.repeat(length, length)
            keep = listed > 1
            none = pa.nulls(int(keep.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, pa.array(node[keep]), pa.array(size[keep]), pa.array(mark[keep]), pa.array(listed[keep])], names
            )

    for batch in batches:
        docs = batch.filter(batch["hashes"].is_null())
        if len(docs):
            rest = [pa.nulls(len(docs), pa.int64()), pa.array(np.zeros(len(docs), np.int64))]
            yield pa.RecordBatch.from_arrays([docs["doc_id"], docs["node"], docs["n"], *rest], names)
        columns = [batch[c] for c in ("nodes", "sizes", "counts", "hashes")]
        places = batch["bucket"].to_pylist()
        for i in np.flatnonzero(columns[3].is_valid().to_numpy(zero_copy_only=False)).tolist():
            if places[i] != bucket and held:
                yield from close()
                held = []
            bucket = places[i]
            held.append([c[i].as_buffer() for c in columns])  # views of the batch, no copies
    if held:
        yield from close()


def _gather(post: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Lists post[start : start + length], one after another."""
    total = int(length.sum())
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return post[np.arange(total) + shift]


def t_occurrence(post: np.ndarray, start: np.ndarray, length: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that occur in at least t of the given sorted lists, with their counts (DivideSkip)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(length) < t or not len(length):
        return none
    order = np.argsort(length, kind="stable")
    start, length = start[order], length[order]
    # Long lists to leave out of the merge: at most t - 1, fewer when they are not much longer than a probe costs.
    n_long = min(t - 1, int(t / (0.05 * np.log2(length[-1] + 1) + 1)))
    cut = len(length) - n_long
    found, count = np.unique(_gather(post, start[:cut], length[:cut]), return_counts=True)
    able = count >= t - n_long
    found, count = found[able], count[able]
    for i, (s, n) in enumerate(zip(start[cut:], length[cut:])):
        if not len(found):
            return none
        own = post[s : s + n]
        at = np.minimum(np.searchsorted(own, found), n - 1)
        count = count + (own[at] == found)
        able = count + (n_long - 1 - i) >= t
        found, count = found[able], count[able]
    return found, count


def link_sets(sizes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Component of each set by links at NUM/DEN, as the index of one member. sets: the elements that can be shared."""
    n_sets = len(sets)
    parent = np.arange(n_sets)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    marks = np.concatenate(sets)
    marks.sort()
    marks = np.unique(marks)
    terms = [np.searchsorted(marks, np.sort(s)).astype(np.int32) for s in sets]
    n_marks = len(marks)
    del marks, sets
    room = np.zeros(n_marks, np.int64)
    for own in terms:
        room[own] += 1
    begin = np.concatenate([[0], np.cumsum(room)[:-1]])
    post, fill = np.zeros(int(room.sum()), np.int32), np.zeros(n_marks, np.int64)
    attached: dict[int, list[int]] = {}
    radius = np.zeros(n_sets)
    centers: list[int] = []
    most = 0.0
    for i in np.argsort(sizes, kind="stable"):
        own, n = terms[i], int(sizes[i])
        reach = 1 - NUM / DEN
        t = max(1, int(np.ceil((1 - reach - most) * n - 1e-6)))
        used = own[fill[own] > 0]
        found, common = t_occurrence(post, begin[used], fill[used], t)
        at = np.array(centers, np.int64)[found] if len(found) else found
        union = sizes[at] + n - common
        distance = 1 - common / np.maximum(union, 1)
        linked = DEN * common >= NUM * union
        for c in at[linked]:
            parent[find(c)] = find(i)
        for c in at[~linked & (distance <= reach + radius[at] + 1e-9)]:
            for m in attached.get(int(c), ()):
                if find(m) != find(i):
                    both = len(np.intersect1d(terms[m], own, assume_unique=True))
                    if DEN * both >= NUM * (int(sizes[m]) + n - both):
                        parent[find(m)] = find(i)
        if linked.any():
            best = np.flatnonzero(linked)[np.argmin(distance[linked])]
            c = int(at[best])
            attached.setdefault(c, []).append(int(i))
            radius[c] = max(radius[c], distance[best])
            most = max(most, float(distance[best]))
        else:
            post[begin[own] + fill[own]] = len(centers)
            fill[own] += 1
            centers.append(int(i))
    return np.array([find(i) for i in range(n_sets)], np.int64)


def _link_unit(pdf):
    import pandas as pd

    pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
    node = pdf["node"].to_numpy(np.int64)
    found = link_sets(pdf["n"].to_numpy(np.int64), [np.asarray(s, np.int64) for s in pdf["marks"]])
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, found, node)
    if sum(map(len, pdf["marks"])) * 4 > UNIT:
        give_back()
    return pd.DataFrame({"node": node, "root": least[found]})


def join(docs: DataFrame, words: int = WORDS, unit: int = UNIT) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set), root (node of the component) and component_id of every row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8, -(-size // BUCKET_BYTES))
    blocks = docs.select("doc_id", "text").mapInArrow(_blocks(buckets, words), _BLOCK)
    # One bucket a task; documents without words carry a bucket too.
    sent = blocks.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    lists = stage(sent.mapInArrow(tidy(_count_lists), _LIST), "shingle-lists")
    rows = lists.where("listed = 0").select("doc_id", "node", "n")

    # Nodes with enough shared shingles, and the prefix of each: all its unshared shingles come before.
    whole = Window.partitionBy("node")
    live = (
        lists.where("listed > 1")
        .select("node", "n", "shingle", "listed")
        .withColumn("shared", F.count("*").over(whole))
        .where(F.col("shared") * DEN >= F.col("n") * NUM)
        .withColumn("place", F.col("n") - F.col("shared") + F.row_number().over(whole.orderBy("listed", "shingle")))
    )
    needed = F.ceil(F.col("n") * NUM / DEN)
    live, n_live = stage_counted(
        live.select("node", "n", "shingle", (F.col("place") <= F.col("n") - needed + 1).alias("prefix")), "live", F.count("*")
    )
    roots = None
    if n_live:
        # Partners differ in size by a factor of 4/3 at most, so they are in the same or in adjacent bands.
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.34))).cast("int")
        heads = live.where("prefix").select("node", "shingle", band.alias("band"))
        hubs = stage(heads.groupBy("shingle", "band").agg(F.min("node").alias("hub"), F.count("*").alias("k")), "hubs")
        to_hub = heads.join(hubs, ["shingle", "band"]).where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        steps = Window.partitionBy("shingle").orderBy("band")
        next_hub = hubs.withColumns({"_hub": F.lag("hub").over(steps), "_band": F.lag("band").over(steps)})
        across = next_hub.where("_band = band - 1 AND _hub != hub").select(F.col("hub").alias("a"), F.col("_hub").alias("b"))
        clusters = stage(components(to_hub.union(across).distinct()), "clusters")

        nodes = live.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("shingle").alias("marks"))
        nodes = stage(nodes.join(clusters, "node"), "cluster-nodes")
        sums = nodes.groupBy("root").agg(F.sum(F.size("marks")).alias("_s"))
        parts = F.ceil(F.col("_s") / unit).cast("int").alias("parts")
        sums, n_split = stage_counted(sums.select("root", parts), "units", F.count_if(F.col("parts") > 1))
        # A node of a cluster in p blocks goes to the p units that hold its block.
        own = F.pmod(F.xxhash64("node"), F.col("parts"))
        placed = nodes.join(sums, "root").withColumn("_own", own)
        placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        linked = (
            placed.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
            .groupBy("root", "_i", "_j")
            .applyInPandas(_link_unit, "node long, root long")
        )
        if n_split:
            linked = components(stage(linked.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")), "links"))
        roots = stage(linked, "roots")

    sets = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("_least"))
    if roots is None:
        named = sets.select("node", F.col("node").alias("root"), F.col("_least").alias("component_id"))
    else:
        sets = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = sets.groupBy("root").agg(F.min("_least").alias("component_id"))
        named = sets.join(least, "root").select("node", "root", "component_id")
    named = stage(named, "components")
    return rows.join(named, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "node", "root", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with one document of each group, the one with the smallest id; all columns kept.

    Rows are told apart by the hash of id and text, so rows that share an id are kept or dropped each on its own, and
    rows with the same id and text stay or go together. Null ids come last. Texts without a word stay.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    found = join(docs.select(key.alias("doc_id"), "text"), words).where("root IS NOT NULL").select(F.col("doc_id").alias("key"), "root")
    named = found.distinct().join(docs.select(key.alias("key"), F.col("doc_id").alias("id")).distinct(), "key")
    named = stage(named, "near-rows")
    # Staged, so that the join shuffles both sides directly and a very large group can be split.
    first = stage(named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")), "near-firsts")
    gone = named.join(first, "root").where("key != first.key").select(F.col("key").alias("gone")).distinct()
    gone, n = stage_counted(gone, "near-copies", F.count("*"))
    return docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, key == F.col("gone"), "left_anti")
