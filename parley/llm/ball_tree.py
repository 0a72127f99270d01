"""Exact ranked search with sparse ball trees: the best documents by inner product with a query.

A document is the vector of its term weights. A task cuts its documents into blocks of bounded size and builds one
tree per block: a node keeps a centroid, the largest distance of its documents from it (radius), and their largest excess
over it on each axis. A query visits nodes by descending bound and stops where none reaches its k-th best score. The bound
is the centroid product plus the smaller of two: length of the query times radius, or query times excesses. Only axes on
which the centroid is not zero count for either, since weights are not negative and no document below has others. Bounds are rounded up, so a subtree is only left out if no document of it can enter the result. Leaves
are scored in 64-bit integers. The running best of a task prune its later blocks; the best of all tasks are merged.

Only terms of the queries matter to a product, so vectors hold those alone. Queries are taken in blocks of bounded size,
each against all documents; counts of documents, terms and document frequencies cover all documents.

Cases: null and empty texts have no term, are found by no query and count nowhere; a query without terms finds nothing.
Rows with the same id are separate documents and are ranked separately; each query row is a query of its own.
Equal scores ascend by id, null ids first. Texts of any length are counted in slices. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.topn import first_per_group
from parley.session import spread, stage

# The terms of the contract in UTF-8: every byte of a character beyond ASCII is at least 0x80.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
LOWER = bytes(range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))
SLICE = 1 << 20
# Postings of one tree, documents of one leaf.
BLOCK_POSTINGS = 1_000_000
LEAF_DOCS = 24
# Queries, and their distinct terms together, that are searched at a time.
BLOCK_QUERIES = 2_000
BLOCK_TERMS = 200_000
FRACTION = 1_000_000_000
SAFE = 1 + 1e-9


def slices(data: bytes) -> Iterator[bytes]:
    """Lower-case parts of a text, cut where no term is cut."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            found = BREAK.search(data, end)
            end = found.end() if found else len(data)
        yield data[at:end].translate(LOWER)
        at = end


def term_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for part in slices((text or "").encode()):
        counts.update(TERM.findall(part))
    return counts


# Trees ------------------------------------------------------------------------


@dataclass
class Tree:
    """Rows in the order of the leaves, and nodes with sparse centroids."""

    ids: np.ndarray
    starts: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    centres: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    radius: list[float]
    span: list[tuple[int, int]]
    children: list[tuple[int, int] | None]


def _take(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the postings of some rows, and where each of these rows begins among them."""
    lengths = starts[rows + 1] - starts[rows]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return np.arange(begins[-1]) + np.repeat(starts[rows] - begins[:-1], lengths), begins


def build_tree(ids: np.ndarray, starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, n_terms: int) -> Tree:
    """Tree over rows with at least one posting each; vals are non-negative integers."""
    weights = vals.astype(np.float64)
    norms = np.add.reduceat(weights * weights, starts[:-1])
    order: list[np.ndarray] = []
    tree = Tree(ids, starts, cols, vals, [], [], [], [])
    done = 0
    stack: list[tuple[np.ndarray, int, int]] = [(np.arange(len(ids)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        at, begins = _take(starts, rows)
        c, v = cols[at], weights[at]

        def distances(point: np.ndarray) -> np.ndarray:
            """Squared distances of the rows, never below the true ones."""
            length = point @ point
            exact = norms[rows] - 2 * np.add.reduceat(v * point[c], begins[:-1]) + length
            return np.maximum(exact, 0) + 1e-9 * (norms[rows] + length)

        centre = np.bincount(c, v, n_terms) / len(rows)
        apart = distances(centre)
        node = len(tree.radius)
        used = np.flatnonzero(centre)
        most = np.zeros(n_terms)
        np.maximum.at(most, c, v)
        tree.centres.append((used, centre[used], most[used] - centre[used]))
        tree.radius.append(float(np.sqrt(apart.max())) * SAFE)
        tree.span.append((0, 0))
        tree.children.append(None)
        if parent >= 0:
            pair = tree.children[parent] or (-1, -1)
            tree.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
        if len(rows) <= LEAF_DOCS:
            order.append(rows)
            tree.span[node] = (done, done + len(rows))
            done += len(rows)
            continue

        def row(i: int) -> np.ndarray:
            return np.bincount(c[begins[i] : begins[i + 1]], v[begins[i] : begins[i + 1]], n_terms)

        # Two far rows; the halves nearer to one or the other.
        one = distances(row(int(apart.argmax())))
        two = distances(row(int(one.argmax())))
        split = np.argsort(one - two, kind="stable")
        half = len(rows) // 2
        stack += [(rows[split[half:]], node, 1), (rows[split[:half]], node, 0)]
    final = np.concatenate(order)
    at, tree.starts = _take(starts, final)
    tree.ids, tree.cols, tree.vals = ids[final], cols[at], vals[at]
    return tree


@dataclass
class Best:
    """The k best documents so far, by score and then by id."""

    k: int
    scores: np.ndarray
    ids: np.ndarray

    @staticmethod
    def none(k: int) -> Best:
        return Best(k, np.empty(0, np.int64), np.empty(0, np.int64))

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor()
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


def search_tree(tree: Tree, terms: np.ndarray, counts: np.ndarray, best: Best, dense: np.ndarray) -> int:
    """Put the tree's documents into the best of a query; returns the number of leaves scored.

    `dense` is an array of zeros, one per term, and is left so.
    """
    dense[terms] = counts

    def bound(node: int) -> int:
        used, values, excess = tree.centres[node]
        asked = dense[used].astype(np.float64)
        beyond = min(float(np.sqrt(asked @ asked)) * tree.radius[node], float(asked @ excess))
        return int((float(asked @ values) + beyond) * SAFE) + 1

    scored = 0
    heap = [(-bound(0), 0)]
    while heap:
        upper, node = heapq.heappop(heap)
        if -upper < best.floor():
            break
        pair = tree.children[node]
        if pair is not None:
            for child in pair:
                upper = bound(child)
                if upper >= best.floor():
                    heapq.heappush(heap, (-upper, child))
            continue
        scored += 1
        lo, hi = tree.span[node]
        first, last = tree.starts[lo], tree.starts[hi]
        products = dense[tree.cols[first:last]] * tree.vals[first:last]
        best.add(np.add.reduceat(products, tree.starts[lo:hi] - first), tree.ids[lo:hi])
    dense[terms] = 0
    return scored


# Jobs -------------------------------------------------------------------------


@dataclass
class Queries:
    """A block of queries: numbers of their terms and how often each asks for them."""

    item_ids: list
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    vocabulary: dict[bytes, int]


def query_blocks(queries: DataFrame, item_id: str, text: str) -> Iterator[Queries]:
    """The queries in blocks of bounded size; only one block is held at a time."""

    def fresh() -> Queries:
        return Queries([], [], [], {})

    block = fresh()
    for row in queries.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        bag = term_counts(row["t"])
        if not bag:
            continue
        numbers = [block.vocabulary.setdefault(t, len(block.vocabulary)) for t in bag]
        block.item_ids.append(row["i"])
        block.terms.append(np.array(numbers, np.int64))
        block.counts.append(np.array(list(bag.values()), np.int64))
        if len(block.item_ids) >= BLOCK_QUERIES or len(block.vocabulary) >= BLOCK_TERMS:
            yield block
            block = fresh()
    if block.item_ids:
        yield block


VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"


def _vectors(docs: DataFrame, doc_id: str, text: str, vocabulary: Broadcast) -> DataFrame:
    """Length of every document with a term, and its counts of the terms of the queries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                bag = term_counts(batch.column(1)[i].as_py())
                if bag:
                    own = [(known[t], c) for t, c in bag.items() if t in known]
                    rows.append((batch.column(0)[i].as_py(), sum(bag.values()), [t for t, _ in own], [c for _, c in own]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            names = ("doc_id", "n", "terms", "counts")
            parts = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds)], names)

    return spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(count, VECTORS)


NULL_ID = np.iinfo(np.int64).min
FOUND = "query int, doc_id long, score long"


def _best_of_tasks(vectors: DataFrame, packed: Broadcast, k: int) -> DataFrame:
    """The best k documents of every query in each task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, weights = packed.value
        best = [Best.none(k) for _ in terms]
        dense = np.zeros(len(weights), np.int64)

        def answer(block: pa.Table) -> None:
            block = block.combine_chunks()
            lists = block.column("terms").combine_chunks()
            starts = lists.offsets.to_numpy().astype(np.int64)
            cols = lists.flatten().to_numpy().astype(np.int64)
            starts = starts - starts[0]
            tf = block.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            m = np.repeat(block.column("m").to_numpy(), np.diff(starts))
            vals = weights[cols] * ((FRACTION * tf) // (1000 * tf + 12 * m))
            ids = block.column("doc_id").fill_null(int(NULL_ID)).to_numpy()
            tree = build_tree(ids, starts, cols, vals, len(weights))
            for t, c, b in zip(terms, counts, best):
                search_tree(tree, t, c, b, dense)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            # A batch may hold more postings than a tree: rows are cut by their running number of postings.
            lists = batch.column(batch.schema.get_field_index("terms"))
            ends = np.cumsum(np.diff(lists.offsets.to_numpy().astype(np.int64)))
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK_POSTINGS - size, "right")))
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1] - base)
                at = stop
                if size >= BLOCK_POSTINGS or at < batch.num_rows:
                    answer(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            answer(pa.Table.from_batches(held))
        for q, b in enumerate(best):
            if len(b.ids):
                found = pa.array(b.ids, mask=b.ids == NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.ids), q, np.int32)), found, pa.array(b.scores)], ("query", "doc_id", "score")
                )

    return vectors.mapInArrow(search, FOUND)


def _search_block(docs: DataFrame, block: Queries, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    vectors = stage(_vectors(docs, doc_id, text, context.broadcast(block.vocabulary)), "ball-vectors")
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    # One number per term of the block.
    weights = np.zeros(len(block.vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weights[row["term"]] = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * row["count"] + 1))))
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {n_terms}L").alias("m")
    scored = spread(vectors.where(F.size("terms") > 0).select("doc_id", m, "terms", "counts"))
    found = _best_of_tasks(scored, context.broadcast((block.terms, block.counts, weights)), k)
    ranked = first_per_group(found, ["query"], [F.desc("score"), F.asc_nulls_first("doc_id")], k)
    items = spark.createDataFrame(list(enumerate(block.item_ids)), "query int, item_id long")
    return stage(ranked.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score"), "ball-hits")


HITS = "item_id long, rank int, doc_id long, score long"


def search(
    queries: DataFrame, docs: DataFrame, k: int = 20, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every query with a score above 0."""
    out = docs.sparkSession.createDataFrame([], HITS)
    for block in query_blocks(queries, item_id, text):
        out = out.unionByName(_search_block(docs, block, k, doc_id, text))
    return out
