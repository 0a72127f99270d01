"""TF-IDF index and search as term joins.

Documents carry a unique position `doc_ord`; equal scores keep that order. Queries carry `qid`, `text` and
an optional `category`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions import text as tx
from parley.functions.rates import rounded
from parley.operators import containment
from parley.operators.topn import first_per_group
from parley.session import drop_staged, spread, stage, stage_counted, tasks

# Largest table, in rows, that is sent to every executor: up to 100 bytes a row as a join table, 20 as arrays.
BROADCAST_ROWS = 1_000_000
# Scores that a task holds at a time: queries x documents.
BLOCK_CELLS = 2_000_000
# Postings of a block of documents, and query terms of a block of queries, that meet in one task.
BLOCK_POSTINGS = 1_000_000
BLOCK_TERMS = 200_000
# An index of more documents than this is cut into at least a block for every task.
HOT_TERM_DOCS = 50_000
# Scores closer than this are ties, so that summation order cannot change a ranking.
SCORE_DIGITS = 12


@dataclass
class TermIndex:
    """docs (doc_ord, doc_id, title, category, content, ...), postings (term, doc_ord, doc_category, weight),
    vocab (term, term_id, idf, df)."""

    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    n_docs: int
    n_postings: int
    arrays: Broadcast | None = field(default=None, repr=False)


def term_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Occurrences of each one- and two-word term per row. No shuffle if df is partitioned by the first key."""
    words = df.select(*keys, tx.index_words(F.col(text)).alias("words"))
    terms = words.select(*keys, F.explode(tx.unigrams_and_bigrams(F.col("words"))).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def index_text() -> Column:
    category = F.when(F.coalesce("category", F.lit("")) == "", F.lit("general")).otherwise(F.col("category"))
    return F.concat(
        F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")), F.lit(" category_"), category
    )


def _weight(tf: str, idf: str) -> Column:
    return (1 + F.log(F.col(tf))) * F.col(idf)


def tfidf_index(docs: DataFrame, max_terms: int = fx.MAX_TERMS) -> TermIndex:
    """Weights of the most frequent terms, with unit length per document.

    Terms are counted over the whole corpus first, summed before the shuffle; then only occurrences of the vocabulary
    leave the task that reads a document, as numbers. The vocabulary has at most `max_terms` rows and is broadcast.
    """
    body = spread(docs.select("doc_ord", F.col("category").alias("doc_category"), index_text().alias("body")))
    words = body.select("doc_ord", "doc_category", tx.index_words(F.col("body")).alias("words"))
    # A word and the one after it (null at the end): one row for two terms. Words hold no blank.
    after = F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(0)))
    pairs = words.select("doc_ord", "doc_category", F.inline(F.arrays_zip("words", after.alias("next"))).alias("a", "b"))
    both = F.concat("a", F.lit(" "), "b")
    seen = stage(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "word-pairs")
    singles = seen.groupBy(F.col("a").alias("term")).agg(F.sum("n").alias("total"))
    doubles = seen.where("b is not null").select(both.alias("term"), F.col("n").alias("total"))
    chosen = vocabulary(singles.unionByName(doubles), max_terms)
    drop_staged(seen)
    terms = pairs.select("doc_ord", "doc_category", F.explode(F.array("a", both)).alias("term"))
    counts = stage(
        terms.join(F.broadcast(chosen), "term")
        .groupBy("doc_ord", "doc_category", "term_id")
        .agg(F.count("*").alias("tf")),
        "term-counts",
    )
    return weighted_index(docs, counts, chosen, docs.count())


def vocabulary(totals: DataFrame, max_terms: int) -> DataFrame:
    """(term, term_id) of the terms with the largest totals; at most max_terms rows."""
    if max_terms > BROADCAST_ROWS:
        raise ValueError(f"a vocabulary of more than {BROADCAST_ROWS} terms cannot be sent to every task")
    # Only terms with the total of the last one chosen, or a larger one, are ranked; totals have few different values.
    upto = Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)
    values = totals.groupBy("total").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    least = values.where(F.col("before") < max_terms).agg(F.min("total").alias("least"))
    ranked = totals.join(F.broadcast(least), F.col("total") >= F.col("least")).drop("least").withColumn("_all", F.lit(0))
    chosen = first_per_group(ranked, ["_all"], [F.desc("total"), F.col("term")], max_terms, spread=F.col("term"))
    return stage(chosen.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("term_id")), "terms")


def weighted_index(docs: DataFrame, counts: DataFrame, chosen: DataFrame, n_docs: int) -> TermIndex:
    """Index from staged counts (doc_ord, doc_category, term_id, tf), which are dropped."""
    vocab = stage(
        counts.groupBy("term_id")
        .agg(F.count("*").alias("df"))
        .join(F.broadcast(chosen), "term_id")
        .select("term", "term_id", "df", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")),
        "vocab",
    )
    weights = counts.join(F.broadcast(vocab), "term_id").select(
        "term", "doc_ord", "doc_category", _weight("tf", "idf").alias("w")
    )
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_ord")))
    postings, n_postings = stage_counted(
        weights.select("term", "doc_ord", "doc_category", (F.col("w") / length).alias("weight")), "postings", F.count("*")
    )
    drop_staged(counts)
    return TermIndex(docs, postings, vocab, n_docs, n_postings)


def query_terms(queries: DataFrame, index: TermIndex) -> DataFrame:
    """Unit-length weights of the query terms that are in the vocabulary, partitioned by query.

    The number of partitions is fixed, because questions are small and scoring them is not: adaptive execution would
    merge them into few tasks by their size.
    """
    counts = term_counts(
        queries.select("qid", F.col("category").alias("q_category"), "text").repartition(tasks(queries.sparkSession), "qid"),
        ["qid", "q_category"],
        "text",
    )
    weights = counts.join(F.broadcast(index.vocab), "term").select(
        "qid", "q_category", "term", "term_id", "df", _weight("tf", "idf").alias("w")
    )
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qid")))
    return weights.withColumn("q_weight", F.col("w") / length).drop("w")


def _arrays(index: TermIndex) -> Broadcast:
    """The postings as arrays by term, for an index within the broadcast bound."""
    if index.arrays is None:
        rows = (
            index.postings.join(F.broadcast(index.vocab.select("term", "term_id")), "term")
            .select("term_id", "doc_ord", "doc_category", "weight")
            .toPandas()
            .sort_values(["term_id", "doc_ord"])
        )
        docs = rows[["doc_ord", "doc_category"]].drop_duplicates("doc_ord").sort_values("doc_ord")
        place = np.searchsorted(docs["doc_ord"].to_numpy(), rows["doc_ord"].to_numpy())
        starts = np.searchsorted(rows["term_id"].to_numpy(), np.arange(index.vocab.count() + 1))
        index.arrays = index.postings.sparkSession.sparkContext.broadcast(
            (
                docs["doc_ord"].to_numpy(),
                docs["doc_category"].to_numpy(dtype=object),
                starts,
                place,
                rows["weight"].to_numpy(),
            )
        )
    return index.arrays


def _per_query(terms: DataFrame) -> DataFrame:
    """(qid, q_category, ids, weights), one row per query, terms in order."""
    per_query = terms.groupBy("qid", "q_category").agg(
        F.array_sort(F.collect_list(F.struct("term_id", "q_weight"))).alias("t")
    )
    return per_query.select("qid", "q_category", F.col("t.term_id").alias("ids"), F.col("t.q_weight").alias("weights"))


def _different(queries: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Queries (q_category, ids, weights) that differ, and (query, at): which of them each row equals."""
    keys = zip(queries["q_category"].fillna(""), queries["ids"].map(bytes), queries["weights"].map(bytes))
    which, _ = pd.factorize(pd.Series(list(keys), dtype=object))
    first = np.flatnonzero(~pd.Series(which).duplicated().to_numpy())
    return queries.iloc[first].reset_index(drop=True), pd.DataFrame({"query": which, "at": np.arange(len(which))})


def _named(found: pd.DataFrame, qids: pd.Series, place: str) -> pd.DataFrame:
    """Add the qid at a place. The column holds objects, because an empty string column cannot be sent back."""
    return found.assign(qid=pd.Series(qids.to_numpy(dtype=object)[found[place]], index=found.index, dtype=object))


def _best_of_block(queries: pd.DataFrame, block: tuple, top_k: int, threshold: float) -> Iterator[pd.DataFrame]:
    """(query, doc_ord, raw, rank): best documents of a block for every query, by its place in `queries`."""
    docs, categories, starts, place, weight = block
    n_docs, scale = len(docs), 10.0**SCORE_DIGITS
    step = max(1, BLOCK_CELLS // max(n_docs, 1))
    for begin in range(0, len(queries) if n_docs else 0, step):
        rows = queries.iloc[begin : begin + step]
        n_terms = rows["ids"].map(len).to_numpy()
        ids, q_weights = (np.concatenate(rows[c].to_list()) for c in ("ids", "weights"))
        length = starts[ids + 1] - starts[ids]
        at = np.arange(length.sum()) + np.repeat(starts[ids] - np.cumsum(length) + length, length)
        query = np.repeat(np.repeat(np.arange(len(rows)), n_terms), length)
        gained = np.repeat(q_weights, length) * weight[at]
        scores = np.bincount(query * n_docs + place[at], gained, len(rows) * n_docs).reshape(len(rows), n_docs)
        asked = rows["q_category"].fillna("").to_numpy()
        same = np.where(categories == asked[:, None], fx.SAME_CATEGORY_BOOST, fx.OTHER_CATEGORY_FACTOR)
        scores = np.where((asked == "")[:, None], scores, scores * same)
        scores = np.floor(scores * scale + 0.5) / scale  # as functions.rates.rounded does
        floor = np.full(len(rows), threshold)
        if n_docs > top_k:
            floor = np.maximum(floor, np.partition(scores, n_docs - top_k, 1)[:, n_docs - top_k])
        q, d = np.nonzero(scores >= floor[:, None])
        order = np.lexsort((d, -scores[q, d], q))
        q, d = q[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, d, rank = (x[rank < top_k] for x in (q, d, rank))
        yield pd.DataFrame({"query": begin + q, "doc_ord": docs[d], "raw": scores[q, d], "rank": rank + 1})


def _search_small_index(terms: DataFrame, index: TermIndex, top_k: int, threshold: float) -> DataFrame:
    """Every query scored against the whole index inside its own task; nothing is shuffled.

    A term join would emit a row per query and matching document here, thousands per query, only to sum them up.
    """
    packed = _arrays(index)
    per_query = _per_query(terms)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked, which = _different(batch)
            for found in _best_of_block(asked, packed.value, top_k, threshold):
                found = found.merge(which, on="query")
                yield _named(found, batch["qid"], "at")[["qid", "doc_ord", "raw", "rank"]]

    return per_query.mapInPandas(score, "qid string, doc_ord long, raw double, rank int")


def _search_by_blocks(terms: DataFrame, index: TermIndex, top_k: int, threshold: float, hot_term_docs: int) -> DataFrame:
    """Blocks of documents meet blocks of queries, one pair in a task at a time, for an index and queries of any size.

    Only postings of terms that are asked for are shuffled. A term join would form a row for each of them and each query
    that asks for it, a thousand times what the best documents of a block are. A hot term is in many blocks.
    """
    terms, n_terms = stage_counted(terms, "query-terms", F.count("*"))
    n_blocks = max(1, -(-n_terms // BLOCK_TERMS))
    n_shards = max(-(-index.n_postings // BLOCK_POSTINGS), tasks(terms.sparkSession) if index.n_docs > hot_term_docs else 1)
    key = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = _per_query(terms).select("*", key("qid", n_blocks).alias("block"), every(n_shards).alias("shard"))
    wanted = terms.select(F.col("term").alias("term"), F.col("term_id").alias("term_id")).distinct()
    rows = (
        index.postings.join(F.broadcast(wanted), "term")
        .select("doc_ord", "doc_category", "term_id", "weight", key("doc_ord", n_shards).alias("shard"))
        .withColumn("block", every(n_blocks))
    )

    def best(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or asked.empty:
            return pd.DataFrame({"qid": [], "doc_ord": [], "raw": []}, dtype=object)
        docs["place"] = docs.groupby(["doc_ord", "doc_category"], dropna=False).ngroup()
        heads = docs.drop_duplicates("place").sort_values("place")
        docs = docs.sort_values(["term_id", "place"])
        last = max(ids[-1] for ids in asked["ids"])
        starts = np.searchsorted(docs["term_id"].to_numpy(), np.arange(last + 2))
        block = (
            heads["doc_ord"].to_numpy(),
            heads["doc_category"].to_numpy(dtype=object),
            starts,
            docs["place"].to_numpy(),
            docs["weight"].to_numpy(),
        )
        found = pd.concat(_best_of_block(asked, block, top_k, threshold))
        return _named(found, asked["qid"], "query")[["qid", "doc_ord", "raw"]]

    pair = ["shard", "block"]
    found = rows.groupBy(*pair).cogroup(asked.groupBy(*pair)).applyInPandas(best, "qid string, doc_ord long, raw double")
    return first_per_group(found, ["qid"], [F.desc("raw"), F.col("doc_ord")], top_k, spread=F.col("doc_ord"))


def tfidf_search(
    queries: DataFrame,
    index: TermIndex,
    top_k: int = fx.TOP_K,
    threshold: float = fx.MIN_SCORE,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_term_docs: int = HOT_TERM_DOCS,
) -> DataFrame:
    """Best documents per query: (qid, doc_ord, score, rank).

    A query category raises documents of that category and lowers all others; nothing is filtered by it.
    Only documents that share a term can reach a threshold above zero. The way of scoring follows from measured sizes.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above zero")
    terms = query_terms(queries, index)
    if index.n_postings <= broadcast_rows:
        best = _search_small_index(terms, index, top_k, threshold)
    else:
        best = _search_by_blocks(terms, index, top_k, threshold, hot_term_docs)
    return best.select("qid", "doc_ord", rounded(F.least("raw", F.lit(1.0)), 4).alias("score"), "rank")


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the document columns to search hits."""
    return hits.join(docs, "doc_ord")


def overlap_search(
    queries: DataFrame,
    docs: DataFrame,
    top_k: int = fx.TOP_K,
    threshold: float = 0.0,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_word_docs: int = containment.HOT_WORD_DOCS,
) -> DataFrame:
    """Best documents by the share of query words they contain; a query category filters strictly.

    With threshold 0 documents without any common word qualify too. They rank last in document order, so the
    first 2k documents of the category are enough to fill a query that has fewer than k matches.
    """
    words = tx.space_words(F.col("text"))
    q = queries.select("qid", F.coalesce("category", F.lit("")).alias("q_category"), words.alias("words"))
    q = q.withColumn("n_words", F.greatest(F.size("words"), F.lit(1)))
    bags = docs.select("doc_ord", F.col("category").alias("doc_category"), tx.space_words(F.col("content")).alias("d_words"))
    best = containment.search(q, bags, top_k, threshold, broadcast_rows, hot_word_docs)
    if threshold > 0:
        return best
    best = stage(best, "overlap")
    found = best.groupBy("qid").agg(F.count("*").alias("found"), F.collect_set("doc_ord").alias("taken"))
    # doc_ord is unique; an empty category is the scope of all documents already.
    own = F.when(F.col("category") != "", F.col("category"))
    scope = docs.select("doc_ord", F.explode(F.array(F.lit(""), own)).alias("q_category")).where("q_category is not null")
    heads = (
        first_per_group(scope, ["q_category"], [F.col("doc_ord")], 2 * top_k, spread=F.col("doc_ord"))
        .groupBy("q_category")
        .agg(F.array_sort(F.collect_list("doc_ord")).alias("heads"))
    )
    short = (
        q.select("qid", "q_category")
        .join(found, "qid", "left")
        .where(F.coalesce("found", F.lit(0)) < top_k)
        .join(heads, "q_category")
    )
    fill = short.select(
        "qid",
        F.posexplode(
            F.slice(
                F.array_except("heads", F.coalesce("taken", F.array().cast("array<bigint>"))),
                F.lit(1),
                F.lit(top_k) - F.coalesce("found", F.lit(0)).cast("int"),
            )
        ).alias("pos", "doc_ord"),
        F.coalesce("found", F.lit(0)).alias("found"),
    ).select("qid", "doc_ord", F.lit(0.0).alias("score"), (F.col("found") + F.col("pos") + 1).cast("int").alias("rank"))
    return best.select("qid", "doc_ord", "score", "rank").unionByName(fill)


def token_intersection(a: str, b: str) -> Column:
    """Number of distinct words two texts share."""
    return F.size(F.array_intersect(tx.space_words(F.col(a)), tx.space_words(F.col(b))))
