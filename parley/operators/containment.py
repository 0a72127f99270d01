"""Exact top-k by the share of a query's words that a document holds.

Words are put in one order for all queries, by the number of documents that hold them, rare ones first. A document with
c words of a query of n holds one of the query's first n - c + 1 words, so only those are joined, and only documents of
at least c words. c follows from the threshold and from a lower bound on the k-th best count of each query, which the
documents found by its rarest words give. Pairs found are then counted in full, from the document's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.topn import first_per_group
from parley.session import stage, stage_counted

# A query's rarest words are tried first while they are in so many documents together.
FIRST_POSTINGS = 200
# Documents counted in the first pass, for each one that is asked for.
FIRST_DOCS = 4
# A word in more documents than this is split over several join keys on both sides.
HOT_WORD_DOCS = 50_000


def _ordered(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """qid, q_category, n_words, word, df, place (from 1, rare words first), reach. Words of no document have df 0."""
    words = queries.select("qid", "q_category", "n_words", F.explode("words").alias("word")).join(counts, "word", "left")
    words = words.withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy("qid").orderBy("df", "word")
    return words.withColumns(
        {
            "place": F.row_number().over(order),
            "reach": F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )


def meet(words: DataFrame, d_words: DataFrame, n_words: int, broadcast_rows: int, hot_docs: int) -> DataFrame:
    """Query words with the documents that hold each: broadcast up to the bound, else dealt by word and part."""
    words = words.where("df > 0")
    if n_words <= broadcast_rows:
        return d_words.join(F.broadcast(words), "word")
    parts = F.ceil(F.col("df") / hot_docs).cast("int")
    asked = words.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    sizes = stage(words.groupBy("word").agg(F.first("df").alias("df")), "asked-words")
    dealt = d_words.join(sizes, "word").withColumn("part", F.pmod(F.xxhash64("doc_ord"), parts.cast("long")).cast("int"))
    return asked.join(dealt.drop("df"), ["word", "part"])


def _counted(pairs: DataFrame, queries: DataFrame, bags: DataFrame) -> DataFrame:
    """common: number of words of the query in the document, for every pair (qid, doc_ord)."""
    whole = pairs.join(bags, "doc_ord").join(queries, "qid")
    return whole.select("qid", "doc_ord", "n_words", F.size(F.array_intersect("words", "d_words")).alias("common"))


def passing(ordered: DataFrame, floors: DataFrame, d_words: DataFrame, n_words: int, broadcast_rows: int, hot_docs: int) -> DataFrame:
    """Rows of the join on the first words of each query, with documents that are long enough."""
    first = ordered.join(floors, "qid").where(F.col("place") <= F.col("n_words") - F.col("least") + 1)
    return meet(first, d_words, n_words, broadcast_rows, hot_docs).where((F.col("size") >= F.col("least")) & _same_category())


def _same_category() -> Column:
    return (F.col("q_category") == "") | F.col("q_category").eqNullSafe(F.col("doc_category"))


def search(
    queries: DataFrame,
    bags: DataFrame,
    top_k: int,
    threshold: float,
    broadcast_rows: int,
    hot_docs: int = HOT_WORD_DOCS,
) -> DataFrame:
    """(qid, doc_ord, score, rank) of the documents with a common word and the best shares.

    queries: qid, q_category ('' for any), words (distinct), n_words. bags: doc_ord, doc_category, d_words (distinct).
    """
    queries = stage(queries, "overlap-queries")
    bags = stage(bags, "overlap-words")
    d_words = bags.select("doc_ord", "doc_category", F.size("d_words").alias("size"), F.explode("d_words").alias("word"))
    asked = queries.select(F.explode("words").alias("word")).distinct()
    counts = d_words.join(asked, "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    ordered, n_words = stage_counted(_ordered(queries, counts), "overlap-order", F.count("*"))
    tried = meet(ordered.where(F.col("reach") <= FIRST_POSTINGS), d_words, n_words, broadcast_rows, hot_docs)
    hits = tried.where(_same_category()).groupBy("qid", "doc_ord").agg(F.count("*").alias("c"))
    some = first_per_group(hits, ["qid"], [F.desc("c"), F.col("doc_ord")], FIRST_DOCS * top_k, spread=F.col("doc_ord"))
    order = [F.desc("common"), F.col("doc_ord")]
    known = first_per_group(
        _counted(some.select("qid", "doc_ord"), queries, bags), ["qid"], order, top_k, spread=F.col("doc_ord")
    )
    kth = known.groupBy("qid").agg(F.when(F.count("*") >= top_k, F.min("common")).alias("kth"))
    # The smallest count that reaches the threshold, lowered by one against rounding; the score itself is tested below.
    enough = F.floor(F.lit(threshold) * F.col("n_words")).cast("int")
    least = F.greatest(F.coalesce("kth", F.lit(1)), enough, F.lit(1)).alias("least")
    floors = stage(queries.select("qid", "n_words").join(kth, "qid", "left").select("qid", least), "overlap-floors")
    pairs = stage(
        passing(ordered, floors, d_words, n_words, broadcast_rows, hot_docs).select("qid", "doc_ord").distinct(),
        "overlap-candidates",
    )
    scored = (
        _counted(pairs, queries, bags)
        .select("qid", "doc_ord", (F.col("common") / F.col("n_words")).alias("score"))
        .where(F.col("score") >= threshold)
    )
    return first_per_group(scored, ["qid"], [F.desc("score"), F.col("doc_ord")], top_k, spread=F.col("doc_ord"))
