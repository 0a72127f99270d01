"""Exact top-k term join that forms few of the pairs (query, document) that share a term.

The terms of a query are put in order, rare ones first. A document that first meets a query at one of them scores at most
what that term gives plus what all later ones could give. Two bounds hold for the rest, and the smaller one counts: the
largest weights of the later terms among documents of the same class (documents of about equal largest weight), and
the length of the rest of the query times the length of the rest of the document in the same order. A pair that cannot
reach the k-th best score is not formed. That score is first estimated from below: the rarest terms give some
documents, which are scored in full. Then the pairs that pass are scored in full too, from whole document vectors,
so the result is that of the plain join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.rates import rounded
from parley.operators.topn import first_per_group
from parley.session import stage, stage_counted

# Documents of one class have largest weights within an eighth of an octave.
CLASSES = 64
PER_OCTAVE = 8
# A query's rarest terms are tried first while they have so many postings together.
FIRST_POSTINGS = 200
# Documents scored in the first pass, for each one that is asked for.
FIRST_DOCS = 4
# Bounds are raised by this much, so that rounding cannot lose a document.
SLACK = 1e-9


@dataclass
class Blocks:
    """rows: term_id, doc_ord, doc_category, weight, tail (length of the rest of the document), doc_class.
    vectors: doc_ord, doc_category, vector (term_id to weight). bounds: term_id, most (largest weight by class)."""

    rows: DataFrame
    vectors: DataFrame
    bounds: DataFrame


def blocks(postings: DataFrame, vocab: DataFrame) -> Blocks:
    """What pruning needs of an index, staged. A document's terms are one group, at most as large as the vocabulary."""
    rows = postings.join(F.broadcast(vocab.select("term", "term_id", "df")), "term")
    document = Window.partitionBy("doc_ord")
    upto = document.orderBy("df", "term_id").rowsBetween(Window.unboundedPreceding, 0)
    square = F.col("weight") * F.col("weight")
    octave = F.floor(-PER_OCTAVE * F.log2(F.max("weight").over(document))).cast("int")
    rows = stage(
        rows.select(
            "term_id",
            "doc_ord",
            "doc_category",
            "weight",
            F.sqrt(F.greatest(1 - F.sum(square).over(upto), F.lit(0.0))).alias("tail"),
            F.greatest(F.least(octave, F.lit(CLASSES - 1)), F.lit(0)).alias("doc_class"),
        ),
        "block-rows",
    )
    vector = F.map_from_entries(F.collect_list(F.struct("term_id", "weight"))).alias("vector")
    vectors = stage(rows.groupBy("doc_ord", "doc_category").agg(vector), "vectors")
    found = rows.groupBy("term_id", "doc_class").agg(F.max("weight").alias("w")).groupBy("term_id").agg(
        F.map_from_entries(F.collect_list(F.struct("doc_class", "w"))).alias("m")
    )
    classes = F.sequence(F.lit(0), F.lit(CLASSES - 1))
    most = F.transform(classes, lambda c: F.coalesce(F.element_at("m", c), F.lit(0.0)))
    return Blocks(rows, vectors, stage(found.select("term_id", most.alias("most")), "bounds"))


def _asks_category() -> Column:
    return F.coalesce("q_category", F.lit("")) != ""


def _factor(same: float, other: float) -> Column:
    alike = F.when(F.col("q_category").eqNullSafe(F.col("doc_category")), same).otherwise(other)
    return F.when(_asks_category(), alike).otherwise(F.lit(1.0))


def ordered_terms(terms: DataFrame, bounds: DataFrame) -> DataFrame:
    """Query terms in order of rarity, with what the later ones can give: by class (`rest`) and by length (`q_tail`)."""
    order = Window.partitionBy("qid").orderBy("df", "term_id")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    placed = terms.join(bounds, "term_id").withColumns(
        {
            "reach": F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "q_tail": F.sqrt(F.greatest(F.coalesce(F.sum(F.col("q_weight") ** 2).over(later), F.lit(0.0)), F.lit(0.0))),
        }
    )
    columns = ["qid", "q_category", "term_id", "df", "q_weight", "reach", "q_tail"]
    by_class = placed.select(*columns, F.posexplode("most").alias("c", "w"))
    after = Window.partitionBy("qid", "c").orderBy("df", "term_id").rowsBetween(1, Window.unboundedFollowing)
    rest = by_class.withColumn("gives", F.coalesce(F.sum(F.col("q_weight") * F.col("w")).over(after), F.lit(0.0)))
    entries = F.array_sort(F.collect_list(F.struct("c", "gives", "w")))
    packed = rest.groupBy(*columns).agg(entries.alias("e"))
    return packed.select(*columns, F.col("e.gives").alias("rest"), F.col("e.w").alias("most"))


def _meet(terms: DataFrame, rows: DataFrame, n_terms: int, broadcast_rows: int, hot_docs: int) -> DataFrame:
    """Query terms with the postings of each. Beyond the bound both sides are shuffled, hot terms over several keys."""
    if n_terms * CLASSES <= broadcast_rows * 8:
        return rows.join(F.broadcast(terms), "term_id")
    parts = F.greatest(F.ceil(F.col("df") / hot_docs).cast("int"), F.lit(1))
    asked = terms.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    sizes = stage(terms.groupBy("term_id").agg(F.first("df").alias("df")), "asked-terms")
    dealt = rows.join(sizes, "term_id").withColumn("part", F.pmod(F.xxhash64("doc_ord"), parts.cast("long")).cast("int"))
    return asked.join(dealt.drop("df"), ["term_id", "part"])


def _scored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, factor: Column, digits: int) -> DataFrame:
    """Full score (raw) of every pair (qid, doc_ord), from whole vectors."""
    zero = F.lit(0.0)
    dot = F.aggregate(
        "asked", zero, lambda s, t: s + t["q_weight"] * F.coalesce(F.element_at(F.col("vector"), t["term_id"]), zero)
    )
    whole = pairs.join(vectors, "doc_ord").join(queries, "qid")
    return whole.select("qid", "doc_ord", rounded(dot * factor, digits).alias("raw"))


def first_rows(ordered: DataFrame, blocks: Blocks, n_terms: int, broadcast_rows: int, hot_docs: int) -> DataFrame:
    """Postings of the rarest terms of each query."""
    return _meet(ordered.where(F.col("reach") <= FIRST_POSTINGS), blocks.rows, n_terms, broadcast_rows, hot_docs)


def passing_rows(
    ordered: DataFrame, floors: DataFrame, blocks: Blocks, factor: Column, best_factor: float, n_terms: int, broadcast_rows: int, hot_docs: int
) -> DataFrame:
    """Postings at which a document may first meet a query and still reach the floor of the query."""
    floor = F.col("floor") - SLACK
    could = F.zip_with("rest", "most", lambda r, w: r + w * F.col("q_weight"))
    highest = F.when(_asks_category(), F.lit(best_factor)).otherwise(F.lit(1.0))
    # Later terms alone cannot make a document a candidate.
    prefix = ordered.join(floors, "qid").where(F.array_max(could) * highest >= floor).drop("most", "reach")
    rest = F.least(F.element_at("rest", F.col("doc_class") + 1), F.col("q_tail") * F.col("tail"))
    met = _meet(prefix, blocks.rows, n_terms, broadcast_rows, hot_docs)
    return met.where((F.col("q_weight") * F.col("weight") + rest) * factor >= floor)


def search(
    terms: DataFrame,
    blocks: Blocks,
    top_k: int,
    threshold: float,
    same: float,
    other: float,
    digits: int,
    broadcast_rows: int,
    hot_docs: int,
) -> DataFrame:
    """(qid, doc_ord, raw, rank) of the best documents of every query."""
    factor, best_factor = _factor(same, other), max(same, other, 1.0)
    ordered, n_terms = stage_counted(ordered_terms(terms, blocks.bounds), "ordered-terms", F.count("*"))
    asked = F.array_sort(F.collect_list(F.struct("df", "term_id", "q_weight"))).alias("asked")
    queries = stage(ordered.groupBy("qid", "q_category").agg(asked), "asked")
    tried = first_rows(ordered, blocks, n_terms, broadcast_rows, hot_docs)
    part = tried.groupBy("qid", "doc_ord", "q_category", "doc_category").agg(F.sum(F.col("q_weight") * F.col("weight")).alias("dot"))
    some = first_per_group(
        part.select("qid", "doc_ord", (F.col("dot") * factor).alias("dot")),
        ["qid"],
        [F.desc("dot"), F.col("doc_ord")],
        FIRST_DOCS * top_k,
        spread=F.col("doc_ord"),
    ).select("qid", "doc_ord")
    order = [F.desc("raw"), F.col("doc_ord")]
    known = first_per_group(
        _scored(some, queries, blocks.vectors, factor, digits), ["qid"], order, top_k, spread=F.col("doc_ord")
    )
    kth = known.groupBy("qid").agg(F.when(F.count("*") >= top_k, F.min("raw")).alias("kth"))
    floor = F.greatest(F.coalesce("kth", F.lit(threshold)), F.lit(threshold)).alias("floor")
    floors = stage(queries.select("qid").join(kth, "qid", "left").select("qid", floor), "floors")
    passing = passing_rows(ordered, floors, blocks, factor, best_factor, n_terms, broadcast_rows, hot_docs)
    pairs = stage(passing.select("qid", "doc_ord").distinct(), "candidates")
    scored = _scored(pairs, queries, blocks.vectors, factor, digits).where(F.col("raw") >= threshold)
    return first_per_group(scored, ["qid"], order, top_k, spread=F.col("doc_ord"))
