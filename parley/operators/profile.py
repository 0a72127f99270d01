"""Corpus profiling: lengths, volume over time, n-grams, duplicates, summaries, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.fixed.word_lists import SCAN_PATTERNS, STOPWORDS
from parley.functions import text as tx
from parley.functions.prefilter import fold
from parley.functions.rates import rounded
from parley.operators import heavy
from parley.operators.topn import first_per_group


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """Exact length distribution in characters and words; nulls are left out.

    Texts are reduced to length histograms first, so exact quantiles cost one row per distinct length.
    """
    text = F.col(column)
    histogram = (
        df.where(text.isNotNull())
        .select(
            F.explode(
                F.array(
                    F.struct(F.lit("char").alias("unit"), F.length(text).alias("len")),
                    F.struct(F.lit("word").alias("unit"), tx.word_count(text).alias("len")),
                )
            ).alias("u")
        )
        .groupBy("u.unit", "u.len")
        .agg(F.count("*").alias("n"))
    )
    length, n = F.col("len"), F.col("n")
    total, s1, s2 = F.sum(n), F.sum(length * n), F.sum(length.cast("double") * length * n)
    stats = histogram.groupBy("unit").agg(
        total.alias("texts"),
        (s1 / total).alias("mean"),
        F.when(total > 1, F.sqrt((s2 - s1.cast("double") * s1 / total) / (total - 1))).alias("std"),
        F.min(length).alias("min"),
        F.max(length).alias("max"),
        F.percentile(length, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.95)]), n).alias("q"),
    )
    return stats.select(
        "unit",
        "texts",
        "mean",
        F.col("q")[1].alias("median"),
        "std",
        "min",
        F.col("q")[0].alias("p25"),
        F.col("q")[2].alias("p75"),
        F.col("q")[3].alias("p95"),
        "max",
    )


def length_sketch(df: DataFrame, column: str, k: int = 200) -> DataFrame:
    """Mergeable summary of the length distribution: a row per unit, to be stored and merged with those of new data.

    Quantiles come from a KLL sketch; with k = 200 a quantile is off by less than 2 % of all ranks. Counts, means and
    deviations stay exact.
    """
    text = F.col(column)
    units = F.array(
        F.struct(F.lit("char").alias("unit"), F.length(text).cast("long").alias("len")),
        F.struct(F.lit("word").alias("unit"), tx.word_count(text).cast("long").alias("len")),
    )
    rows = df.where(text.isNotNull()).select(F.explode(units).alias("u")).select("u.*")
    length = F.col("len")
    return rows.groupBy("unit").agg(
        F.count("*").alias("texts"),
        F.sum(length).alias("total"),
        F.sum(length.cast("double") * length).alias("squares"),
        F.min(length).alias("min"),
        F.max(length).alias("max"),
        F.kll_sketch_agg_bigint(length, F.lit(k)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One summary per unit from any number of them."""
    return sketches.groupBy("unit").agg(
        *[F.sum(c).alias(c) for c in ("texts", "total", "squares")],
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
    )


def sketch_stats(sketches: DataFrame) -> DataFrame:
    """The columns of `length_stats` from a summary, quantiles within the bound of the sketch."""
    n, total = F.col("texts"), F.col("total")
    quantile = lambda q: F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).cast("double")
    return sketches.select(
        "unit",
        "texts",
        (total / n).alias("mean"),
        quantile(0.5).alias("median"),
        F.when(n > 1, F.sqrt((F.col("squares") - total.cast("double") * total / n) / (n - 1))).alias("std"),
        "min",
        quantile(0.25).alias("p25"),
        quantile(0.75).alias("p75"),
        quantile(0.95).alias("p95"),
        "max",
    )


def _utc_date(ts: Column) -> Column:
    """Day of an instant in UTC, whatever the time zone of the session."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def monthly_volume(df: DataFrame, created_at: str) -> DataFrame:
    """Messages per month in UTC."""
    ts = tx.parse_created_at(F.col(created_at))
    return (
        df.select(F.date_format(_utc_date(ts), "yyyy-MM").alias("month"))
        .where("month is not null")
        .groupBy("month")
        .agg(F.count("*").alias("messages"))
        .orderBy("month")
    )


def date_range(df: DataFrame, created_at: str) -> DataFrame:
    """First and last day in UTC."""
    ts = tx.parse_created_at(F.col(created_at))
    day = lambda c: F.coalesce(F.date_format(_utc_date(c), "yyyy-MM-dd"), F.lit("N/A"))
    return df.agg(day(F.min(ts)).alias("min_date"), day(F.max(ts)).alias("max_date"))


def turn_distribution(pairs: DataFrame, n: int = 5) -> DataFrame:
    return pairs.groupBy("turn_index").agg(F.count("*").alias("pairs")).orderBy("turn_index").limit(n)


def corpus_summary(pairs: DataFrame) -> DataFrame:
    """Pairs, conversations, and openings against follow-ups.

    Conversations are counted from one partial row per id, so a very long thread is no hot key.
    """
    opening = F.col("turn_index") == 1
    per_thread = pairs.groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.count_if(opening).alias("open")
    )
    total = per_thread.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_pairs"),
        F.count("*").alias("conversations"),
        F.coalesce(F.sum("open"), F.lit(0)).alias("opening_pairs"),
    )
    pct = lambda c: rounded(F.try_divide(c * 100.0, F.col("total_pairs")), 2)
    return total.withColumn("followup_pairs", F.col("total_pairs") - F.col("opening_pairs")).select(
        "*", pct(F.col("opening_pairs")).alias("opening_pct"), pct(F.col("followup_pairs")).alias("followup_pct")
    )


def ngrams(df: DataFrame, column: str, n: int = 2, opening_only: bool = False, remove_stopwords: bool = False) -> DataFrame:
    """gram: every occurrence of an n-gram of words."""
    words = tx.latin_words(F.col(column))
    if opening_only:
        words = F.slice(words, 1, 6)
    if remove_stopwords:
        stop = F.expr(tx.literals(STOPWORDS))
        words = F.filter(words, lambda w: ~F.array_contains(stop, w))
    grams = df.where(F.col(column).isNotNull()).select(words.alias("words"))
    return grams.select(F.explode(tx.ngrams(F.col("words"), n)).alias("gram"))


def ngram_topk(
    df: DataFrame,
    column: str,
    n: int = 2,
    top_k: int = 20,
    opening_only: bool = False,
    remove_stopwords: bool = False,
    two_rounds: bool | None = None,
) -> DataFrame:
    """Most frequent n-grams; ties go to the smaller gram. Large inputs are counted in two rounds (see `heavy`)."""
    return heavy.most_frequent(ngrams(df, column, n, opening_only, remove_stopwords), "gram", top_k, two_rounds)


def opening_bigrams(pairs: DataFrame) -> DataFrame:
    return ngram_topk(pairs.where("turn_index = 1"), "customer_message", 2, 15, opening_only=True)


def opening_trigrams(pairs: DataFrame) -> DataFrame:
    return ngram_topk(pairs.where("turn_index = 1"), "customer_message", 3, 15, opening_only=True)


def content_keywords(pairs: DataFrame) -> DataFrame:
    return ngram_topk(pairs, "customer_message", 1, 20, remove_stopwords=True)


def content_bigrams(pairs: DataFrame) -> DataFrame:
    return ngram_topk(pairs, "customer_message", 2, 15, remove_stopwords=True)


def boilerplate_values(df: DataFrame, column: str, top_k: int = 15) -> DataFrame:
    """Most repeated texts of a column, counted by digest."""
    return heavy.most_frequent_texts(df, column, top_k)


def boilerplate_report(df: DataFrame, column: str) -> DataFrame:
    """Distinct share of a column and the share of rows held by its ten most frequent texts, all counted by digest."""
    counts = heavy.digest_counts(df, column)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("_md5").alias("distinct_values"))
    known = counts.where("_md5 is not null").select("n")
    top = known.orderBy(F.desc("n")).limit(10).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top_rows"))
    return totals.withColumn("top_rows", top.scalar()).select(
        F.lit(column).alias("column"),
        "total",
        "distinct_values",
        rounded(F.try_divide("distinct_values", "total"), 6).alias("uniqueness_ratio"),
        rounded(F.try_divide(F.col("top_rows") * 100.0, F.col("total")), 4).alias("top_10_share_pct"),
    )


def share_by(df: DataFrame, column: str, total: str = "share_pct") -> DataFrame:
    """Rows per value with their share of all rows in percent."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    # The counts hold the total; an unbounded number of values is summed before it meets in one row.
    whole = counts.agg(F.sum("n")).scalar()
    return counts.withColumn(total, rounded(F.col("n") * 100.0 / whole, 1)).orderBy(F.desc("n"), column)


def category_pattern_scan(pairs: DataFrame, examples: int = 0, seed: int = 42) -> DataFrame:
    """Matches of each broad pattern among longer English opening messages.

    With `examples` > 0: that many pseudo-random matching pairs per category instead of counts.
    """
    message = F.col("customer_message")
    english = pairs.where(
        (F.col("turn_index") == 1) & (tx.ascii_share(message) > 0.90) & (F.length(message) > 25)
    ).withColumn("_folded", fold(message))
    folded = F.col("_folded")
    if not examples:
        return english.agg(
            *[F.count_if(tx.has(message, p, folded)).alias(name) for name, p in SCAN_PATTERNS]
        ).select(
            F.expr(
                f"stack({len(SCAN_PATTERNS)}, "
                + ", ".join(f"'{name}', {name}" for name, _ in SCAN_PATTERNS)
                + ") as (category, matches)"
            )
        )
    hits = F.filter(
        F.array(*[F.when(tx.has(message, p, folded), F.lit(name)) for name, p in SCAN_PATTERNS]), lambda c: c.isNotNull()
    )
    tagged = english.select(F.explode(hits).alias("category"), "pair_id", "customer_message", "brand_reply")
    return first_per_group(
        tagged, ["category"], [tx.hash_order(seed, F.col("pair_id")), F.col("pair_id")], examples, spread=F.col("pair_id")
    )


def english_pairs(pairs: DataFrame, share: float = 0.85, words: bool = True) -> DataFrame:
    message = F.col("customer_message")
    keep = tx.ascii_share(message) > share
    if words:
        keep = tx.has(message, fx.ENGLISH_WORDS) & keep
    return pairs.where(keep)


def stratified_sample(pairs: DataFrame, openings: int, followups: int, seed: int = 42) -> DataFrame:
    """Pseudo-random openings and follow-ups, shuffled; the same rows for the same seed."""
    order = tx.hash_order(seed, F.col("pair_id"))

    def draw(part: DataFrame, n: int) -> DataFrame:
        return part.orderBy(order, "pair_id").limit(n)

    both = draw(pairs.where("turn_index = 1"), openings).unionByName(
        draw(pairs.where("turn_index > 1"), followups)
    )
    return both.orderBy(tx.hash_order(seed + 1, F.col("pair_id")), "pair_id")


def sample_pairs(pairs: DataFrame, n: int = 40, seed: int = 42) -> DataFrame:
    """Three quarters openings, one quarter follow-ups."""
    openings = int(n * 0.75)
    return stratified_sample(pairs, openings, n - openings, seed)


def inspect_authors(messages: DataFrame, n: int = 10) -> DataFrame:
    """Most active authors."""
    counts = messages.where("author_id is not null").groupBy("author_id").agg(F.count("*").alias("messages"))
    return counts.orderBy(F.desc("messages"), "author_id").limit(n)


def inspect_source(messages: DataFrame, n: int = 10) -> DataFrame:
    """Row count, column list with positions, and most active authors, as rows of (part, name, value)."""
    rows = messages.agg(F.lit("rows").alias("part"), F.lit(None).cast("string").alias("name"), F.count("*").alias("value"))
    columns = messages.sparkSession.range(1).select(
        F.lit("column").alias("part"), F.posexplode(F.array(*[F.lit(c) for c in messages.columns])).alias("value", "name")
    )
    authors = inspect_authors(messages, n).select(F.lit("author").alias("part"), F.col("author_id").alias("name"), "messages")
    return rows.unionByName(columns.withColumn("value", F.col("value").cast("long"))).union(authors)


def pii_audit(df: DataFrame, text: str) -> DataFrame:
    """Messages and hits per kind of personal data, on the text as it arrives."""
    kinds = [p for _, _, p in fx.PII_RULES]
    hits: list[Column] = [F.regexp_count(F.col(text), F.lit(tx.pii_pattern(k))) for k in kinds]
    per_row = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), h.alias("hits")) for k, h in zip(kinds, hits)])).alias("k"))
    return per_row.groupBy("k.kind").agg(
        F.count_if(F.col("k.hits") > 0).alias("messages"), F.coalesce(F.sum("k.hits"), F.lit(0)).alias("hits")
    )
