"""Rubric scores for drafted replies, and scores read from recorded judge answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions import text as tx
from parley.functions.rates import rounded

AXES = ["grounding_score", "correctness_score", "tone_score", "completeness_score"]


def numbered_context(sources: Column) -> Column:
    """'[doc_id] content' lines."""
    return F.array_join(
        F.transform(sources, lambda s: F.concat(F.lit("["), s["doc_id"], F.lit("] "), s["content"])), "\n"
    )


def plain_context(sources: Column) -> Column:
    return F.array_join(F.transform(sources, lambda s: s["content"]), "\n")


def unattested_urls(reply: Column, context: Column) -> Column:
    """URLs of the reply that do not occur in the context."""
    urls = F.regexp_extract_all(reply, F.lit(tx.MATCH_CASE + fx.URL_PATTERN), F.lit(0))
    return F.filter(urls, lambda u: ~F.contains(context, u))


def unattested_spans(reply: Column, context: Column) -> Column:
    """Time spans of the reply that do not occur in the context, ignoring case."""
    spans = F.regexp_extract_all(reply, F.lit(tx.IGNORE_CASE + fx.TIME_SPAN_PATTERN), F.lit(1))
    return F.filter(spans, lambda s: ~F.contains(F.lower(context), F.lower(s)))


def _passed(df: DataFrame) -> DataFrame:
    good = (F.col("grounding_score") >= 4) & (F.col("correctness_score") >= 4) & (F.col("tone_score") >= 3)
    total = sum((F.col(a) for a in AXES[1:]), F.col(AXES[0]))
    return df.withColumn("overall_score", rounded(total / 4.0, 2)).withColumn("passed", good)


def judge_rubric(df: DataFrame, query: str, context: str, reply: str, escalated: str) -> DataFrame:
    """Add four scores, their mean, the verdict and a critique."""
    has = lambda c, w: F.contains(F.lower(c), F.lit(w))
    out = df.withColumn("_reply", tx.strip(F.coalesce(F.col(reply), F.lit(""))))
    q, r, auto = F.col(query), F.col("_reply"), ~F.col(escalated)
    out = out.withColumn("_urls", unattested_urls(r, F.col(context))).withColumn(
        "_spans", unattested_spans(r, F.col(context))
    )
    no_return = has(q, "return") & ~has(r, "return") & ~has(r, "orders")
    no_track = has(q, "track") & ~has(r, "track") & ~has(r, "http")
    bare = ~F.contains(r, F.lit("http")) & (has(q, "link") | has(q, "where"))
    five = F.lit(5)
    out = (
        out.withColumn(
            "grounding_score", F.when(auto & ((F.size("_urls") > 0) | (F.size("_spans") > 0)), 3).otherwise(five)
        )
        .withColumn("correctness_score", F.when(auto & (no_return | no_track), 3).otherwise(five))
        .withColumn(
            "tone_score",
            F.when(auto & (F.length(r) < 25), 3).when(auto & ~tx.has(r, fx.COURTESY_PATTERN), 4).otherwise(five),
        )
        .withColumn(
            "completeness_score", F.when(auto & (tx.word_count(r) < 10), 3).when(auto & bare, 4).otherwise(five)
        )
    )
    notes = F.concat_ws(
        " ",
        F.transform("_urls", lambda u: F.format_string(fx.CRITIQUE_URL, u)),
        F.transform("_spans", lambda s: F.format_string(fx.CRITIQUE_TIME, s)),
        F.when(no_return, F.lit(fx.CRITIQUE_RETURN)),
        F.when(no_track, F.lit(fx.CRITIQUE_TRACK)),
    )
    out = out.withColumn(
        "critique",
        F.when(~auto, F.lit(fx.CRITIQUE_ESCALATED))
        .when(F.length(notes) > 0, notes)
        .otherwise(F.lit(fx.CRITIQUE_CLEAN)),
    )
    return _passed(out).drop("_reply", "_urls", "_spans")


def parse_judge(df: DataFrame, query: str, context: str, reply: str, escalated: str, response: str) -> DataFrame:
    """Scores from recorded judge answers; unreadable answers are scored by the rubric."""
    rubric = judge_rubric(df, query, context, reply, escalated)
    raw = F.coalesce(F.col(response), F.lit("{}"))
    schema = ", ".join(f"{a} string" for a in AXES) + ", critique string"
    parsed = rubric.withColumn("_a", F.from_json(raw, schema))
    numbers = [F.coalesce(F.col(f"_a.{a}"), F.lit("4")).try_cast("double") for a in AXES]
    ok = F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("{") & F.col("_a").isNotNull()
    for n in numbers:
        ok = ok & n.isNotNull()
    parsed = parsed.withColumn("_ok", ok)
    for axis, number in zip(AXES, numbers):
        parsed = parsed.withColumn(axis, F.when(F.col("_ok"), number.cast("int")).otherwise(F.col(axis)))
    parsed = parsed.withColumn(
        "critique",
        F.when(F.col("_ok"), F.coalesce("_a.critique", F.lit(fx.CRITIQUE_MODEL))).otherwise(F.col("critique")),
    )
    return _passed(parsed).drop("_a", "_ok")


def judge_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or [])).agg(
        *[rounded(F.avg(a), 2).alias("mean_" + a) for a in AXES],
        rounded(F.avg("overall_score"), 2).alias("mean_overall_score"),
        rounded(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"),
        F.count("*").alias("total_evaluated"),
    )
