"""Agreement between two raters, and the sample that is rated twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions import text as tx
from parley.functions.rates import rounded
from parley.operators.judge import AXES
from parley.operators.topn import first_per_group


def validation_sample(evaluated: DataFrame, quotas: list[tuple[str, int]] = fx.VALIDATION_QUOTAS) -> DataFrame:
    """The first rows of each tier by id, up to the tier's quota, numbered in quota order."""
    quota = F.element_at(F.create_map(*[F.lit(x) for pair in quotas for x in pair]), F.col("_tier"))
    place = F.element_at(F.create_map(*[F.lit(x) for i, (t, _) in enumerate(quotas) for x in (t, i)]), F.col("_tier"))
    tiers = [t for t, _ in quotas]
    rows = evaluated.withColumn("_tier", F.coalesce("difficulty", F.lit("routine"))).where(F.col("_tier").isin(tiers))
    few = first_per_group(
        rows, ["_tier"], [F.col("id")], max(q for _, q in quotas), "_rank", spread=F.col("id")
    ).where(F.col("_rank") <= quota)
    # At most the sum of the quotas.
    number = F.row_number().over(Window.orderBy(place, "_rank"))
    return few.withColumn("sample_id", F.format_string("VAL_%03d", number)).drop("_tier", "_rank")


def blind_export(sample: DataFrame) -> DataFrame:
    """What a human rater sees: no judge scores, an empty score form."""
    form = F.struct(
        *[F.lit(None).cast("int").alias(a) for a in AXES],
        F.lit(None).cast("boolean").alias("passed"),
        F.lit("").alias("notes"),
    )
    return sample.select(
        "sample_id",
        F.col("id").alias("test_id"),
        "difficulty",
        F.col("message_text").alias("customer_query"),
        "thread_context",
        F.col("draft_reply").alias("agent_response"),
        F.col("predicted_escalate").alias("escalated"),
        "escalate_reason",
        F.transform(
            "grounding_sources",
            lambda s: F.struct(s["doc_id"].alias("doc_id"), s["category"].alias("category"), s["content"].alias("content")),
        ).alias("retrieved_precedents"),
        form.alias("human_score_template"),
    )


def reference_labels(df: DataFrame, query: str, reply: str, precedents: Column, escalated: str, difficulty: str) -> DataFrame:
    """Rule-made scores of a second rater, as columns with the prefix human_."""
    has = lambda c, w: F.contains(c, F.lit(w))
    q, r, p = F.col("_q"), F.col("_r"), F.col("_p")
    out = (
        df.withColumn("_q", F.lower(query))
        .withColumn("_r", F.lower(F.coalesce(F.col(reply), F.lit(""))))
        .withColumn("_p", F.lower(F.array_join(precedents, " ")))
    )
    auto = ~F.coalesce(F.col(escalated), F.lit(False))
    off_topic = (has(q, "return") & ~has(r, "return")) | (has(q, "track") & ~has(r, "track") & ~has(r, "http"))
    brief = tx.word_count(r) < 12
    vague = (F.col(difficulty) == "ambiguous") & ~off_topic
    partial = (F.col(difficulty) == "multi_issue") & ~brief
    five = F.lit(5)
    out = (
        out.withColumn("human_grounding_score", F.when(auto & has(r, "http") & ~has(p, "http"), 3).otherwise(five))
        .withColumn("human_correctness_score", F.when(auto & off_topic, 3).when(auto & vague, 4).otherwise(five))
        .withColumn("human_tone_score", five)
        .withColumn("human_completeness_score", F.when(auto & brief, 3).when(auto & partial, 4).otherwise(five))
        .withColumn(
            "human_notes",
            F.when(~auto, fx.NOTE_HANDOFF)
            .when(vague, fx.NOTE_AMBIGUOUS)
            .when(partial, fx.NOTE_MULTI)
            .otherwise(F.lit(fx.NOTE_CLEAN)),
        )
    )
    good = (F.col("human_grounding_score") >= 4) & (F.col("human_correctness_score") >= 4)
    return out.withColumn("human_passed", ~auto | good).drop("_q", "_r", "_p")


def judge_vs_human(human: DataFrame, judge: DataFrame) -> DataFrame:
    """Both ratings per sample; a missing judge rating counts as passed with fours."""
    renamed = judge.select("sample_id", F.col("passed").alias("_passed"), "critique", *[F.col(a).alias("_" + a) for a in AXES])
    joined = human.join(renamed, "sample_id", "left")
    return joined.select(
        *human.columns,
        F.coalesce("_passed", F.lit(True)).alias("judge_passed"),
        *[F.coalesce("_" + a, F.lit(4)).alias("judge_" + a) for a in AXES],
        F.col("critique").alias("judge_critique"),
    )


def kappa(df: DataFrame, a: str, b: str, errors: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Agreement of two boolean ratings: 2x2 table, observed and expected share, kappa, and its label.

    `errors` names mean absolute differences of further column pairs.
    """
    x, y = F.col(a), F.col(b)
    table = df.agg(
        F.count("*").alias("n"),
        F.count_if(x & y).alias("both_passed"),
        F.count_if(x & ~y).alias("first_only"),
        F.count_if(~x & y).alias("second_only"),
        F.count_if(~x & ~y).alias("both_failed"),
        *[rounded(F.avg(F.abs(F.col(p) - F.col(q))), 3).alias(k) for k, (p, q) in (errors or {}).items()],
    )
    n, aa, bb, cc, dd = (F.col(c) for c in ("n", "both_passed", "first_only", "second_only", "both_failed"))
    observed = (aa + dd) / n
    expected = ((aa + bb) / n) * ((aa + cc) / n) + ((cc + dd) / n) * ((bb + dd) / n)
    out = table.where(n > 0).withColumn("_o", observed).withColumn("_e", expected)
    out = out.withColumn(
        "_k", F.when(1 - F.col("_e") != 0, (F.col("_o") - F.col("_e")) / (1 - F.col("_e"))).otherwise(F.lit(1.0))
    )
    label = F.lit(fx.KAPPA_LOWEST)
    for bound, name in reversed(fx.KAPPA_LABELS):
        label = F.when(F.col("_k") >= bound, F.lit(name)).otherwise(label)
    return out.select(
        "n",
        rounded("_o", 4).alias("observed_agreement"),
        rounded("_e", 4).alias("expected_agreement"),
        rounded("_k", 4).alias("kappa"),
        label.alias("interpretation"),
        "both_passed",
        "first_only",
        "second_only",
        "both_failed",
        *(errors or {}),
    )


def rater_agreement(ratings: DataFrame) -> DataFrame:
    short = {a: a.removesuffix("_score") + "_mae" for a in AXES}
    return kappa(
        ratings, "human_passed", "judge_passed", {short[a]: (f"human_{a}", f"judge_{a}") for a in AXES}
    )


def rater_discrepancies(ratings: DataFrame) -> DataFrame:
    return ratings.where(F.col("human_passed") != F.col("judge_passed")).select(
        "sample_id", "human_passed", "judge_passed", "human_notes", "judge_critique"
    )
