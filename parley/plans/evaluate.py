"""Gold rows through triage and the rubric to every metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import metrics
from parley.operators.baselines import baseline_runs
from parley.operators.judge import AXES, judge_rubric, judge_summary, numbered_context, plain_context
from parley.operators.retrieval import TermIndex
from parley.plans.triage import triage


def evaluated_records(gold: DataFrame, index: TermIndex, **triage_options) -> DataFrame:
    """One record per gold row: labels, predictions, draft, sources and rubric scores."""
    out = triage(gold.select(F.col("id").alias("msg_id"), F.col("message_text").alias("text")), index, **triage_options)
    pred = out.select(
        F.col("msg_id").alias("id"),
        F.col("intent").alias("predicted_intent"),
        "confidence",
        F.col("escalate").alias("predicted_escalate"),
        F.col("escalate_reason").alias("pred_reason"),
        "draft_reply",
        "grounding_sources",
    )
    joined = metrics.gold_vs_pred(gold, pred).withColumn("_context", numbered_context(F.col("grounding_sources")))
    judged = judge_rubric(joined, "message_text", "_context", "draft_reply", "predicted_escalate")
    expected, predicted = F.coalesce("true_escalate", F.lit(False)), F.col("predicted_escalate")
    return judged.select(
        "id",
        F.coalesce("difficulty", F.lit("routine")).alias("difficulty"),
        "message_text",
        "thread_context",
        "true_intent",
        "predicted_intent",
        (F.col("true_intent") == F.col("predicted_intent")).alias("intent_correct"),
        "confidence",
        expected.alias("true_escalate"),
        "predicted_escalate",
        (expected == predicted).alias("escalation_correct"),
        metrics.escalation_category(expected, predicted).alias("escalation_category"),
        F.col("pred_reason").alias("escalate_reason"),
        "draft_reply",
        "grounding_sources",
        F.struct(F.col("id").alias("test_id"), *AXES, "overall_score", "passed", "critique").alias("judge_evaluation"),
    )


def evaluate(records: DataFrame, gold: DataFrame | None = None) -> dict[str, DataFrame]:
    """Metric tables of evaluated records; with gold rows also the baselines and the scorecard."""
    rates = metrics.escalation_rates(records)
    out = {
        "rates": rates,
        "per_intent": metrics.per_intent(records),
        "macro": metrics.macro_average(metrics.per_intent(records)),
        "confusion": metrics.intent_confusion(records),
        "tiers": metrics.tier_metrics(records),
        "failures": metrics.failure_cases(records),
        "judge": judge_summary(records.select("judge_evaluation.*")),
        "safety": rates.select(metrics.safety_assessment(F.col("fn")).alias("safety_assessment")),
    }
    baselines = None
    if gold is not None:
        baselines = metrics.escalation_rates(baseline_runs(gold), ["system"])
        out["baselines"] = baselines
    out["scorecard"] = metrics.scorecard(rates, baselines)
    return out


def grounded_records(gold: DataFrame, index: TermIndex, judge: bool = False, **triage_options) -> DataFrame:
    """Gold rows (id, message_text, true_intent, true_escalate, difficulty, grounding_doc_ids) with what triage gives.

    Expected and retrieved doc_ids stand side by side. With `judge`, the rubric reads the documents' contents alone.
    """
    out = triage(gold.select(F.col("id").alias("msg_id"), F.col("message_text").alias("text")), index, **triage_options)
    found = out.select(
        F.col("msg_id").alias("id"),
        F.col("intent").alias("predicted_intent"),
        F.col("escalate").alias("predicted_escalate"),
        F.col("escalate_reason").alias("pred_reason"),
        "draft_reply",
        F.transform("grounding_sources", lambda s: s["doc_id"]).alias("retrieved_doc_ids"),
        plain_context(F.col("grounding_sources")).alias("_context"),
    )
    rows = gold.join(found, "id")
    columns = [
        "id",
        "message_text",
        "true_intent",
        "predicted_intent",
        F.coalesce("true_escalate", F.lit(False)).alias("true_escalate"),
        "predicted_escalate",
        F.coalesce("difficulty", F.lit("routine")).alias("difficulty"),
        F.coalesce("grounding_doc_ids", F.array().cast("array<string>")).alias("expected_doc_ids"),
        "retrieved_doc_ids",
        "draft_reply",
        F.col("pred_reason").alias("escalate_reason"),
    ]
    if not judge:
        return rows.select(*columns)
    scores = F.struct(F.col("id").alias("test_id"), *AXES, "overall_score", "passed", "critique")
    judged = judge_rubric(rows, "message_text", "_context", "draft_reply", "predicted_escalate")
    return judged.select(*columns, scores.alias("judge_evaluation"))


def classification(records: DataFrame, order: list[str] | None = None) -> dict[str, DataFrame]:
    """Metric tables of grounded records; failing ids are given in the order of the columns `order` (default: id)."""
    out = {
        "rates": metrics.escalation_rates(records).withColumn(
            "grounding_hit_rate", metrics.grounding_hit_rate(records).scalar()
        ),
        "per_intent": metrics.per_intent(records),
        "tiers": metrics.tier_metrics(records),
        "confusion": metrics.confusion_counts(records),
        "failures": metrics.failing_ids(records, order or ["id"]),
    }
    if "judge_evaluation" in records.columns:
        out["judge"] = judge_summary(records.select("judge_evaluation.*"))
    return out


def summary(records: DataFrame) -> DataFrame:
    """All headline numbers as one nested row."""
    rates = metrics.escalation_rates(records)

    def by_key(df: DataFrame, key: str) -> DataFrame:
        # Twelve intents, six tiers.
        value = F.struct(*[c for c in df.columns if c != key])
        return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), value)))))

    judge = judge_summary(records.select("judge_evaluation.*")).select(F.struct("*"))
    return rates.select(
        F.struct("*").alias("escalation_metrics"),
        by_key(metrics.per_intent(records), "intent").scalar().alias("per_intent_metrics"),
        by_key(metrics.tier_metrics(records), "difficulty").scalar().alias("tier_stratification"),
        judge.scalar().alias("judge_qualitative_metrics"),
    )
