from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parley.operators import agreement, judge, metrics
from parley.operators.policy import PolicyConfig, escalation_policy

ROWS = "id string, true_intent string, predicted_intent string, true_escalate boolean, predicted_escalate boolean, difficulty string"


def test_three_records(spark):
    rows = spark.createDataFrame(
        [
            ("T1", "order_status_delay", "order_status_delay", False, False, "routine"),
            ("T2", "billing_payment_disputes", "billing_payment_disputes", True, True, "high_risk"),
            ("T3", "returns_refunds", "returns_refunds", False, True, None),
        ],
        ROWS,
    )
    r = metrics.escalation_rates(rows).first()
    assert (r.total, r.intent_accuracy, r.missed_escalation_rate, r.false_escalation_rate) == (3, 1.0, 0.0, 0.5)
    assert r.escalation_accuracy == pytest.approx(2 / 3, abs=1e-4)
    assert {t.difficulty: t["count"] for t in metrics.tier_metrics(rows).collect()} == {"routine": 2, "high_risk": 1}
    assert metrics.per_intent(rows, all_classes=False).count() == 3 and metrics.per_intent(rows).count() == 12
    assert [f.id for f in metrics.failure_cases(rows).collect()] == ["T3"]
    assert metrics.intent_confusion(rows).agg(F.count("*"), F.sum("n")).first()[:] == (144, 3)
    card = {c.metric: c for c in metrics.scorecard(metrics.escalation_rates(rows)).collect()}
    assert card["intent_accuracy"].delta == pytest.approx(0.395) and card["intent_accuracy"].trivial_always_escalate == 0.135


def test_empty_input_gives_zeros(spark):
    r = metrics.escalation_rates(spark.createDataFrame([], ROWS)).first()
    assert r[:] == (0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert agreement.kappa(spark.createDataFrame([], "a boolean, b boolean"), "a", "b").count() == 0


@pytest.mark.parametrize(
    "cells,kappa,label",
    [
        ((34, 0, 0, 1), 1.0, "Almost Perfect Agreement"),
        ((10, 0, 0, 0), 1.0, "Almost Perfect Agreement"),
        ((20, 5, 10, 15), 0.4, "Fair Agreement"),
    ],
)
def test_kappa(spark, cells, kappa, label):
    pairs = [(True, True), (True, False), (False, True), (False, False)]
    df = spark.createDataFrame([p for p, n in zip(pairs, cells) for _ in range(n)], "a boolean, b boolean")
    r = agreement.kappa(df, "a", "b").first()
    assert (r.kappa, r.interpretation) == (kappa, label)


def test_judge(spark):
    rows = [
        ("1", "Where is my order #123?", "Track your order status directly via amazon.com/orders.", "You can track your order status directly via amazon.com/orders.", False),
        ("2", "Can I have a refund?", "For refunds, please check your orders page.", "Sure! We will process your complete refund within 48 hours via https://fake-claim.com.", False),
        ("3", "x", "", "", True),
        ("4", "can I return it", "c", "No way.", False),
    ]
    df = spark.createDataFrame(rows, "id string, q string, c string, r string, e boolean")
    got = {r.id: r for r in judge.judge_rubric(df, "q", "c", "r", "e").collect()}
    assert got["1"].passed and got["1"].grounding_score == 5 and got["1"].overall_score >= 4
    assert got["2"].grounding_score == 3 and not got["2"].passed
    assert got["2"].critique.startswith("URL 'https://fake-claim.com.' not found") and "Timeframe '48 hours'" in got["2"].critique
    assert got["3"].overall_score == 5.0 and got["3"].passed
    assert (got["4"].correctness_score, got["4"].tone_score, got["4"].completeness_score) == (3, 3, 3)


def test_policy_rules_in_order(spark):
    rows = [
        ("1", "my lawyer", None, None, None, 0),
        ("2", "my LAWYER calls", "returns_refunds", 0.9, False, 3),
        ("3", "x", "other_unclear", 0.35, True, 3),
        ("4", "x", "billing_payment_disputes", 0.95, False, 3),
        ("5", "x", "returns_refunds", 0.5, False, 3),
        ("6", "x", "returns_refunds", 0.9, True, 3),
        ("7", "x", "returns_refunds", 0.9, False, 0),
        ("8", "x", "returns_refunds", 0.9, False, 2),
    ]
    df = spark.createDataFrame(rows, "id string, t string, i string, c double, a boolean, n int")
    d = escalation_policy(F.col("t"), F.col("i"), F.col("c"), F.col("a"), F.col("n"), PolicyConfig())
    got = {r.id: (r.d.escalate, r.d.reason) for r in df.select("id", d.alias("d")).collect()}
    assert got["1"][1] == "Escalated: No intent prediction available."
    assert "legal, regulatory" in got["2"][1] and "unclassifiable" in got["3"][1]
    assert got["4"][1] == "Escalated: Intent 'billing_payment_disputes' is categorized as critical risk and requires mandatory human handling per policy."
    assert got["5"][1] == "Escalated: Intent confidence (0.50) is below operational threshold (0.60) or prediction is ambiguous."
    assert "(0.90)" in got["6"][1]
    assert got["7"][1] == "Escalated: No relevant precedent retrieved with similarity >= 0.20 (found 0 qualified precedents)."
    assert got["8"] == (False, "Autonomous handling approved: High confidence (90.00%) in intent 'returns_refunds' backed by 2 qualified grounding precedent(s).")
    assert all(got[k][0] for k in "1234567")


def test_validation_sample_and_blind_export(spark):
    rows = spark.range(60).select(
        F.format_string("G%03d", "id").alias("id"),
        F.when(F.col("id") % 3 == 0, "low_signal").when(F.col("id") % 3 == 1, "routine").alias("difficulty"),
        F.lit("m").alias("message_text"),
        F.lit("c").alias("thread_context"),
        F.lit("r").alias("draft_reply"),
        F.lit(False).alias("predicted_escalate"),
        F.lit("w").alias("escalate_reason"),
        F.array(F.struct(F.lit("d").alias("doc_id"), F.lit("a").alias("category"), F.lit("t").alias("content"))).alias("grounding_sources"),
    )
    sample = agreement.validation_sample(rows)
    got = [(r.sample_id, r.id) for r in sample.orderBy("sample_id").collect()]
    # A missing tier counts as routine.
    assert len(got) == 14 and got[0] == ("VAL_001", "G001") and got[1] == ("VAL_002", "G002") and got[12] == ("VAL_013", "G000")
    assert "judge_evaluation" not in agreement.blind_export(sample).columns
