"""Escalation policy and gold label rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions import text as tx
from parley.operators.taxonomy import MANDATORY, OTHER, RISK


@dataclass(frozen=True)
class PolicyConfig:
    confidence_threshold: float = 0.60
    min_retrieval_score: float = 0.20
    min_retrieved_docs: int = 1


# Thresholds of the triage job.
TRIAGE_POLICY = PolicyConfig(confidence_threshold=0.65, min_retrieval_score=0.15)


def escalation_policy(
    text: Column, intent: Column, confidence: Column, is_ambiguous: Column, qualified: Column, config: PolicyConfig
) -> Column:
    """struct(escalate, reason) from the first rule that applies.

    `qualified` is the number of retrieved documents at or above the minimum score.
    """
    risk = F.lit(None).cast("string")
    for name in MANDATORY:
        risk = F.when(intent == name, F.lit(RISK[name])).otherwise(risk)
    rules = [
        (intent.isNull(), F.lit(fx.REASON_NO_INTENT)),
        (tx.has(F.lower(text), fx.CRISIS_WORDS), F.lit(fx.REASON_CRISIS)),
        (intent == OTHER, F.lit(fx.REASON_UNCLEAR)),
        (intent.isin(MANDATORY), F.format_string(fx.REASON_MANDATORY, intent, risk)),
        (
            (confidence < config.confidence_threshold) | is_ambiguous,
            F.format_string(fx.REASON_CONFIDENCE, F.format_number(confidence, 2), F.lit(f"{config.confidence_threshold:.2f}")),
        ),
        (
            qualified < config.min_retrieved_docs,
            F.format_string(fx.REASON_GROUNDING, F.lit(f"{config.min_retrieval_score:.2f}"), qualified),
        ),
    ]
    out = F.struct(
        F.lit(False).alias("escalate"),
        F.format_string(fx.REASON_APPROVED, F.format_number(confidence * 100, 2), intent, qualified).alias("reason"),
    )
    for applies, reason in reversed(rules):
        out = F.when(applies, F.struct(F.lit(True).alias("escalate"), reason.alias("reason"))).otherwise(out)
    return out


def gold_escalation_label(intent: Column, query: Column, difficulty: Column) -> Column:
    """struct(escalate, reason): the label a gold row gets before review."""
    lowered = F.lower(query)
    every = lambda words: F.contains(lowered, F.lit(words[0])) & F.contains(lowered, F.lit(words[1]))
    yes = [(intent == name, reason) for name, reason in fx.LABEL_MANDATORY]
    yes += [
        (difficulty == "angry_profane", fx.LABEL_ANGRY),
        (difficulty == "high_risk", fx.LABEL_HIGH_RISK),
        ((difficulty == "multi_issue") & tx.contains_any(lowered, fx.LABEL_MULTI_WORDS), fx.LABEL_MULTI),
        (
            (intent == "delivery_not_received") & tx.contains_any(lowered, fx.LABEL_MISSING_WORDS),
            fx.LABEL_MISSING,
        ),
        ((intent == "returns_refunds") & every(fx.LABEL_CASHBACK_WORDS), fx.LABEL_CASHBACK),
    ]
    no = [(intent == name, reason) for name, reason in fx.LABEL_AUTO]
    label = lambda value, reason: F.struct(F.lit(value).alias("escalate"), F.lit(reason).alias("reason"))
    out = label(False, fx.LABEL_DEFAULT)
    for applies, reason in reversed(no):
        out = F.when(applies, label(False, reason)).otherwise(out)
    for applies, reason in reversed(yes):
        out = F.when(applies, label(True, reason)).otherwise(out)
    return out
