"""Table assertions: each returns one row per rule with the number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions import text as tx
from parley.operators.taxonomy import INTENT_NAMES, MANDATORY

REQUIRED = [
    "id",
    "message_text",
    "turn_index",
    "thread_context",
    "true_intent",
    "true_escalate",
    "escalate_reason",
    "difficulty",
    "review_status",
]


def _violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rules in one pass over the table. A rule that is null counts as broken."""
    counted = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = ", ".join(f"'{name}', {name}" for name in rules)
    return counted.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, violations)")


def gold_schema(gold: DataFrame) -> DataFrame:
    filled = lambda c: F.length(tx.strip(F.col(c))) > 0
    return _violations(
        gold,
        {
            "required_fields": reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED]),
            "id_prefix": F.col("id").startswith("GOLDEN_"),
            "message_text": filled("message_text"),
            "escalate_reason": F.length("escalate_reason") > 0,
            "true_intent": F.col("true_intent").isin(INTENT_NAMES),
            "difficulty": F.col("difficulty").isin(fx.TIERS),
            "review_status": F.col("review_status").isin(fx.REVIEW_STATES),
        },
    )


def gold_balance(gold: DataFrame, rows: int = 200, edge: int = 100, low: int = 40, high: int = 90) -> DataFrame:
    return gold.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("difficulty") != "routine").alias("edge_rows"),
        F.count_if("true_escalate").alias("escalations"),
    ).select(
        "*",
        (F.col("rows") == rows).alias("rows_ok"),
        (F.col("edge_rows") >= edge).alias("edge_ok"),
        F.col("escalations").between(low, high).alias("escalations_ok"),
    )


def safety_labels(gold: DataFrame) -> DataFrame:
    """Rows that must escalate by intent or tier but are not labelled so. Expected to be empty."""
    must = F.col("true_intent").isin(MANDATORY) | F.col("difficulty").isin("high_risk", "angry_profane")
    return gold.where(must & ~F.coalesce("true_escalate", F.lit(False)))


def confusion_total(confusion: DataFrame, rows: DataFrame) -> DataFrame:
    """Confusion cells against the number of rows."""
    cells = confusion.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"))
    return cells.withColumn("rows", rows.agg(F.count("*")).scalar()).withColumn("ok", F.col("cells") == F.col("rows"))


def taxonomy_complete(dim: DataFrame) -> DataFrame:
    filled = lambda c: F.length(F.col(c)) > 0
    return _violations(
        dim,
        {
            "name": filled("name"),
            "description": filled("description"),
            "resolution_guidance": filled("resolution_guidance"),
            "example_queries": F.size("example_queries") >= 3,
        },
    )


def missing_fields(json_rows: DataFrame, column: str = "value", required: list[str] = REQUIRED) -> DataFrame:
    """Required keys that a JSON record lacks."""
    keys = F.coalesce(F.json_object_keys(F.col(column)), F.array().cast("array<string>"))
    need = F.array(*[F.lit(k) for k in required])
    return json_rows.withColumn("missing", F.array_except(need, keys))
