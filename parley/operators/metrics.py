"""Evaluation metrics over rows of gold and predicted labels.

Input columns: id, true_intent, predicted_intent, true_escalate, predicted_escalate, difficulty.
Every job takes optional `by` columns, so several systems are measured in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions.rates import f1, ratio, rounded
from parley.operators.taxonomy import INTENT_NAMES
from parley.operators.topn import running_sums


def _expected() -> Column:
    return F.coalesce("true_escalate", F.lit(False))


def _predicted() -> Column:
    return F.coalesce("predicted_escalate", F.lit(False))


def gold_vs_pred(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return gold.join(pred, "id")


def escalation_category(expected: Column, predicted: Column) -> Column:
    return (
        F.when(expected & predicted, "TRUE_ESCALATE")
        .when(~expected & ~predicted, "TRUE_AUTO")
        .when(~expected & predicted, "FALSE_ESCALATE")
        .otherwise("FALSE_AUTO_HANDLE_CRITICAL")
    )


def confusion_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("true_intent").eqNullSafe(F.col("predicted_intent"))).alias("intent_correct"),
        F.count_if(_expected() & _predicted()).alias("tp"),
        F.count_if(~_expected() & _predicted()).alias("fp"),
        F.count_if(~_expected() & ~_predicted()).alias("tn"),
        F.count_if(_expected() & ~_predicted()).alias("fn"),
    )


def escalation_rates(rows: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall, and the rates of false and missed escalations."""
    tp, fp, tn, fn, total = (F.col(c) for c in ("tp", "fp", "tn", "fn", "total"))
    rates = {
        "intent_accuracy": ratio(F.col("intent_correct"), total),
        "escalation_accuracy": ratio(tp + tn, total),
        "escalation_precision": ratio(tp, tp + fp),
        "escalation_recall": ratio(tp, tp + fn),
        "false_escalation_rate": ratio(fp, tn + fp),
        "missed_escalation_rate": ratio(fn, tp + fn),
    }
    return confusion_counts(rows, by).select(
        *(by or []), "total", "tp", "fp", "tn", "fn", *[rounded(v, digits).alias(k) for k, v in rates.items()]
    )


def intent_confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every true and predicted intent pair with its count; unknown labels are left out."""
    keys = by or []
    cells = rows.groupBy(*keys, "true_intent", "predicted_intent").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(n) for n in INTENT_NAMES])
    groups = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    grid = groups.select(*keys, F.explode(names).alias("true_intent")).select(
        "*", F.explode(names).alias("predicted_intent")
    )
    return grid.join(cells, [*keys, "true_intent", "predicted_intent"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def per_intent(rows: DataFrame, by: list[str] | None = None, all_classes: bool = True) -> DataFrame:
    """Precision, recall, F1 and support per intent; all twelve intents or only those observed."""
    keys = by or []
    cells = rows.groupBy(*keys, "true_intent", "predicted_intent").agg(F.count("*").alias("n"))
    hit = F.col("true_intent").eqNullSafe(F.col("predicted_intent"))
    zero = F.lit(0).cast("long")
    # The cells are already counted, so two small rows per cell cover both sides.
    sides = cells.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.col("true_intent").alias("intent"),
                    F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
                    zero.alias("fp"),
                    F.when(~hit, F.col("n")).otherwise(zero).alias("fn"),
                    F.col("n").alias("support"),
                ),
                F.struct(
                    F.col("predicted_intent").alias("intent"),
                    zero.alias("tp"),
                    F.when(~hit, F.col("n")).otherwise(zero).alias("fp"),
                    zero.alias("fn"),
                    zero.alias("support"),
                ),
            )
        ).alias("s"),
    ).select(*keys, "s.*")
    sides = sides.where(F.coalesce("intent", F.lit("")) != "")
    if all_classes:
        names = F.array(*[F.lit(n) for n in INTENT_NAMES])
        groups = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
        empty = groups.select(
            *keys, F.explode(names).alias("intent"), *[zero.alias(c) for c in ("tp", "fp", "fn", "support")]
        )
        sides = sides.where(F.col("intent").isin(INTENT_NAMES)).unionByName(empty)
    sums = sides.groupBy(*keys, "intent").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        *keys,
        "intent",
        rounded(p, 4).alias("precision"),
        rounded(r, 4).alias("recall"),
        rounded(f1(p, r), 4).alias("f1"),
        "support",
    )


def macro_average(per_class: DataFrame, by: list[str] | None = None) -> DataFrame:
    return per_class.groupBy(*(by or [])).agg(
        *[rounded(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    )


def tier_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    tier = F.coalesce("difficulty", F.lit("routine")).alias("difficulty")
    right = F.col("true_intent").eqNullSafe(F.col("predicted_intent")).cast("double")
    return rows.groupBy(*(by or []), tier).agg(
        F.count("*").alias("count"),
        rounded(F.avg(right), 4).alias("intent_accuracy"),
        rounded(F.avg((_expected() == _predicted()).cast("double")), 4).alias("escalation_accuracy"),
        F.count_if(_expected() & ~_predicted()).alias("missed_escalations"),
    )


def grounding_hit_rate(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of rows with an expected document among the retrieved; no expectation counts as a hit."""
    none = F.coalesce(F.size("expected_doc_ids"), F.lit(0)) <= 0
    hit = F.when(none, 1.0).when(F.arrays_overlap("expected_doc_ids", "retrieved_doc_ids"), 1.0).otherwise(0.0)
    return rows.groupBy(*(by or [])).agg(rounded(F.coalesce(F.avg(hit), F.lit(0.0)), 4).alias("grounding_hit_rate"))


def failure_cases(rows: DataFrame) -> DataFrame:
    """Rows with a wrong intent or escalation. Kept as rows; the id list is for small sets only."""
    wrong_intent = ~F.col("true_intent").eqNullSafe(F.col("predicted_intent"))
    wrong_escalation = _expected() != _predicted()
    return rows.where(wrong_intent | wrong_escalation).select(
        "id", wrong_intent.alias("wrong_intent"), wrong_escalation.alias("wrong_escalation")
    )


def failing_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """position (from 1), id, n_failures: ids with a wrong intent or escalation in input order, and their number."""
    wrong = failure_cases(rows).select("id")
    failing = rows.select("id", *[c for c in order if c != "id"]).join(wrong, "id", "left_semi")
    return running_sums(failing, order, {}, total="n_failures").select("position", "id", "n_failures")


def running_accuracy(rows: DataFrame, order: list[str], every: int = 25) -> DataFrame:
    """Cumulative accuracies and missed escalations after every n-th row and the last."""
    sums = running_sums(
        rows.select(*order, "true_intent", "predicted_intent", "true_escalate", "predicted_escalate"),
        order,
        {
            "hits": F.col("true_intent").eqNullSafe(F.col("predicted_intent")).cast("long"),
            "right": (_expected() == _predicted()).cast("long"),
            "missed": (_expected() & ~_predicted()).cast("long"),
        },
        total="_total",
    )
    return sums.where((F.col("position") % every == 0) | (F.col("position") == F.col("_total"))).select(
        "position",
        rounded(F.col("hits") / F.col("position"), 4).alias("intent_accuracy"),
        rounded(F.col("right") / F.col("position"), 4).alias("escalation_accuracy"),
        "missed",
    )


def safety_assessment(missed: Column) -> Column:
    return F.when(missed == 0, F.lit(fx.SAFETY_PASS)).otherwise(F.format_string(fx.SAFETY_FAIL, missed))


def scorecard(candidate: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Metric by system with the candidate's lead over the keyword baseline.

    Both inputs come from escalation_rates; baselines carry a `system` column. Absent runs use the fixed entries.
    """
    names = {
        "intent_accuracy": "intent_accuracy",
        "escalation_accuracy": "escalation_accuracy",
        "false_auto_handle_rate": "missed_escalation_rate",
        "false_escalation_rate": "false_escalation_rate",
    }

    def tall(df: DataFrame, *keys: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).alias("value")) for k, c in names.items()])
        return df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.metric", "e.value")

    spark = candidate.sparkSession
    out = spark.createDataFrame(fx.SCORECARD_DEFAULTS, "metric string, always double, keyword double")
    if baselines is not None:
        wide = tall(baselines, "system").groupBy("metric").agg(
            F.max(F.when(F.col("system") == "trivial_always_escalate", F.col("value"))).alias("_a"),
            F.max(F.when(F.col("system") == "simple_keyword_baseline", F.col("value"))).alias("_k"),
        )
        out = out.join(wide, "metric", "left").select(
            "metric", F.coalesce("_a", "always").alias("always"), F.coalesce("_k", "keyword").alias("keyword")
        )
    return out.join(tall(candidate), "metric", "left").select(
        "metric",
        F.col("always").alias("trivial_always_escalate"),
        F.col("keyword").alias("simple_keyword_baseline"),
        F.col("value").alias("production"),
        rounded(F.col("value") - F.col("keyword"), 4).alias("delta"),
    )
