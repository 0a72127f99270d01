"""Fixed-answer and keyword baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.fixed.baseline_rules import BASELINE_RULES, HANDOFF_INTENTS, HANDOFF_WORDS, REPLY_TEMPLATES
from parley.functions import text as tx
from parley.functions.prefilter import fold
from parley.functions.rates import rounded
from parley.functions.seal import with_sealed
from parley.operators.taxonomy import OTHER


def keyword_intent(text: str, folded: str) -> Column:
    """First rule group with a match, in rule order."""
    cases = (
        f"WHEN {' OR '.join(tx.has_sql(text, p, folded) for p in patterns)} THEN '{intent}'"
        for intent, patterns in BASELINE_RULES
    )
    return F.expr(f"CASE {' '.join(cases)} ELSE '{OTHER}' END")


def keyword_escalation(df: DataFrame, text: str, intent: str = "predicted_intent") -> DataFrame:
    """Add the handoff decision and its reason."""
    risky = F.col(intent).isin(HANDOFF_INTENTS)
    flagged = df.withColumn("_words", tx.has(F.col(text), HANDOFF_WORDS))
    return (
        flagged.withColumn("predicted_escalate", risky | F.col("_words"))
        .withColumn(
            "escalation_reason",
            F.when(risky, F.format_string(fx.KEYWORD_REASON_INTENT, intent))
            .when(F.col("_words"), F.lit(fx.KEYWORD_REASON_WORDS))
            .otherwise(F.lit(fx.KEYWORD_REASON_AUTO)),
        )
        .drop("_words")
    )


def keyword_reply(intent: Column, escalated: Column) -> Column:
    """Handoff text, or the template of the intent."""
    out = F.lit(REPLY_TEMPLATES[OTHER])
    for name, template in REPLY_TEMPLATES.items():
        out = F.when(intent == name, F.lit(template)).otherwise(out)
    return F.when(escalated, F.lit(fx.KEYWORD_HANDOFF_REPLY)).otherwise(out)


def keyword_baseline(df: DataFrame, text: str) -> DataFrame:
    folded = df.withColumn("_folded", fold(F.col(text)))
    intent = keyword_intent(text, "_folded")
    out = keyword_escalation(with_sealed(folded, df.columns, predicted_intent=intent), text)
    return out.withColumn("response", keyword_reply(F.col("predicted_intent"), F.col("predicted_escalate")))


def majority_class(gold: DataFrame, order: str = "id") -> DataFrame:
    """Most frequent true intent with its share; a tie goes to the intent seen first."""
    counts = gold.groupBy("true_intent").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    # One row per intent: the counts hold the total, so gold is read once.
    whole = counts.agg(F.sum("n").alias("total"), F.max("n").alias("n"))
    first = counts.join(F.broadcast(whole), "n").orderBy("_first").limit(1)
    return first.select("true_intent", "n", rounded(F.col("n") / F.col("total"), 4).alias("share"))


def fixed_baseline(df: DataFrame, majority: DataFrame, always: bool) -> DataFrame:
    """The majority intent and one fixed decision for every row. `majority` has one row."""
    return (
        df.withColumn("predicted_intent", majority.select("true_intent").scalar())
        .withColumn("predicted_escalate", F.lit(always))
        .withColumn("escalation_reason", F.lit(fx.ALWAYS_REASON if always else fx.NEVER_REASON))
        .withColumn("response", F.lit(fx.ALWAYS_REPLY if always else fx.NEVER_REPLY))
    )


def baseline_runs(gold: DataFrame) -> DataFrame:
    """All three baseline runs over the gold rows, told apart by `system`."""
    keep = ["system", *gold.columns, "predicted_intent", "predicted_escalate"]
    majority = majority_class(gold)
    keyed = keyword_baseline(gold, "message_text")
    top = majority.select("true_intent").scalar()
    # One pass over gold; each row becomes three.
    run = lambda system, intent, escalate: F.struct(
        F.lit(system).alias("system"), intent.alias("predicted_intent"), escalate.alias("predicted_escalate")
    )
    runs = F.array(
        run("trivial_always_escalate", top, F.lit(True)),
        run("trivial_never_escalate", top, F.lit(False)),
        run("simple_keyword_baseline", F.col("predicted_intent"), F.col("predicted_escalate")),
    )
    return keyed.select(*gold.columns, F.explode(runs).alias("_run")).select("_run.*", *gold.columns).select(keep)
