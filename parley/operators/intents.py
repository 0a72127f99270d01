"""Intent scoring from the pattern pack, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.fixed.intent_patterns import INTENT_PATTERNS, SAFETY_OVERRIDES
from parley.functions import text as tx
from parley.functions.prefilter import fold
from parley.functions.rates import rounded
from parley.functions.seal import with_sealed
from parley.operators.taxonomy import INTENT_NAMES, OTHER

PREDICTION = ["intent", "confidence", "is_ambiguous", "margin", "explanation", "probabilities"]


def pattern_mask(text: str, folded: str) -> Column:
    """One bit per pattern of the pack; every pattern is searched at most once per text.

    As one method of whole-stage code the tests are larger than what the JVM compiles, and would run byte code by byte
    code. A function over an array keeps the projection out of it, so that its code is cut into small methods.
    """
    bits = (
        f"CASE WHEN {tx.has_sql(text, pattern, folded)} THEN {1 << i}L ELSE 0L END"
        for i, (_, pattern, _) in enumerate(INTENT_PATTERNS)
    )
    return F.expr(f"CASE WHEN exists(array({folded}), x -> x IS NULL) THEN 0L ELSE {' | '.join(bits)} END")


def _score(intent: str) -> str:
    """Highest weight among the matched patterns of an intent, or the base score."""
    weights = sorted({w for name, _, w in INTENT_PATTERNS if name == intent}, reverse=True)
    cases = []
    for weight in weights:
        bits = sum(1 << i for i, (name, _, w) in enumerate(INTENT_PATTERNS) if name == intent and w == weight)
        cases.append(f"WHEN (_mask & {bits}L) != 0 THEN {weight}D")
    return f"CASE {' '.join(cases)} ELSE {fx.BASE_SCORE}D END" if cases else f"{fx.BASE_SCORE}D"


def heuristic_intent(
    df: DataFrame, text: str, margin_threshold: float = fx.AMBIGUITY_MARGIN, probabilities: bool = True
) -> DataFrame:
    """Add the prediction columns for a text column, with or without the map of all class probabilities.

    Probabilities are rounded before they are ranked; equal ones keep the intent order.
    """
    own = df.columns
    scored = df.select(*own, tx.strip(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    scored = scored.select("*", fold(F.col("_text")).alias("_folded"))
    scored = scored.select(*own, pattern_mask("_text", "_folded").alias("_mask"))
    scored = scored.selectExpr("*", f"array({', '.join(_score(name) for name in INTENT_NAMES)}) AS _scores")
    scored = scored.selectExpr("*", "aggregate(_scores, 0D, (a, s) -> a + s) AS _total")
    scored = scored.selectExpr("*", "transform(_scores, s -> floor(s / _total * 10000D + 0.5D) / 10000D) AS _p")
    # The first place of the highest value, and the highest of the other values.
    scored = scored.selectExpr("*", "CAST(array_position(_p, array_max(_p)) AS INT) AS _at")
    others = "transform(_p, (p, i) -> CASE WHEN _at != i + 1 THEN p END)"
    scored = scored.selectExpr("*", "_p[_at - 1] AS _top", f"array_max({others}) AS _second")
    matched = F.col("_mask") != 0
    margin = rounded(F.col("_top") - F.col("_second"), 4)
    names = tx.literals(INTENT_NAMES)
    notes = ", ".join(
        f"CASE WHEN (_mask & {1 << i}L) != 0 THEN 'Matched {name} ({weight:.2f})' END"
        for i, (name, _, weight) in enumerate(INTENT_PATTERNS)
    )
    reasons = F.expr(f"array_compact(array({notes}))")
    columns = {
        "intent": F.when(matched, F.expr(f"{names}[_at - 1]")).otherwise(F.lit(OTHER)),
        "confidence": F.when(matched, F.expr("floor(_scores[_at - 1] * 100D + 0.5D) / 100D")).otherwise(F.lit(fx.FALLBACK_CONFIDENCE)),
        "is_ambiguous": ~matched | ((margin < margin_threshold) & (F.col("_top") < fx.AMBIGUITY_TOP)),
        "margin": margin,
        "explanation": F.when(matched, F.array_join(F.slice(reasons, 1, 3), "; ")).otherwise(F.lit(fx.NO_MATCH)),
    }
    if probabilities:
        columns["probabilities"] = F.expr(f"map_from_arrays({names}, _p)")
    return with_sealed(scored, own, **columns)


def _override(text: Column) -> Column:
    """Intent of the first safety pattern that matches, or null."""
    out = F.lit(None).cast("string")
    for intent, pattern in reversed(SAFETY_OVERRIDES):
        out = F.when(tx.has(text, pattern), F.lit(intent)).otherwise(out)
    return out


def hybrid_intent(df: DataFrame, text: str) -> DataFrame:
    """Safety patterns first, then the pattern pack."""
    flagged = heuristic_intent(df.withColumn("_safety", _override(F.col(text))), text)
    safety = F.col("_safety")
    pick = lambda value, name: F.when(safety.isNotNull(), value).otherwise(F.col(name))
    return with_sealed(
        flagged,
        df.columns,
        intent=F.coalesce(safety, F.col("intent")),
        confidence=pick(F.lit(fx.OVERRIDE_CONFIDENCE), "confidence"),
        is_ambiguous=pick(F.lit(False), "is_ambiguous"),
        margin=pick(F.lit(fx.OVERRIDE_MARGIN), "margin"),
        explanation=pick(F.concat(F.lit(fx.OVERRIDE_TEXT), safety), "explanation"),
        probabilities=pick(
            F.create_map(F.coalesce(safety, F.lit("")), F.lit(fx.OVERRIDE_CONFIDENCE)), "probabilities"
        ),
    )


def parse_model_intent(df: DataFrame, text: str, response: str) -> DataFrame:
    """Prediction columns from recorded model answers; unreadable answers use the pattern pack."""
    schema = "predicted_category string, confidence string, probabilities map<string,string>, rationale string"
    base = heuristic_intent(df, text)
    answer = F.from_json(F.coalesce(F.col(response), F.lit("{}")), schema, {"mode": "PERMISSIVE"})
    probs = F.col("_probs")
    known = F.array(*[F.lit(n) for n in INTENT_NAMES])
    # Readable: a JSON object whose numbers are numbers.
    is_object = F.try_parse_json(F.coalesce(F.col(response), F.lit("{}"))).isNotNull() & F.trim(
        F.coalesce(F.col(response), F.lit("{}"))
    ).startswith("{")
    parsed = base.withColumn("_a", answer)
    number_ok = F.col("_a.confidence").isNull() | F.col("_a.confidence").try_cast("double").isNotNull()
    parsed = parsed.withColumn(
        "_p",
        F.transform_values(
            F.map_filter(
                F.coalesce(F.col("_a.probabilities"), F.create_map().cast("map<string,string>")),
                lambda k, v: F.array_contains(known, k),
            ),
            lambda k, v: v.try_cast("double"),
        ),
    )
    probs_ok = ~F.exists(F.map_values("_p"), lambda v: v.isNull())
    parsed = parsed.withColumn("_ok", is_object & F.col("_a").isNotNull() & number_ok & probs_ok)
    code = F.coalesce(F.col("_a.predicted_category"), F.lit(OTHER))
    parsed = parsed.withColumn("_code", F.when(code.isin(INTENT_NAMES), code).otherwise(F.lit(OTHER)))
    parsed = parsed.withColumn("_conf", F.coalesce(F.col("_a.confidence").try_cast("double"), F.lit(0.70)))
    parsed = parsed.withColumn(
        "_probs",
        F.when(F.array_contains(F.map_keys("_p"), F.col("_code")), F.col("_p")).otherwise(
            F.map_concat(F.col("_p"), F.create_map("_code", "_conf"))
        ),
    )
    down = F.sort_array(F.map_values(probs), asc=False)
    margin = F.when(F.size(down) > 1, down[0] - down[1]).otherwise(F.lit(1.0))
    parsed = parsed.withColumn("_margin", margin)
    ok = F.col("_ok")
    return parsed.select(
        *df.columns,
        F.when(ok, F.col("_code")).otherwise(F.col("intent")).alias("intent"),
        F.when(ok, F.col("_conf")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(ok, F.col("_margin") < fx.AMBIGUITY_MARGIN).otherwise(F.col("is_ambiguous")).alias("is_ambiguous"),
        F.when(ok, F.col("_margin")).otherwise(F.col("margin")).alias("margin"),
        F.when(ok, F.col("_a.rationale")).otherwise(F.col("explanation")).alias("explanation"),
        F.when(ok, probs).otherwise(F.col("probabilities")).alias("probabilities"),
    )
