"""Plan of the pattern pack."""

from __future__ import annotations

from parley.operators.intents import heuristic_intent


def test_pattern_tests_stay_out_of_whole_stage_code(spark):
    """In one generated method they are too large for the JVM's compiler."""
    texts = spark.range(3).selectExpr("concat('where is my parcel ', id) AS text")
    plan = heuristic_intent(texts, "text")._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "RLIKE" in line]
    assert lines and not any("*(" in line.split("Project")[0] for line in lines)
