"""Queries on evaluation metrics, the rubric, and rater agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.operators import agreement, baselines, judge, metrics
from parley.operators.taxonomy import INTENT_NAMES, taxonomy_dim
from parley.plans import evaluate as plan
from parley.workload import seeds
from parley.workload import sql as s
from parley.workload.label_queries import _MAJORITY, KEYWORD_RUN, keyword_run
from parley.workload.registry import query
from parley.workload.search_queries import store_index, triage_ctes

_ONE = KEYWORD_RUN
_RUNS = KEYWORD_RUN + [
    ("top", _MAJORITY),
    (
        "runs",
        "SELECT 'simple_keyword_baseline' AS system, id, true_intent, predicted_intent, true_escalate, predicted_escalate, difficulty FROM base "
        "UNION ALL SELECT 'trivial_always_escalate', id, true_intent, (SELECT true_intent FROM top), true_escalate, TRUE, difficulty FROM base "
        "UNION ALL SELECT 'trivial_never_escalate', id, true_intent, (SELECT true_intent FROM top), true_escalate, FALSE, difficulty FROM base",
    ),
]


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b})::DOUBLE ELSE 0 END"


COUNTS = (
    "count(*) AS total, count(*) FILTER (true_intent = predicted_intent) AS hit, count(*) FILTER (true_escalate AND predicted_escalate) AS tp, "
    "count(*) FILTER (NOT true_escalate AND predicted_escalate) AS fp, count(*) FILTER (NOT true_escalate AND NOT predicted_escalate) AS tn, "
    "count(*) FILTER (true_escalate AND NOT predicted_escalate) AS fn"
)
RATES = {
    "intent_accuracy": _div("hit", "total"),
    "escalation_accuracy": _div("tp + tn", "total"),
    "escalation_precision": _div("tp", "(tp + fp)"),
    "escalation_recall": _div("tp", "(tp + fn)"),
    "false_escalation_rate": _div("fp", "(tn + fp)"),
    "missed_escalation_rate": _div("fn", "(tp + fn)"),
}


def rates_sql(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return (
        f"SELECT {lead}total, tp, fp, tn, fn, "
        + ", ".join(f"round({v}, 4) AS {k}" for k, v in RATES.items())
        + f" FROM (SELECT {lead}{COUNTS} FROM {source}{f' GROUP BY {by}' if by else ''})"
    )


@query("baseline_eval", s.with_(_RUNS, rates_sql("runs", "system")))
def _(spark, sf):
    return metrics.escalation_rates(baselines.baseline_runs(seeds.gold(spark, sf)), ["system"])


@query("escalation_rates", s.with_(_ONE, rates_sql("base")))
def _(spark, sf):
    return metrics.escalation_rates(keyword_run(spark, sf))


@query("escalation_confusion", s.with_(_ONE, f"SELECT total, hit AS intent_correct, tp, fp, tn, fn FROM (SELECT {COUNTS} FROM base)"))
def _(spark, sf):
    return metrics.confusion_counts(keyword_run(spark, sf))


_CATEGORY = (
    "CASE WHEN true_escalate AND predicted_escalate THEN 'TRUE_ESCALATE' WHEN NOT true_escalate AND NOT predicted_escalate THEN 'TRUE_AUTO' "
    "WHEN predicted_escalate THEN 'FALSE_ESCALATE' ELSE 'FALSE_AUTO_HANDLE_CRITICAL' END"
)


@query("escalation_category", s.with_(_ONE, f"SELECT id, {_CATEGORY} AS escalation_category FROM base"))
def _(spark, sf):
    c = metrics.escalation_category(F.col("true_escalate"), F.col("predicted_escalate"))
    return keyword_run(spark, sf).select("id", c.alias("escalation_category"))


_GRID = f"SELECT t, p FROM (SELECT unnest({s.listing(INTENT_NAMES)}) AS t), (SELECT unnest({s.listing(INTENT_NAMES)}) AS p)"


@query(
    "intent_confusion_matrix",
    s.with_(_ONE, f"SELECT t AS true_intent, p AS predicted_intent, count(id) AS n FROM ({_GRID}) LEFT JOIN base ON t = true_intent AND p = predicted_intent GROUP BY ALL"),
)
def _(spark, sf):
    return metrics.intent_confusion(keyword_run(spark, sf))


def prf_sql(source: str) -> str:
    p, r = _div("tp", "(tp + fp)"), _div("tp", "(tp + fn)")
    f = f"CASE WHEN {p} + {r} > 0 THEN 2 * ({p}) * ({r}) / ({p} + {r}) ELSE 0 END"
    return (
        f"SELECT intent, round({p}, 4) AS precision, round({r}, 4) AS recall, round({f}, 4) AS f1, support FROM ("
        f"SELECT intent, count(*) FILTER (true_intent = intent AND predicted_intent = intent) AS tp, count(*) FILTER (true_intent <> intent AND predicted_intent = intent) AS fp, "
        f"count(*) FILTER (true_intent = intent AND predicted_intent <> intent) AS fn, count(*) FILTER (true_intent = intent) AS support "
        f"FROM (SELECT unnest({s.listing(INTENT_NAMES)}) AS intent), {source} GROUP BY intent)"
    )


@query("per_intent_prf", s.with_(_ONE, prf_sql("base")))
def _(spark, sf):
    return metrics.per_intent(keyword_run(spark, sf))


@query(
    "macro_prf",
    s.with_(_ONE, f"SELECT round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1 FROM ({prf_sql('base')})"),
)
def _(spark, sf):
    return metrics.macro_average(metrics.per_intent(keyword_run(spark, sf)))


def tier_sql(source: str) -> str:
    return (
        "SELECT coalesce(difficulty, 'routine') AS difficulty, count(*) AS count, round(avg((true_intent = predicted_intent)::INT), 4) AS intent_accuracy, "
        "round(avg((true_escalate = predicted_escalate)::INT), 4) AS escalation_accuracy, count(*) FILTER (true_escalate AND NOT predicted_escalate) AS missed_escalations "
        f"FROM {source} GROUP BY 1"
    )


@query("tier_metrics", s.with_(_ONE, tier_sql("base")))
def _(spark, sf):
    return metrics.tier_metrics(keyword_run(spark, sf))


@query(
    "grounding_hit_rate",
    s.with_(_ONE, "SELECT round(avg(CASE WHEN difficulty = 'low_signal' OR true_intent = predicted_intent THEN 1 ELSE 0 END), 4) AS grounding_hit_rate FROM base"),
)
def _(spark, sf):
    rows = keyword_run(spark, sf).select(
        F.when(F.col("difficulty") == "low_signal", F.array().cast("array<string>")).otherwise(F.array("true_intent")).alias("expected_doc_ids"),
        F.array(F.lit("another"), "predicted_intent").alias("retrieved_doc_ids"),
    )
    return metrics.grounding_hit_rate(rows)


@query(
    "failure_cases",
    s.with_(
        _ONE,
        "SELECT id, true_intent <> predicted_intent AS wrong_intent, true_escalate <> predicted_escalate AS wrong_escalation FROM base WHERE true_intent <> predicted_intent OR true_escalate <> predicted_escalate",
    ),
)
def _(spark, sf):
    return metrics.failure_cases(keyword_run(spark, sf))


@query(
    "running_accuracy",
    s.with_(
        _ONE,
        "SELECT position, round(h / position::DOUBLE, 4) AS intent_accuracy, round(r / position::DOUBLE, 4) AS escalation_accuracy, missed FROM ("
        "SELECT row_number() OVER w AS position, sum((true_intent = predicted_intent)::INT) OVER w AS h, sum((true_escalate = predicted_escalate)::INT) OVER w AS r, "
        "(sum((true_escalate AND NOT predicted_escalate)::INT) OVER w)::BIGINT AS missed FROM base WINDOW w AS (ORDER BY id ROWS UNBOUNDED PRECEDING)) "
        "WHERE position % 25 = 0 OR position = (SELECT count(*) FROM base)",
    ),
)
def _(spark, sf):
    return metrics.running_accuracy(keyword_run(spark, sf), ["id"])


@query(
    "safety_assessment",
    s.with_(
        _RUNS,
        f"SELECT system, CASE WHEN fn = 0 THEN {s.q(fx.SAFETY_PASS)} ELSE 'FAIL: ' || fn || ' Critical False Auto-Handles detected' END AS safety_assessment FROM (SELECT system, {COUNTS} FROM runs GROUP BY system)",
    ),
)
def _(spark, sf):
    counts = metrics.confusion_counts(baselines.baseline_runs(seeds.gold(spark, sf)), ["system"])
    return counts.select("system", metrics.safety_assessment(F.col("fn")).alias("safety_assessment"))


_NAMES = [
    ("intent_accuracy", "intent_accuracy"),
    ("escalation_accuracy", "escalation_accuracy"),
    ("false_auto_handle_rate", "missed_escalation_rate"),
    ("false_escalation_rate", "false_escalation_rate"),
]


@query(
    "baseline_comparison",
    s.with_(
        _RUNS + [("r", rates_sql("runs", "system"))],
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, (SELECT {c} FROM r WHERE system = 'trivial_always_escalate') AS trivial_always_escalate, "
            f"(SELECT {c} FROM r WHERE system = 'simple_keyword_baseline') AS simple_keyword_baseline, (SELECT {c} FROM r WHERE system = 'trivial_never_escalate') AS production, "
            f"(SELECT round(max({c}) FILTER (system = 'trivial_never_escalate') - max({c}) FILTER (system = 'simple_keyword_baseline'), 4) FROM r) AS delta"
            for m, c in _NAMES
        ),
    ),
)
def _(spark, sf):
    rates = metrics.escalation_rates(baselines.baseline_runs(seeds.gold(spark, sf)), ["system"])
    return metrics.scorecard(rates.where("system = 'trivial_never_escalate'"), rates)


@query(
    "scorecard",
    s.with_(
        _ONE + [("r", rates_sql("base"))],
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, {a}::DOUBLE AS trivial_always_escalate, {k}::DOUBLE AS simple_keyword_baseline, {c} AS production, round({c} - {k}::DOUBLE, 4) AS delta FROM r"
            for (m, c), (_, a, k) in zip(_NAMES, fx.SCORECARD_DEFAULTS)
        ),
    ),
)
def _(spark, sf):
    return metrics.scorecard(metrics.escalation_rates(keyword_run(spark, sf)))


@query("gold_vs_pred", s.with_(_ONE, "SELECT id, true_intent, predicted_intent, true_escalate, predicted_escalate FROM base"))
def _(spark, sf):
    run = keyword_run(spark, sf)
    gold = run.select("id", "true_intent", "true_escalate")
    return metrics.gold_vs_pred(gold, run.select("id", "predicted_intent", "predicted_escalate"))


# Rubric ---------------------------------------------------------------------------


def judge_sql(query_col: str, context: str, reply: str, escalated: str, source: str) -> str:
    """Scored rows: source columns with the rubric's scores."""
    low = lambda c, w: f"contains(lower({c}), '{w}')"
    r = "jr"
    no_return = f"({low(query_col, 'return')} AND NOT {low(r, 'return')} AND NOT {low(r, 'orders')})"
    no_track = f"({low(query_col, 'track')} AND NOT {low(r, 'track')} AND NOT {low(r, 'http')})"
    notes = (
        f"list_filter(list_concat(list_transform(urls, lambda u: 'URL ''' || u || ''' not found in retrieved precedents.'), "
        f"list_transform(spans, lambda x: 'Timeframe ''' || x || ''' not explicitly stated in retrieved precedent.'), "
        f"[CASE WHEN {no_return} THEN {s.q(fx.CRITIQUE_RETURN)} END, CASE WHEN {no_track} THEN {s.q(fx.CRITIQUE_TRACK)} END]), lambda x: x IS NOT NULL)"
    )
    return (
        "SELECT *, round((grounding_score + correctness_score + tone_score + completeness_score) / 4.0::DOUBLE, 2) AS overall_score, "
        "(grounding_score >= 4 AND correctness_score >= 4 AND tone_score >= 3) AS passed FROM (SELECT *, "
        f"CASE WHEN NOT {escalated} AND (len(urls) > 0 OR len(spans) > 0) THEN 3 ELSE 5 END AS grounding_score, "
        f"CASE WHEN NOT {escalated} AND ({no_return} OR {no_track}) THEN 3 ELSE 5 END AS correctness_score, "
        f"CASE WHEN {escalated} THEN 5 WHEN length(jr) < 25 THEN 3 WHEN NOT {s.has('jr', fx.COURTESY_PATTERN)} THEN 4 ELSE 5 END AS tone_score, "
        f"CASE WHEN {escalated} THEN 5 WHEN {s.word_count('jr')} < 10 THEN 3 WHEN NOT contains(jr, 'http') AND ({low(query_col, 'link')} OR {low(query_col, 'where')}) THEN 4 ELSE 5 END AS completeness_score, "
        f"CASE WHEN {escalated} THEN {s.q(fx.CRITIQUE_ESCALATED)} WHEN len({notes}) > 0 THEN array_to_string({notes}, ' ') ELSE {s.q(fx.CRITIQUE_CLEAN)} END AS critique "
        f"FROM (SELECT *, list_filter(regexp_extract_all(jr, {s.q(fx.URL_PATTERN)}), lambda u: NOT contains({context}, u)) AS urls, "
        f"list_filter(regexp_extract_all(jr, {s.q(fx.TIME_SPAN_PATTERN)}, 1, 'i'), lambda x: NOT contains(lower({context}), lower(x))) AS spans "
        f"FROM (SELECT *, {s.strip(reply)} AS jr FROM {source})))"
    )


_RATED = _ONE + [
    "dim",
    ("rated", "SELECT base.*, resolution_guidance AS context FROM base JOIN dim ON intent = true_intent"),
    ("judged", judge_sql("message_text", "context", "reference_brand_reply", "predicted_escalate", "rated")),
]
_SCORES = ["grounding_score", "correctness_score", "tone_score", "completeness_score"]


def _rated(spark, sf):
    dim = taxonomy_dim(spark).select(F.col("category").alias("true_intent"), F.col("resolution_guidance").alias("context"))
    return keyword_run(spark, sf).join(F.broadcast(dim), "true_intent")


def _judged(spark, sf):
    return judge.judge_rubric(_rated(spark, sf), "message_text", "context", "reference_brand_reply", "predicted_escalate")


@query("judge_rubric", s.with_(_RATED, f"SELECT id, {', '.join(_SCORES)}, overall_score, passed, critique FROM judged"))
def _(spark, sf):
    return _judged(spark, sf).select("id", *_SCORES, "overall_score", "passed", "critique")


_SUMMARY = ", ".join(f"round(avg({c}), 2) AS mean_{c}" for c in [*_SCORES, "overall_score"]) + ", round(avg(passed::INT), 4) AS pass_rate, count(*) AS total_evaluated"


@query("judge_summary", s.with_(_RATED, f"SELECT {_SUMMARY} FROM judged"))
def _(spark, sf):
    return judge.judge_summary(_judged(spark, sf))


def _answer_sql() -> str:
    return (
        "CASE gk % 4 WHEN 0 THEN '{\"grounding_score\": 4, \"correctness_score\": 5, \"tone_score\": 2, \"completeness_score\": 3, \"critique\": \"curt\"}' "
        "WHEN 1 THEN '{\"grounding_score\": 3}' WHEN 2 THEN 'not json' ELSE '{}' END"
    )


def _answer_score(axis: str) -> str:
    return f"CASE WHEN gk % 4 = 2 THEN {axis} ELSE coalesce(json_extract(a, '$.{axis}')::INT, 4) END AS {axis}"


@query(
    "parse_llm_judge",
    s.with_(
        _RATED,
        f"SELECT id, {', '.join(_SCORES)}, round((grounding_score + correctness_score + tone_score + completeness_score) / 4.0::DOUBLE, 2) AS overall_score, "
        "(grounding_score >= 4 AND correctness_score >= 4 AND tone_score >= 3) AS passed, critique FROM (SELECT id, "
        + ", ".join(_answer_score(a) for a in _SCORES)
        + f", CASE WHEN gk % 4 = 2 THEN critique ELSE coalesce(json_extract_string(a, '$.critique'), {s.q(fx.CRITIQUE_MODEL)}) END AS critique "
        f"FROM (SELECT *, CASE WHEN gk % 4 <> 2 THEN ({_answer_sql()})::JSON END AS a FROM judged))",
    ),
)
def _(spark, sf):
    k = F.substring("id", 8, 9).cast("long") % 4
    answer = (
        F.when(k == 0, F.lit('{"grounding_score": 4, "correctness_score": 5, "tone_score": 2, "completeness_score": 3, "critique": "curt"}'))
        .when(k == 1, F.lit('{"grounding_score": 3}'))
        .when(k == 2, F.lit("not json"))
        .otherwise(F.lit("{}"))
    )
    rows = _rated(spark, sf).withColumn("answer", answer)
    out = judge.parse_judge(rows, "message_text", "context", "reference_brand_reply", "predicted_escalate", "answer")
    return out.select("id", *_SCORES, "overall_score", "passed", "critique")


_Q, _R, _P = "lower(message_text)", "lower(reference_brand_reply)", "lower(context)"
_OFF = f"((contains({_Q}, 'return') AND NOT contains({_R}, 'return')) OR (contains({_Q}, 'track') AND NOT contains({_R}, 'track') AND NOT contains({_R}, 'http')))"
_BRIEF = f"{s.word_count(_R)} < 12"
_HUMAN = (
    "human",
    "SELECT *, predicted_escalate OR (human_grounding_score >= 4 AND human_correctness_score >= 4) AS human_passed FROM (SELECT id, predicted_escalate, "
    f"CASE WHEN NOT predicted_escalate AND contains({_R}, 'http') AND NOT contains({_P}, 'http') THEN 3 ELSE 5 END AS human_grounding_score, "
    f"CASE WHEN predicted_escalate THEN 5 WHEN {_OFF} THEN 3 WHEN difficulty = 'ambiguous' THEN 4 ELSE 5 END AS human_correctness_score, 5 AS human_tone_score, "
    f"CASE WHEN predicted_escalate THEN 5 WHEN {_BRIEF} THEN 3 WHEN difficulty = 'multi_issue' THEN 4 ELSE 5 END AS human_completeness_score, "
    f"CASE WHEN predicted_escalate THEN {s.q(fx.NOTE_HANDOFF)} WHEN difficulty = 'ambiguous' AND NOT {_OFF} THEN {s.q(fx.NOTE_AMBIGUOUS)} "
    f"WHEN difficulty = 'multi_issue' AND NOT {_BRIEF} THEN {s.q(fx.NOTE_MULTI)} ELSE {s.q(fx.NOTE_CLEAN)} END AS human_notes FROM rated)",
)
_BOTH = _RATED + [_HUMAN]
_HUMAN_COLS = [f"human_{a}" for a in _SCORES] + ["human_passed", "human_notes"]


def _human(spark, sf):
    return agreement.reference_labels(
        _rated(spark, sf), "message_text", "reference_brand_reply", F.array("context"), "predicted_escalate", "difficulty"
    )


@query("reference_labels", s.with_(_BOTH, f"SELECT id, {', '.join(_HUMAN_COLS)} FROM human"))
def _(spark, sf):
    return _human(spark, sf).select("id", *_HUMAN_COLS)


def _ratings(spark, sf):
    human = _human(spark, sf).select(F.col("id").alias("sample_id"), *_HUMAN_COLS)
    scored = _judged(spark, sf).withColumnRenamed("id", "sample_id")
    # Rows of one tier have no judge rating, so that the defaults apply.
    return agreement.judge_vs_human(human, scored.where("difficulty <> 'low_signal'"))


_PAIR = (
    "ratings",
    "SELECT human.*, coalesce(j.passed, TRUE) AS judge_passed, j.critique AS judge_critique, "
    + ", ".join(f"coalesce(j.{a}, 4) AS judge_{a}" for a in _SCORES)
    + " FROM human LEFT JOIN (SELECT * FROM judged WHERE difficulty <> 'low_signal') j USING (id)",
)


@query("judge_vs_human", s.with_(_BOTH + [_PAIR], f"SELECT id AS sample_id, human_passed, judge_passed, {', '.join('judge_' + a for a in _SCORES)}, judge_critique FROM ratings"))
def _(spark, sf):
    return _ratings(spark, sf).select("sample_id", "human_passed", "judge_passed", *[f"judge_{a}" for a in _SCORES], "judge_critique")


def kappa_sql(a: str, b: str, source: str, errors: str = "", names: str = "") -> str:
    po = "(aa + dd) / n::DOUBLE"
    pe = "((aa + bb) / n::DOUBLE) * ((aa + cc) / n::DOUBLE) + ((cc + dd) / n::DOUBLE) * ((bb + dd) / n::DOUBLE)"
    label = "CASE " + " ".join(f"WHEN k >= {b_} THEN {s.q(t)}" for b_, t in fx.KAPPA_LABELS) + f" ELSE {s.q(fx.KAPPA_LOWEST)} END"
    return (
        f"SELECT n, round(po, 4) AS observed_agreement, round(pe, 4) AS expected_agreement, round(k, 4) AS kappa, {label} AS interpretation, aa AS both_passed, bb AS first_only, cc AS second_only, dd AS both_failed{names} "
        f"FROM (SELECT *, CASE WHEN 1 - pe <> 0 THEN (po - pe) / (1 - pe) ELSE 1 END AS k FROM (SELECT *, {po} AS po, {pe} AS pe FROM (SELECT count(*) AS n, count(*) FILTER ({a} AND {b}) AS aa, "
        f"count(*) FILTER ({a} AND NOT {b}) AS bb, count(*) FILTER (NOT {a} AND {b}) AS cc, count(*) FILTER (NOT {a} AND NOT {b}) AS dd{errors} FROM {source})))"
    )


_SHORT = {a: a.removesuffix("_score") + "_mae" for a in _SCORES}


@query(
    "rater_agreement",
    s.with_(
        _BOTH + [_PAIR],
        kappa_sql(
            "human_passed",
            "judge_passed",
            "ratings",
            "".join(f", round(avg(abs(human_{a} - judge_{a})), 3) AS {n}" for a, n in _SHORT.items()),
            "".join(f", {n}" for n in _SHORT.values()),
        ),
    ),
)
def _(spark, sf):
    return agreement.rater_agreement(_ratings(spark, sf))


@query("rater_agreement_labels", kappa_sql("(quality = 1)", "(toxic = 0)", "labels"))
def _(spark, sf):
    labels = seeds.table(spark, sf, "labels")
    return agreement.kappa(labels.select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b")), "a", "b")


@query(
    "rater_discrepancies",
    s.with_(_BOTH + [_PAIR], "SELECT id AS sample_id, human_passed, judge_passed, human_notes, judge_critique FROM ratings WHERE human_passed <> judge_passed"),
)
def _(spark, sf):
    return agreement.rater_discrepancies(_ratings(spark, sf))


_QUOTA = (
    "sample",
    f"SELECT * EXCLUDE (r, place), 'VAL_' || lpad((row_number() OVER (ORDER BY place, r))::VARCHAR, 3, '0') AS sample_id FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY id) AS r, "
    f"list_position({s.listing([t for t, _ in fx.VALIDATION_QUOTAS])}, difficulty) AS place FROM base) WHERE r <= ([{', '.join(str(n) for _, n in fx.VALIDATION_QUOTAS)}])[place]",
)


@query("validation_quota_sample", s.with_(_ONE + [_QUOTA], "SELECT sample_id, id, difficulty FROM sample"))
def _(spark, sf):
    return agreement.validation_sample(keyword_run(spark, sf)).select("sample_id", "id", "difficulty")


@query(
    "blind_export",
    s.with_(
        _ONE + [_QUOTA],
        "SELECT sample_id, id AS test_id, difficulty, message_text AS customer_query, thread_context, reference_brand_reply AS agent_response, predicted_escalate AS escalated, "
        "predicted_intent AS precedents, TRUE AS empty_form FROM sample",
    ),
)
def _(spark, sf):
    rows = keyword_run(spark, sf).select(
        "id",
        "difficulty",
        "message_text",
        "thread_context",
        F.col("reference_brand_reply").alias("draft_reply"),
        "predicted_escalate",
        F.col("escalation_reason").alias("escalate_reason"),
        F.array(F.struct(F.col("predicted_intent").alias("doc_id"), F.lit("c").alias("category"), F.lit("t").alias("content"))).alias("grounding_sources"),
    )
    out = agreement.blind_export(agreement.validation_sample(rows))
    return out.select(
        "sample_id",
        "test_id",
        "difficulty",
        "customer_query",
        "thread_context",
        "agent_response",
        "escalated",
        F.col("retrieved_precedents")[0]["doc_id"].alias("precedents"),
        (F.col("human_score_template.passed").isNull() & (F.col("human_score_template.notes") == "")).alias("empty_form"),
    )


# The whole evaluation ---------------------------------------------------------------

_EVAL = ["gold", triage_ctes("gold", "id", "message_text")] + [
    (
        "records",
        "SELECT g.id, g.difficulty, g.message_text, g.true_intent, g.true_escalate, t.intent AS predicted_intent, t.escalate AS predicted_escalate, t.draft_reply, "
        "array_to_string(list_transform(range(1, len(ids)::BIGINT + 1), lambda i: '[' || ids[i] || '] ' || contents[i]), chr(10)) AS context FROM gold g JOIN triaged t USING (id)",
    ),
    ("ejudged", judge_sql("message_text", "context", "draft_reply", "predicted_escalate", "records")),
]


_MACRO = ["macro_precision", "macro_recall", "macro_f1"]
_CELLS = f"SELECT t, p, count(id) AS n FROM ({_GRID}) LEFT JOIN records ON t = true_intent AND p = predicted_intent GROUP BY ALL"
_WRONG = {"wrong_intent": "true_intent <> predicted_intent", "wrong_escalation": "true_escalate <> predicted_escalate"}
_SYSTEMS = ["trivial_always_escalate", "simple_keyword_baseline", "production", "delta"]


def _scorecard_rows() -> list[str]:
    """Metric by system, from the rates of the records (r) and of the baselines (b)."""
    rows = []
    for metric, column in _NAMES:
        one = f"(SELECT {column} FROM b WHERE system = '{{}}')"
        always, keyword = one.format("trivial_always_escalate"), one.format("simple_keyword_baseline")
        values = [always, keyword, column, f"round({column} - {keyword}, 4)"]
        rows += [f"SELECT 'scorecard', '{metric}', '{k}', ({v})::DOUBLE FROM r" for k, v in zip(_SYSTEMS, values)]
    return rows


@query(
    "evaluate",
    s.with_(
        _EVAL + _RUNS[1:] + [("r", rates_sql("records")), ("b", rates_sql("runs", "system"))],
        " UNION ALL ".join(
            [f"SELECT 'rates' AS scope, 'all' AS key, '{k}' AS metric, {k}::DOUBLE AS value FROM ({rates_sql('records')})" for k in ["tp", "fp", "tn", "fn", *RATES]]
            + [f"SELECT 'intent', intent, '{k}', {k}::DOUBLE FROM ({prf_sql('records')})" for k in ("precision", "recall", "f1", "support")]
            + [f"SELECT 'tier', difficulty, '{k}', {k}::DOUBLE FROM ({tier_sql('records')})" for k in ("count", "intent_accuracy", "escalation_accuracy", "missed_escalations")]
            + [
                f"SELECT 'judge', 'all', '{k}', {k}::DOUBLE FROM (SELECT {_SUMMARY} FROM ejudged)"
                for k in [f"mean_{a}" for a in [*_SCORES, "overall_score"]] + ["pass_rate", "total_evaluated"]
            ]
            + [f"SELECT 'macro', 'all', '{k}', round(avg({k.removeprefix('macro_')}), 4)::DOUBLE FROM ({prf_sql('records')})" for k in _MACRO]
            + [f"SELECT 'confusion', t || ' > ' || p, 'n', n::DOUBLE FROM ({_CELLS})"]
            + [f"SELECT 'failures', id, '{k}', ({v})::INT::DOUBLE FROM records WHERE {' OR '.join(_WRONG.values())}" for k, v in _WRONG.items()]
            + [f"SELECT 'safety', CASE WHEN fn = 0 THEN {s.q(fx.SAFETY_PASS)} ELSE 'FAIL: ' || fn || ' Critical False Auto-Handles detected' END, 'fn', fn::DOUBLE FROM r"]
            + [f"SELECT 'baseline', system, '{k}', {k}::DOUBLE FROM b" for k in ["tp", "fp", "tn", "fn", *RATES]]
            + _scorecard_rows()
        ),
    ),
)
def _(spark, sf):
    from parley.session import stage

    gold = seeds.gold(spark, sf)
    records = stage(plan.evaluated_records(gold, store_index(spark, sf)), "records")
    tables = plan.evaluate(records, gold)
    everything = F.lit("all")
    counts = ["tp", "fp", "tn", "fn", *RATES]
    judged = [f"mean_{a}" for a in [*_SCORES, "overall_score"]] + ["pass_rate", "total_evaluated"]
    tiers = ["count", "intent_accuracy", "escalation_accuracy", "missed_escalations"]
    safety = tables["safety"].withColumn("fn", tables["rates"].select("fn").scalar())
    return (
        _tall(tables["rates"], "rates", everything, counts)
        .unionByName(_tall(tables["per_intent"], "intent", F.col("intent"), ["precision", "recall", "f1", "support"]))
        .unionByName(_tall(tables["tiers"], "tier", F.col("difficulty"), tiers))
        .unionByName(_tall(tables["judge"], "judge", everything, judged))
        .unionByName(_tall(tables["macro"], "macro", everything, _MACRO))
        .unionByName(_tall(tables["confusion"], "confusion", F.concat("true_intent", F.lit(" > "), "predicted_intent"), ["n"]))
        .unionByName(_tall(tables["failures"], "failures", F.col("id"), list(_WRONG)))
        .unionByName(_tall(safety, "safety", F.col("safety_assessment"), ["fn"]))
        .unionByName(_tall(tables["baselines"], "baseline", F.col("system"), counts))
        .unionByName(_tall(tables["scorecard"], "scorecard", F.col("metric"), _SYSTEMS))
    )


def _tall(df, scope, key, names):
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(scope).alias("scope"), key.alias("key"), F.explode(entries).alias("e")).select("scope", "key", "e.metric", "e.value")


# The other scoring path: expected documents against retrieved ones, contents alone as context of the rubric.

_EXPECTED = "CASE WHEN difficulty = 'low_signal' THEN [] ELSE ['POLICY_' || upper(true_intent), 'REPLY_1'] END"
_GROUNDED = _EVAL[:2] + [
    (
        "records",
        "SELECT g.id, g.difficulty, g.message_text, g.true_intent, g.true_escalate, t.intent AS predicted_intent, t.escalate AS predicted_escalate, t.draft_reply, "
        f"{_EXPECTED} AS expected, ids, array_to_string(contents, chr(10)) AS context FROM gold g JOIN triaged t USING (id)",
    ),
    ("ejudged", judge_sql("message_text", "context", "draft_reply", "predicted_escalate", "records")),
    ("failing", f"SELECT id, row_number() OVER (ORDER BY id) AS position, count(*) OVER () AS n FROM records WHERE {' OR '.join(_WRONG.values())}"),
]


@query(
    "evaluate_grounded",
    s.with_(
        _GROUNDED,
        " UNION ALL ".join(
            [f"SELECT 'rates' AS scope, 'all' AS key, '{k}' AS metric, {k}::DOUBLE AS value FROM ({rates_sql('records')})" for k in ["tp", "fp", "tn", "fn", *RATES]]
            + ["SELECT 'rates', 'all', 'grounding_hit_rate', round(avg((len(expected) = 0 OR len(list_intersect(expected, ids)) > 0)::INT), 4)::DOUBLE FROM records"]
            + [f"SELECT 'judge', 'all', '{k}', {k}::DOUBLE FROM (SELECT {_SUMMARY} FROM ejudged)" for k in [f"mean_{a}" for a in _SCORES] + ["pass_rate"]]
            + ["SELECT 'failures', id, 'position', position::DOUBLE FROM failing", "SELECT 'failures', id, 'n_failures', n::DOUBLE FROM failing"]
        ),
    ),
)
def _(spark, sf):
    from parley.session import stage

    none = F.array().cast("array<string>")
    expected = F.when(F.col("difficulty") == "low_signal", none).otherwise(
        F.array(F.concat(F.lit("POLICY_"), F.upper("true_intent")), F.lit("REPLY_1"))
    )
    gold = seeds.gold(spark, sf).withColumn("grounding_doc_ids", expected)
    records = stage(plan.grounded_records(gold, store_index(spark, sf), judge=True), "grounded")
    tables = plan.classification(records)
    judged = [f"mean_{a}" for a in _SCORES] + ["pass_rate"]
    return (
        _tall(tables["rates"], "rates", F.lit("all"), ["tp", "fp", "tn", "fn", *RATES, "grounding_hit_rate"])
        .unionByName(_tall(tables["judge"], "judge", F.lit("all"), judged))
        .unionByName(_tall(tables["failures"], "failures", F.col("id"), ["position", "n_failures"]))
    )
