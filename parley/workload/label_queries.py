"""Queries on intents, baselines, policy, labels, gold set and precedents."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.fixed.baseline_rules import HANDOFF_INTENTS, HANDOFF_WORDS
from parley.fixed.gold_strata import CURATED_ROWS, GOLD_STRATA
from parley.functions import text as tx
from parley.functions.rates import rounded
from parley.operators import baselines, gold, intents, precedents, quality
from parley.operators.policy import TRIAGE_POLICY, escalation_policy
from parley.operators.taxonomy import INTENT_NAMES, policy_documents, taxonomy_lookup
from parley.operators.topn import number_rows
from parley.workload import seeds
from parley.workload import sql as s
from parley.workload.registry import query

PRED = ["intent", "confidence", "is_ambiguous", "margin", "explanation"]
PROBS = [f"p_{n}" for n in INTENT_NAMES]


# Intent scoring --------------------------------------------------------------


@query(
    "heuristic_intent",
    s.with_(["msgs", s.heuristic("msgs", "msg_id", "text")], f"SELECT k AS msg_id, {', '.join(PRED + PROBS)} FROM predicted"),
)
def _(spark, sf):
    out = intents.heuristic_intent(seeds.messages(spark, sf), "text")
    return out.select("msg_id", *PRED, *[F.col("probabilities")[n].alias(f"p_{n}") for n in INTENT_NAMES])


@query(
    "batch_intent",
    s.with_(
        [s.heuristic("documents", "doc_id", "text")],
        "SELECT intent, is_ambiguous, count(*) AS n, round(avg(confidence), 4) AS confidence FROM predicted GROUP BY ALL",
    ),
)
def _(spark, sf):
    out = intents.heuristic_intent(seeds.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return out.groupBy("intent", "is_ambiguous").agg(F.count("*").alias("n"), rounded(F.avg("confidence"), 4).alias("confidence"))


_HYBRID = f"""SELECT k AS msg_id, coalesce(o, intent) AS intent,
CASE WHEN o IS NULL THEN confidence ELSE {fx.OVERRIDE_CONFIDENCE}::DOUBLE END AS confidence,
CASE WHEN o IS NULL THEN is_ambiguous ELSE FALSE END AS is_ambiguous,
CASE WHEN o IS NULL THEN margin ELSE {fx.OVERRIDE_MARGIN}::DOUBLE END AS margin,
CASE WHEN o IS NULL THEN explanation ELSE '{fx.OVERRIDE_TEXT}' || o END AS explanation
FROM predicted JOIN (SELECT msg_id AS k, {s.override('text')} AS o FROM msgs) USING (k)"""


@query("hybrid_intent", s.with_(["msgs", s.heuristic("msgs", "msg_id", "text")], _HYBRID))
def _(spark, sf):
    return intents.hybrid_intent(seeds.messages(spark, sf), "text").select("msg_id", *PRED)


def _recorded(label):
    """Recorded model answers of five kinds, by key: full, unknown code, broken, bare, two classes."""
    return [
        [('{"predicted_category": "', label, '", "confidence": 0.93, "probabilities": {"order_status_delay": 0.2, "made_up": 0.5}, "rationale": "read"}')],
        [('{"predicted_category": "spaceship", "confidence": 0.41, "probabilities": {}, "rationale": "odd"}',)],
        [('{"predicted_category": "', label)],
        [('{}',)],
        [('{"predicted_category": "', label, '", "probabilities": {"returns_refunds": 0.45, "prime_subscription_benefits": 0.44}}')],
    ]


def _recorded_spark(key, label):
    out = None
    for i, (parts,) in enumerate(_recorded(None)):
        text = F.concat(*[label if p is None else F.lit(p) for p in parts])
        out = F.when(key % 5 == i, text) if out is None else out.when(key % 5 == i, text)
    return out


def _recorded_sql(key: str, label: str) -> str:
    cases = []
    for i, (parts,) in enumerate(_recorded(None)):
        cases.append(f"WHEN {i} THEN " + " || ".join(label if p is None else s.q(p) for p in parts))
    return f"CASE {key} % 5 " + " ".join(cases) + " END"


_KNOWN = s.listing(INTENT_NAMES)
_PARSED = f"""
SELECT gk, CASE WHEN ok THEN code ELSE intent END AS intent, CASE WHEN ok THEN conf ELSE confidence END AS confidence,
CASE WHEN ok THEN m < 0.15::DOUBLE ELSE is_ambiguous END AS is_ambiguous, round(CASE WHEN ok THEN m ELSE margin END, 6) AS margin,
CASE WHEN ok THEN why ELSE explanation END AS explanation FROM (
SELECT *, CASE WHEN len(probs) > 1 THEN probs[1] - probs[2] ELSE 1 END AS m FROM (
SELECT *, list_reverse_sort(CASE WHEN list_contains(names, code) THEN vals ELSE list_append(vals, conf) END) AS probs FROM (
SELECT *, list_transform(names, lambda n: (json_extract(j, '$.probabilities.' || n))::DOUBLE) AS vals FROM (
SELECT *, CASE WHEN list_contains({_KNOWN}, coalesce(c0, 'other_unclear')) THEN coalesce(c0, 'other_unclear') ELSE 'other_unclear' END AS code,
list_filter(coalesce(json_keys(j, '$.probabilities'), []), lambda n: list_contains({_KNOWN}, n)) AS names FROM (
SELECT gk, json_valid(r) AS ok, CASE WHEN json_valid(r) THEN r::JSON END AS j, json_extract_string(CASE WHEN json_valid(r) THEN r ELSE '{{}}' END, '$.predicted_category') AS c0,
coalesce((json_extract(CASE WHEN json_valid(r) THEN r ELSE '{{}}' END, '$.confidence'))::DOUBLE, 0.7::DOUBLE) AS conf,
json_extract_string(CASE WHEN json_valid(r) THEN r ELSE '{{}}' END, '$.rationale') AS why
FROM (SELECT gk, {_recorded_sql('gk', 'true_intent')} AS r FROM gold)))))) x JOIN predicted ON k = gk"""


def _gold_with_key(spark, sf):
    return seeds.gold(spark, sf).withColumn("gk", F.substring("id", 8, 9).cast("long"))


@query("parse_llm_intent", s.with_(["gold", s.heuristic("gold", "gk", "message_text")], _PARSED))
def _(spark, sf):
    g = _gold_with_key(spark, sf)
    g = g.select("gk", "message_text", _recorded_spark(F.col("gk"), F.col("true_intent")).alias("answer"))
    out = intents.parse_model_intent(g, "message_text", "answer")
    return out.select("gk", "intent", "confidence", "is_ambiguous", rounded("margin", 6).alias("margin"), "explanation")


@query(
    "taxonomy_lookup",
    s.with_(
        ["msgs", "dim", s.heuristic("msgs", "msg_id", "text")],
        "SELECT risk_level, requires_human_escalation, resolution_guidance, intent, count(*) AS n FROM predicted LEFT JOIN dim USING (intent) GROUP BY ALL",
    ),
)
def _(spark, sf):
    scored = intents.heuristic_intent(seeds.messages(spark, sf), "text").groupBy("intent").agg(F.count("*").alias("n"))
    return taxonomy_lookup(scored, "intent")


@query(
    "taxonomy_dim",
    s.with_(["gold", "dim"], "SELECT ord AS intent_ord, intent, count(id) AS rows FROM dim LEFT JOIN gold ON true_intent = intent GROUP BY ALL"),
)
def _(spark, sf):
    from parley.operators.taxonomy import taxonomy_dim

    counts = seeds.gold(spark, sf).groupBy("true_intent").agg(F.count("*").alias("n"))
    return taxonomy_dim(spark).join(counts, F.col("category") == F.col("true_intent"), "left").select(
        "intent_ord", F.col("category").alias("intent"), F.coalesce("n", F.lit(0)).alias("rows")
    )


# Baselines -------------------------------------------------------------------

_KEY = [
    ("keyed", f"SELECT *, {s.KEYWORD_INTENT} AS predicted_intent FROM gold"),
    ("base", f"SELECT *, {s.KEYWORD_ESCALATE} AS predicted_escalate FROM keyed"),
]
KEYWORD_RUN = ["gold", _KEY]


def keyword_run(spark, sf):
    return baselines.keyword_baseline(seeds.gold(spark, sf), "message_text")


@query("simple_baseline_intent", s.with_(KEYWORD_RUN, "SELECT id, predicted_intent FROM base"))
def _(spark, sf):
    return keyword_run(spark, sf).select("id", "predicted_intent")


_REASON = (
    f"CASE WHEN {s.within('predicted_intent', HANDOFF_INTENTS)} THEN 'Rule escalation: Intent ''' || predicted_intent || ''' is a high-risk policy category.' "
    f"WHEN {s.has('message_text', HANDOFF_WORDS)} THEN {s.q(fx.KEYWORD_REASON_WORDS)} ELSE {s.q(fx.KEYWORD_REASON_AUTO)} END"
)


@query("simple_baseline_escalation", s.with_(KEYWORD_RUN, f"SELECT id, predicted_escalate, {_REASON} AS escalation_reason FROM base"))
def _(spark, sf):
    return keyword_run(spark, sf).select("id", "predicted_escalate", "escalation_reason")


@query("simple_baseline_reply", s.with_(KEYWORD_RUN, f"SELECT id, {s.KEYWORD_REPLY} AS response FROM base"))
def _(spark, sf):
    return keyword_run(spark, sf).select("id", "response")


_MAJORITY = "SELECT true_intent, count(*) AS n, round(count(*) / (SELECT count(*) FROM gold)::DOUBLE, 4) AS share FROM gold GROUP BY 1 ORDER BY n DESC, min(id) LIMIT 1"


@query("majority_class", s.with_(["gold"], _MAJORITY))
def _(spark, sf):
    return baselines.majority_class(seeds.gold(spark, sf))


@query(
    "trivial_baseline",
    s.with_(
        ["gold", ("top", _MAJORITY)],
        f"SELECT id, (SELECT true_intent FROM top) AS predicted_intent, a AS predicted_escalate, CASE WHEN a THEN {s.q(fx.ALWAYS_REASON)} ELSE {s.q(fx.NEVER_REASON)} END AS escalation_reason, "
        f"CASE WHEN a THEN {s.q(fx.ALWAYS_REPLY)} ELSE {s.q(fx.NEVER_REPLY)} END AS response FROM gold, (VALUES (TRUE), (FALSE)) t(a)",
    ),
)
def _(spark, sf):
    g = seeds.gold(spark, sf)
    top = baselines.majority_class(g)
    both = baselines.fixed_baseline(g, top, True).unionByName(baselines.fixed_baseline(g, top, False))
    return both.select("id", "predicted_intent", "predicted_escalate", "escalation_reason", "response")


# Policy and labels -------------------------------------------------------------


def policy_sql(text: str, qualified: str, conf: float = 0.65, score: float = 0.15, docs: int = 1) -> tuple[str, str]:
    mandatory = s.within("intent", s.MANDATORY)
    two = "printf('%.2f', {})"
    rules = [
        ("intent IS NULL", s.q(fx.REASON_NO_INTENT)),
        (s.has(f"lower({text})", fx.CRISIS_WORDS), s.q(fx.REASON_CRISIS)),
        ("intent = 'other_unclear'", s.q(fx.REASON_UNCLEAR)),
        (
            mandatory,
            "'Escalated: Intent ''' || intent || ''' is categorized as ' || (SELECT any_value(risk_level) FROM dim d WHERE d.intent = z.intent) || ' risk and requires mandatory human handling per policy.'",
        ),
        (
            f"confidence < {conf}::DOUBLE OR is_ambiguous",
            f"'Escalated: Intent confidence (' || {two.format('confidence')} || ') is below operational threshold ({conf:.2f}) or prediction is ambiguous.'",
        ),
        (
            f"{qualified} < {docs}",
            f"'Escalated: No relevant precedent retrieved with similarity >= {score:.2f} (found ' || {qualified} || ' qualified precedents).'",
        ),
    ]
    escalate = "(" + " OR ".join(f"coalesce({c}, FALSE)" for c, _ in rules) + ")"
    reason = (
        "CASE "
        + " ".join(f"WHEN {c} THEN {r}" for c, r in rules)
        + f" ELSE 'Autonomous handling approved: High confidence (' || {two.format('confidence * 100')} || '%) in intent ''' || intent || ''' backed by ' || {qualified} || ' qualified grounding precedent(s).' END"
    )
    return escalate, reason


_ESC, _WHY = policy_sql("text", "qualified")


@query(
    "escalation_policy",
    s.with_(
        ["msgs", "dim", s.heuristic("msgs", "msg_id", "text")],
        f"SELECT msg_id, {_ESC} AS escalate, {_WHY} AS reason FROM (SELECT *, msg_id % 3 AS qualified FROM predicted JOIN msgs ON k = msg_id) z",
    ),
)
def _(spark, sf):
    p = intents.heuristic_intent(seeds.messages(spark, sf), "text")
    d = escalation_policy(F.col("text"), F.col("intent"), F.col("confidence"), F.col("is_ambiguous"), F.col("msg_id") % 3, TRIAGE_POLICY)
    return p.select("msg_id", d.alias("d")).select("msg_id", "d.escalate", "d.reason")


@query("gold_escalation_label", s.with_(["gold"], "SELECT id, true_escalate, escalate_reason FROM gold"))
def _(spark, sf):
    return seeds.gold(spark, sf).select("id", "true_escalate", "escalate_reason")


# Gold set ----------------------------------------------------------------------

_POS = "conversation_id, turn_index, brand_tweet_id"


def _pick_ctes() -> list[tuple[str, str]]:
    """One expression per stratum; each leaves out what the earlier ones took."""
    out = [
        (
            "cand",
            f"SELECT * FROM pairs WHERE {s.ascii_share('customer_message')} > 0.85 AND length({s.strip('customer_message')}) >= 5 AND length(brand_reply) > 10",
        ),
        (
            "cand_hits",
            f"SELECT pair_id, {_POS}, " + ", ".join(f"{s.has('customer_message', p)} AS g{i}" for i, (_, p, _, _) in enumerate(GOLD_STRATA)) + " FROM cand",
        ),
    ]
    used = None
    for i, (_, _, _, quota) in enumerate(GOLD_STRATA):
        anti = f" AND pair_id NOT IN (SELECT pair_id FROM pick{i - 1})" if used else ""
        mine = f"SELECT {i} AS stratum, pair_id, row_number() OVER (ORDER BY {_POS}) AS r FROM cand_hits WHERE g{i}{anti} ORDER BY {_POS} LIMIT {quota}"
        out.append((f"pick{i}", f"SELECT * FROM pick{i - 1} UNION ALL (SELECT * FROM ({mine}))" if used else f"SELECT * FROM ({mine})"))
        used = True
    last = len(GOLD_STRATA) - 1
    out.append(("picked", f"SELECT *, row_number() OVER (ORDER BY stratum, r) AS gold_ord FROM pick{last}"))
    return out


_STRATUM_INTENT = f"({s.listing([i for i, _, _, _ in GOLD_STRATA])})[stratum + 1]"
_STRATUM_TIER = f"({s.listing([t for _, _, t, _ in GOLD_STRATA])})[stratum + 1]"
_GOLD_LABEL = s.label_escalate("true_intent", "message_text", "difficulty")
_GOLD_OUT = (
    f"SELECT 'GOLDEN_' || CASE WHEN gold_ord < 1000 THEN lpad(gold_ord::VARCHAR, 3, '0') ELSE gold_ord::VARCHAR END AS id, message_text, thread_context, turn_index, true_intent, "
    f"{_GOLD_LABEL[0]} AS true_escalate, {_GOLD_LABEL[1]} AS escalate_reason, difficulty, '{fx.REVIEW_PENDING}' AS review_status, reference_brand_reply FROM "
)
_PICK_ROWS = (
    f"SELECT gold_ord, {s.strip('customer_message')} AS message_text, {s.strip('thread_context')} AS thread_context, turn_index, "
    f"{_STRATUM_INTENT} AS true_intent, {_STRATUM_TIER} AS difficulty, {s.strip('brand_reply')} AS reference_brand_reply FROM picked JOIN cand USING (pair_id)"
)


@query("gold_stratified_pick", s.with_(["pairs", _pick_ctes()], _GOLD_OUT + f"({_PICK_ROWS})"))
def _(spark, sf):
    return gold.gold_pick(seeds.pairs(spark, sf))


@query(
    "exclude_used",
    s.with_(["pairs", _pick_ctes()], "SELECT pair_id FROM cand WHERE pair_id NOT IN (SELECT pair_id FROM picked)"),
)
def _(spark, sf):
    pool = gold.gold_candidates(seeds.pairs(spark, sf))
    return gold.exclude_used(pool, gold.stratified_pick(pool)).select("pair_id")


_FILL_TARGET = 400
_FILL_ROWS = (
    "SELECT (SELECT count(*) FROM picked) + r AS gold_ord, message_text, thread_context, turn_index, intent AS true_intent, "
    "CASE WHEN is_ambiguous THEN 'ambiguous' ELSE 'routine' END AS difficulty, reference_brand_reply FROM predicted JOIN fill USING (k)"
)
_FILL = [
    (
        "fill",
        f"SELECT * FROM (SELECT pair_id AS k, row_number() OVER (ORDER BY md5('42:' || pair_id), pair_id) AS r, {s.strip('customer_message')} AS message_text, "
        f"{s.strip('thread_context')} AS thread_context, turn_index, {s.strip('brand_reply')} AS reference_brand_reply FROM cand WHERE pair_id NOT IN (SELECT pair_id FROM picked)) "
        f"WHERE r <= {_FILL_TARGET} - (SELECT count(*) FROM picked)",
    )
]


@query(
    "gold_fill",
    s.with_(
        ["pairs", _pick_ctes(), _FILL, s.heuristic("fill", "k", "message_text")],
        _GOLD_OUT + f"({_PICK_ROWS} UNION ALL {_FILL_ROWS})",
    ),
)
def _(spark, sf):
    return gold.build_gold(seeds.pairs(spark, sf), target=_FILL_TARGET)


def _curated_sql() -> str:
    parts = []
    for i, d in enumerate(CURATED_ROWS):
        match = s.has("customer_message", d["pattern"])
        parts.append(
            f"SELECT 'GOLDEN_{i + 1:03d}' AS id, coalesce(m.message_text, {s.q(d['message_text'])}) AS message_text, coalesce(m.turn_index, 1) AS turn_index, "
            f"coalesce(m.thread_context, {s.q(d['thread_context'])}) AS thread_context, coalesce(m.reply, {s.q(d['reference_brand_reply'])}) AS reference_brand_reply, "
            f"{s.q(d['true_intent'])} AS true_intent, {str(d['true_escalate']).upper()} AS true_escalate, {s.q(d['difficulty'])} AS difficulty "
            f"FROM (SELECT 1) LEFT JOIN (SELECT {s.strip('customer_message')} AS message_text, turn_index, thread_context, {s.strip('brand_reply')} AS reply "
            f"FROM pairs WHERE {s.ascii_share('customer_message')} > 0.88 AND {match} ORDER BY {_POS} LIMIT 1) m ON TRUE"
        )
    return s.with_(["pairs"], " UNION ALL ".join(parts))


@query("first_match_or_fallback", _curated_sql())
def _(spark, sf):
    return gold.curated_gold(seeds.pairs(spark, sf)).drop("escalate_reason", "review_status")


@query(
    "review_queue",
    s.with_(
        ["gold"],
        f"SELECT id, CASE WHEN must THEN 'mandatory' ELSE 'audit' END AS review_reason FROM (SELECT id, difficulty, ({s.within('true_intent', s.MANDATORY)} "
        f"OR difficulty IN ('ambiguous', 'multi_issue')) AS must, {s.MD5_NUM.format(chr(39) + '42:' + chr(39) + ' || id')} AS h FROM gold) WHERE must OR (difficulty = 'routine' AND h < 20)",
    ),
)
def _(spark, sf):
    return gold.review_queue(seeds.gold(spark, sf)).select("id", "review_reason")


@query(
    "sequential_ids",
    s.with_(
        ["gold"],
        "SELECT id, 'GOLDEN_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS seq FROM (SELECT id, row_number() OVER (ORDER BY difficulty, id) AS n FROM gold)",
    ),
)
def _(spark, sf):
    numbered = number_rows(seeds.gold(spark, sf).select("id", "difficulty"), ["difficulty", "id"])
    return numbered.select("id", F.format_string("GOLDEN_%03d", "position").alias("seq"))


# Checks --------------------------------------------------------------------------


@query(
    "dq_gold_schema",
    s.with_(
        ["gold"],
        "SELECT unnest(['required_fields', 'id_prefix', 'message_text', 'escalate_reason', 'true_intent', 'difficulty', 'review_status']) AS rule, unnest(v) AS violations FROM (SELECT ["
        "count(*) FILTER (id IS NULL OR message_text IS NULL OR turn_index IS NULL OR thread_context IS NULL OR true_intent IS NULL OR true_escalate IS NULL OR escalate_reason IS NULL OR difficulty IS NULL OR review_status IS NULL), "
        f"count(*) FILTER (NOT starts_with(id, 'GOLDEN_')), count(*) FILTER (trim(message_text) = ''), count(*) FILTER (escalate_reason = ''), count(*) FILTER (NOT {s.within('true_intent', INTENT_NAMES[:-1])}), "
        "count(*) FILTER (difficulty NOT IN ('routine', 'ambiguous', 'high_risk', 'multi_issue', 'low_signal', 'angry_profane')), count(*) FILTER (review_status <> 'auto_labeled_pending_review')] AS v FROM (SELECT * REPLACE (CASE WHEN true_intent = 'other_unclear' THEN 'unheard_of' ELSE true_intent END AS true_intent) FROM gold))",
    ),
)
def _(spark, sf):
    # One label is broken on purpose, so that a rule counts something.
    broken = F.when(F.col("true_intent") == "other_unclear", "unheard_of").otherwise(F.col("true_intent"))
    return quality.gold_schema(seeds.gold(spark, sf).withColumn("true_intent", broken))


@query(
    "dq_gold_balance",
    s.with_(
        ["gold"],
        "SELECT *, rows = 200 AS rows_ok, edge_rows >= 100 AS edge_ok, escalations BETWEEN 40 AND 90 AS escalations_ok FROM (SELECT count(*) AS rows, count(*) FILTER (difficulty <> 'routine') AS edge_rows, count(*) FILTER (true_escalate) AS escalations FROM gold)",
    ),
)
def _(spark, sf):
    return quality.gold_balance(seeds.gold(spark, sf))


@query(
    "dq_safety_labels",
    s.with_(
        KEYWORD_RUN,
        f"SELECT id FROM base WHERE ({s.within('true_intent', s.MANDATORY)} OR difficulty IN ('high_risk', 'angry_profane')) AND NOT predicted_escalate",
    ),
)
def _(spark, sf):
    # The keyword baseline's decisions stand in for labels, so that some rows break the rule.
    run = keyword_run(spark, sf)
    return quality.safety_labels(run.withColumn("true_escalate", F.col("predicted_escalate"))).select("id")


@query("dq_confusion_total", s.with_(["gold"], "SELECT count(*) AS cells, count(*) AS rows, TRUE AS ok FROM gold"))
def _(spark, sf):
    from parley.operators.metrics import intent_confusion

    run = keyword_run(spark, sf)
    return quality.confusion_total(intent_confusion(run), run)


_JSON_SQL = (
    "SELECT id, CASE gk % 3 WHEN 0 THEN '{\"id\": 1, \"message_text\": \"x\"}' WHEN 1 THEN '{\"id\": 1, \"turn_index\": 2, \"thread_context\": \"\", \"message_text\": \"x\", "
    "\"true_intent\": \"a\", \"true_escalate\": true, \"escalate_reason\": \"r\", \"difficulty\": \"routine\", \"review_status\": \"s\"}' ELSE '{\"difficulty\": null, \"extra\": 5}' END AS value FROM gold"
)


@query(
    "missing_fields",
    s.with_(
        ["gold", ("j", _JSON_SQL)],
        f"SELECT id, array_to_string(list_filter({s.listing(quality.REQUIRED)}, lambda f: NOT list_contains(json_keys(value), f)), ',') AS missing FROM j",
    ),
)
def _(spark, sf):
    g = _gold_with_key(spark, sf)
    full = (
        '{"id": 1, "turn_index": 2, "thread_context": "", "message_text": "x", "true_intent": "a", "true_escalate": true, '
        '"escalate_reason": "r", "difficulty": "routine", "review_status": "s"}'
    )
    value = (
        F.when(F.col("gk") % 3 == 0, F.lit('{"id": 1, "message_text": "x"}'))
        .when(F.col("gk") % 3 == 1, F.lit(full))
        .otherwise(F.lit('{"difficulty": null, "extra": 5}'))
    )
    return quality.missing_fields(g.select("id", value.alias("value"))).select("id", F.array_join("missing", ",").alias("missing"))


@query(
    "gold_field_aliases",
    s.with_(
        ["gold"],
        "SELECT id, coalesce(nullif(CASE WHEN gk % 2 = 0 THEN message_text WHEN gk % 3 = 0 THEN '' END, ''), 'q' || gk) AS message_text, "
        "coalesce(CASE WHEN gk % 2 = 0 THEN true_intent END, difficulty) AS true_intent, coalesce(CASE WHEN gk % 2 = 0 THEN true_escalate END, CASE WHEN gk % 3 = 0 THEN TRUE END, FALSE) AS true_escalate, "
        "CASE WHEN gk % 5 = 0 THEN 'routine' ELSE difficulty END AS difficulty FROM gold",
    ),
)
def _(spark, sf):
    g = _gold_with_key(spark, sf)
    even = F.col("gk") % 2 == 0
    raw = g.select(
        "id",
        F.when(even, F.col("message_text")).when(F.col("gk") % 3 == 0, F.lit("")).alias("message_text"),
        F.concat(F.lit("q"), "gk").alias("query"),
        F.when(even, F.col("true_intent")).alias("true_intent"),
        F.col("difficulty").alias("expected_intent"),
        F.when(even, F.col("true_escalate")).alias("true_escalate"),
        F.when(F.col("gk") % 3 == 0, F.lit(True)).alias("expected_escalate"),
        F.when(F.col("gk") % 5 != 0, F.col("difficulty")).alias("difficulty"),
    )
    return gold.gold_field_aliases(raw)


# Precedents ------------------------------------------------------------------------


@query(
    "len_filter_precedents",
    s.with_(["pairs"], "SELECT pair_id FROM pairs WHERE length(customer_message) > 15 AND length(brand_reply) > 20"),
)
def _(spark, sf):
    return precedents.usable_pairs(seeds.pairs(spark, sf)).select("pair_id")


def greedy_ctes(default: int, special: dict[str, int], stop: int) -> list[tuple[str, str]]:
    """The sequential walk itself, as a fold over the ordered rows."""
    cap = "CASE " + " ".join(f"WHEN x.c = {s.q(k)} THEN {v}" for k, v in special.items()) + f" ELSE {default} END" if special else str(default)
    return [
        (
            "usable",
            f"SELECT pair_id AS k, {s.strip('customer_message')} AS title, {s.strip('brand_reply')} AS content, conversation_id, turn_index, brand_tweet_id FROM pairs "
            "WHERE length(customer_message) > 15 AND length(brand_reply) > 20",
        ),
        *s.heuristic("usable", "k", "title", "labelled"),
        (
            "ordered",
            f"SELECT list({{'sig': lower(substr(content, 1, 60)), 'c': intent, 'k': k}} ORDER BY {_POS}) AS rows FROM usable JOIN labelled USING (k)",
        ),
        (
            "folded",
            "SELECT list_reduce(rows, lambda acc, x: CASE WHEN len(acc.ks) >= "
            f"{stop} OR list_contains(acc.sigs, x.sig) OR coalesce(len(list_filter(acc.cs, lambda c: c = x.c)), 0) >= {cap} THEN acc "
            "ELSE {'sigs': list_append(acc.sigs, x.sig), 'cs': list_append(acc.cs, x.c), 'ks': list_append(acc.ks, x.k)} END, "
            "{'sigs': []::VARCHAR[], 'cs': []::VARCHAR[], 'ks': []::VARCHAR[]}) AS acc FROM ordered",
        ),
        ("accepted", "SELECT unnest(acc.ks) AS k, unnest(acc.cs) AS category, unnest(range(0, len(acc.ks)::BIGINT)) AS accept_ord FROM folded"),
        (
            "store",
            "SELECT doc_ord, doc_id, title, category, content, is_policy FROM policies UNION ALL "
            "SELECT accept_ord + 12, 'PRECEDENT_' || k, title, category, content, FALSE FROM accepted JOIN usable USING (k)",
        ),
    ]


_RARE = {i: fx.RARE_CAP for i in fx.RARE_INTENTS}
PRODUCTION_STORE = greedy_ctes(fx.COMMON_CAP, _RARE, fx.STORE_TARGET - 12)
_STORE_COLS = ["doc_ord", "doc_id", "title", "category", "content", "is_policy"]


@query("build_precedents", s.with_(["pairs", "policies", PRODUCTION_STORE], "SELECT * FROM store"))
def _(spark, sf):
    return precedents.build_precedents(seeds.pairs(spark, sf)).select(_STORE_COLS)


_TIGHT = {i: 25 for i in fx.RARE_INTENTS}


@query(
    "precedent_greedy_cap",
    s.with_(["pairs", "policies", greedy_ctes(20, _TIGHT, 240)], "SELECT k AS pair_id, category, accept_ord FROM accepted"),
)
def _(spark, sf):
    # Tight caps, so that full categories and the stop both bind.
    return precedents.greedy_cap(seeds.pairs(spark, sf), 20, _TIGHT, stop_at=240).select("pair_id", "category", "accept_ord")


@query(
    "precedent_cap_index",
    s.with_(["pairs", "policies", greedy_ctes(fx.COMMON_CAP, {}, fx.COMMON_CAP * 12)], "SELECT * FROM store"),
)
def _(spark, sf):
    return precedents.build_precedents_flat(seeds.pairs(spark, sf)).select(_STORE_COLS)


_DOC_COLS = "doc_ord, doc_id, title, category, content, is_policy"


@query("corpus_union", s.with_(["policies", "reply_docs"], f"SELECT {_DOC_COLS} FROM policies UNION ALL SELECT {_DOC_COLS} FROM reply_docs"))
def _(spark, sf):
    return precedents.corpus_union(policy_documents(spark, "orders"), seeds.reply_docs(spark, sf)).select(_STORE_COLS)


@query(
    "policy_documents",
    s.with_(["policies", "gold"], "SELECT doc_id, title, content, count(id) AS rows FROM policies LEFT JOIN gold ON true_intent = category GROUP BY ALL"),
)
def _(spark, sf):
    counts = seeds.gold(spark, sf).groupBy(F.col("true_intent").alias("category")).agg(F.count("*").alias("n"))
    docs = policy_documents(spark)
    return docs.join(counts, "category", "left").select("doc_id", "title", "content", F.coalesce("n", F.lit(0)).alias("rows"))


@query(
    "doc_upsert",
    s.with_(
        ["reply_docs"],
        "SELECT a.doc_id, 0 AS load, a.doc_ord, CASE WHEN b.doc_id IS NULL THEN a.category ELSE 'updated' END AS category FROM reply_docs a LEFT JOIN (SELECT * FROM reply_docs WHERE category = 'returns_refunds') b USING (doc_id) "
        "UNION ALL SELECT 'NEW_' || doc_id, 1, doc_ord, 'new' FROM reply_docs WHERE category = 'other_unclear'",
    ),
)
def _(spark, sf):
    old = seeds.reply_docs(spark, sf).select("doc_ord", "doc_id", "category")
    changed = old.where("category = 'returns_refunds'").withColumn("category", F.lit("updated"))
    new = old.where("category = 'other_unclear'").select("doc_ord", F.concat(F.lit("NEW_"), "doc_id").alias("doc_id"), F.lit("new").alias("category"))
    return precedents.doc_upsert(old, changed.unionByName(new)).select("doc_id", "load", "doc_ord", "category")


@query(
    "brand_turn_documents",
    "SELECT conv_id || '-' || turn AS doc_id, text AS content, CASE WHEN turn % 3 = 0 THEN 'returns_refunds' END AS category, conv_id::VARCHAR AS source_url_or_id "
    f"FROM conversations WHERE role = 'assistant' AND length({s.strip('text')}) >= 10",
)
def _(spark, sf):
    return precedents.brand_turn_documents(seeds.turns(spark, sf))
