"""Building blocks of the SQL oracle: common table expressions over the given tables."""

from __future__ import annotations

from parley.fixed import wording as fx
from parley.fixed.baseline_rules import BASELINE_RULES, HANDOFF_INTENTS, HANDOFF_WORDS, REPLY_TEMPLATES
from parley.fixed.gold_strata import GOLD_STRATA
from parley.fixed.intent_patterns import INTENT_PATTERNS, SAFETY_OVERRIDES
from parley.fixed.taxonomy import INTENTS
from parley.workload.phrases import PHRASES, REPLIES, REPLY_KEYS, TAILS
from parley.workload.seeds import TIER_OF_PRIORITY

NAMES = [d["category"] for d in INTENTS]
MANDATORY = [d["category"] for d in INTENTS if d["requires_human_escalation"]]
WORD = r"[\p{L}\p{N}_]"
MD5_NUM = "(('0x' || substr(md5({}), 1, 8))::BIGINT % 100)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listing(texts: list[str]) -> str:
    return "[" + ", ".join(q(t) for t in texts) + "]"


def within(column: str, names: list[str]) -> str:
    return f"{column} IN (" + ", ".join(q(n) for n in names) + ")"


def has(text: str, pattern: str) -> str:
    """Search ignoring case. The one lookbehind in use is emulated by hiding the words it excludes."""
    lookbehind = "(?<!supposed to be )"
    if pattern.startswith(lookbehind):
        text = f"regexp_replace({text}, 'supposed to be delivered', 'supposed to be_delivered', 'gi')"
        pattern = pattern[len(lookbehind) :]
    return f"regexp_matches({text}, {q(pattern)}, 'i')"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def squeeze(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def clean(text: str) -> str:
    return squeeze(rf"regexp_replace(coalesce({text}, ''), '@{WORD}+', '', 'g')")


EMAIL = rf"[\p{{L}}\p{{N}}_.\-]+@[\p{{L}}\p{{N}}_.\-]+\.{WORD}+"
PHONE = fx.PII_RULES[1][0]
# The lookahead asks for a digit in the run; spelled out by the place of the first digit.
ORDER = (
    r"\b(order|tracking|ticket|id)[:\s#]+(\d[a-z0-9\-]{4,}|[a-z\-]\d[a-z0-9\-]{3,}|[a-z\-]{2}\d[a-z0-9\-]{2,}"
    r"|[a-z\-]{3}\d[a-z0-9\-]+|[a-z\-]{4,}\d[a-z0-9\-]*)\b|\b\d{3}-\d{7}-\d{7}\b"
)
URL = fx.PII_RULES[3][0]


def redact(text: str, normalize: bool = True) -> str:
    out = f"coalesce({text}, '')"
    for pattern, flags, mark in [(EMAIL, "gi", "[EMAIL]"), (PHONE, "g", "[PHONE]"), (ORDER, "gi", "[ORDER_ID]"), (URL, "g", "[LINK]")]:
        out = f"regexp_replace({out}, {q(pattern)}, {q(mark)}, '{flags}')"
    return squeeze(out) if normalize else out


def ascii_share(text: str) -> str:
    return rf"length(regexp_replace({text}, '[^\x00-\x7F]', '', 'g')) / greatest(length({text}), 1)::DOUBLE"


def word_count(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '\S+'))"


def choice(texts: list[str], index: str, n: str | None = None) -> str:
    picked = f"({listing(texts)})[({index})::INT + 1]"
    return picked if n is None else f"replace({picked}, '{{n}}', {n}::VARCHAR)"


def message(key: str, customer: str) -> str:
    return (
        choice([p for _, p in PHRASES], f"{key} % {len(PHRASES)}")
        + " || "
        + choice(TAILS, f"{customer} % {len(TAILS)}", customer)
    )


REPLY = choice(REPLIES, f"(o_orderkey + o_custkey) % {len(REPLIES)}", f"(o_custkey % {REPLY_KEYS})")
LABEL = choice([i for i, _ in PHRASES], f"o_orderkey % {len(PHRASES)}")
CREATED = "CASE WHEN o_orderkey % 50 = 0 THEN 'not a date' ELSE strftime(o_orderdate::TIMESTAMP, '%a %b %d %H:%M:%S +0000 %Y') END"


def label_escalate(intent: str, text: str, tier: str) -> tuple[str, str]:
    """(escalate, reason) expressions of the gold label rules."""
    low = f"lower({text})"
    any_of = lambda words: "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"
    yes = [(f"{intent} = {q(n)}", r) for n, r in fx.LABEL_MANDATORY]
    yes += [
        (f"{tier} = 'angry_profane'", fx.LABEL_ANGRY),
        (f"{tier} = 'high_risk'", fx.LABEL_HIGH_RISK),
        (f"{tier} = 'multi_issue' AND {any_of(fx.LABEL_MULTI_WORDS)}", fx.LABEL_MULTI),
        (f"{intent} = 'delivery_not_received' AND {any_of(fx.LABEL_MISSING_WORDS)}", fx.LABEL_MISSING),
        (
            f"{intent} = 'returns_refunds' AND contains({low}, 'cashback') AND contains({low}, 'months')",
            fx.LABEL_CASHBACK,
        ),
    ]
    no = [(f"{intent} = {q(n)}", r) for n, r in fx.LABEL_AUTO]
    whens = lambda value: " ".join(f"WHEN {c} THEN {value(r, e)}" for e, part in ((True, yes), (False, no)) for c, r in part)
    return (
        f"CASE {whens(lambda r, e: str(e).upper())} ELSE FALSE END",
        f"CASE {whens(lambda r, e: q(r))} ELSE {q(fx.LABEL_DEFAULT)} END",
    )


_PHRASE = choice([p for _, p in PHRASES], f"o_orderkey % {len(PHRASES)}")
_TIER = (
    f"CASE WHEN length({_PHRASE}) < 8 THEN 'low_signal' "
    + " ".join(f"WHEN o_orderpriority = {q(k)} THEN {q(v)}" for k, v in TIER_OF_PRIORITY.items())
    + " ELSE 'routine' END"
)
_LABEL = label_escalate("true_intent", "message_text", "difficulty")


def heuristic(source: str, key: str, text: str, out: str = "predicted") -> list[tuple[str, str]]:
    """CTEs for the pattern pack: hits -> scores -> ranked -> predicted(key, intent, confidence, ...)."""
    hits = ", ".join(f"{has('t', p)} AS m{i}" for i, (_, p, _) in enumerate(INTENT_PATTERNS))
    scores = []
    for name in NAMES:
        weights = [f"CASE WHEN m{i} THEN {w}::DOUBLE ELSE 0 END" for i, (n, _, w) in enumerate(INTENT_PATTERNS) if n == name]
        scores.append(f"greatest({', '.join(['0.05::DOUBLE', *weights])}) AS s_{name}")
    total = " + ".join(f"s_{n}" for n in NAMES)
    ranked = ", ".join(
        f"{{'p': -round(s_{n} / total, 4), 'o': {i}, 'i': {q(n)}, 'w': s_{n}}}" for i, n in enumerate(NAMES)
    )
    reasons = ", ".join(
        f"CASE WHEN m{i} THEN {q(f'Matched {n} ({w:.2f})')} END" for i, (n, _, w) in enumerate(INTENT_PATTERNS)
    )
    any_hit = " OR ".join(f"m{i}" for i in range(len(INTENT_PATTERNS)))
    return [
        (f"{out}_hits", f"SELECT {key} AS k, t, {hits} FROM (SELECT {key}, {strip(text)} AS t FROM {source})"),
        (
            f"{out}_scores",
            f"SELECT k, t, ({any_hit}) AS matched, list_filter([{reasons}], lambda r: r IS NOT NULL) AS reasons, "
            f"{', '.join(scores)} FROM {out}_hits",
        ),
        (
            f"{out}_ranked",
            f"SELECT *, list_sort([{ranked}]) AS r FROM (SELECT *, {total} AS total FROM {out}_scores)",
        ),
        (
            out,
            "SELECT k, CASE WHEN matched THEN r[1].i ELSE 'other_unclear' END AS intent, "
            f"CASE WHEN matched THEN round(r[1].w, 2) ELSE {fx.FALLBACK_CONFIDENCE}::DOUBLE END AS confidence, "
            f"(NOT matched OR (round(r[2].p - r[1].p, 4) < {fx.AMBIGUITY_MARGIN}::DOUBLE AND -r[1].p < {fx.AMBIGUITY_TOP}::DOUBLE)) AS is_ambiguous, "
            "round(r[2].p - r[1].p, 4) AS margin, "
            f"CASE WHEN matched THEN array_to_string(reasons[1:3], '; ') ELSE {q(fx.NO_MATCH)} END AS explanation, "
            + ", ".join(f"round(s_{n} / total, 4) AS p_{n}" for n in NAMES)
            + f" FROM {out}_ranked",
        ),
    ]


def override(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(text, p)} THEN {q(i)}" for i, p in SAFETY_OVERRIDES) + " END"


KEYWORD_INTENT = (
    "CASE "
    + " ".join(
        f"WHEN {' OR '.join(has('message_text', p) for p in patterns)} THEN {q(intent)}" for intent, patterns in BASELINE_RULES
    )
    + " ELSE 'other_unclear' END"
)
KEYWORD_ESCALATE = f"({within('predicted_intent', HANDOFF_INTENTS)} OR {has('message_text', HANDOFF_WORDS)})"
KEYWORD_REPLY = (
    f"CASE WHEN predicted_escalate THEN {q(fx.KEYWORD_HANDOFF_REPLY)} "
    + " ".join(f"WHEN predicted_intent = {q(i)} THEN {q(t)}" for i, t in REPLY_TEMPLATES.items())
    + " END"
)

CTES = {
    "msgs": f"SELECT o_orderkey AS msg_id, {message('o_orderkey', 'o_custkey')} AS text, {CREATED} AS created_at FROM orders",
    "gold": f"SELECT *, {_LABEL[0]} AS true_escalate, {_LABEL[1]} AS escalate_reason FROM ("
    "SELECT 'GOLDEN_' || lpad(o_orderkey::VARCHAR, 9, '0') AS id, o_orderkey AS gk, "
    f"{message('o_orderkey', 'o_custkey')} AS message_text, {q(fx.NO_CONTEXT)} AS thread_context, "
    f"(o_orderkey % 4 + 1)::INT AS turn_index, {LABEL} AS true_intent, {_TIER} AS difficulty, "
    f"{q(fx.REVIEW_PENDING)} AS review_status, {REPLY} AS reference_brand_reply FROM orders)",
    "pairs": "SELECT 'amz_' || o_orderkey || '_' || (o_orderkey + 1000000000) AS pair_id, o_custkey::VARCHAR AS conversation_id, "
    "(o_orderkey % 4 + 1)::INT AS turn_index, o_orderkey::VARCHAR AS customer_tweet_id, "
    "(o_orderkey + 1000000000)::VARCHAR AS brand_tweet_id, "
    f"{message('o_orderkey', 'o_custkey')} AS customer_message, {REPLY} AS brand_reply, "
    f"CASE WHEN o_orderkey % 4 = 0 THEN {q(fx.NO_CONTEXT)} ELSE '[Customer]: hello | [AmazonHelp]: how can we help?' END AS thread_context, "
    f"{CREATED} AS customer_created_at FROM orders",
    "tree": f"SELECT event_id + 1 AS tweet_id, CASE WHEN event_type IN ('purchase', 'click') THEN {q(fx.BRAND)} "
    "WHEN event_type = 'error' THEN 'OtherBrand' ELSE 'user' || user_id END AS author_id, "
    "event_type NOT IN ('purchase', 'click', 'error') AS inbound, "
    "strftime(ts::TIMESTAMP, '%a %b %d %H:%M:%S +0000 %Y') AS created_at, "
    f"'@x' || user_id || ' ' || {message('event_id', 'user_id')} AS text, "
    "CASE WHEN event_id % 97 = 5 THEN event_id + 1000000000000 WHEN event_id % 64 > 0 "
    "THEN event_id - event_id % 64 + (event_id % 64) // 2 + 1 END AS in_response_to_tweet_id FROM events",
    "chat": f"SELECT conv_id * 1000000 + turn + 1 AS tweet_id, CASE WHEN role = 'assistant' THEN {q(fx.BRAND)} ELSE 'c' || conv_id END AS author_id, "
    "role = 'user' AS inbound, NULL::VARCHAR AS created_at, text, "
    "CASE WHEN turn > 0 THEN conv_id * 1000000 + turn END AS in_response_to_tweet_id FROM conversations WHERE role <> 'system'",
    "docs": "SELECT doc_id AS doc_ord, 'D' || doc_id AS doc_id, source AS title, lang AS category, text AS content FROM documents",
    "queries": "SELECT item_id::VARCHAR AS qid, text, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS category FROM benchmark",
    "reply_docs": f"SELECT min(o_orderkey) + 12 AS doc_ord, 'REPLY_' || min(o_orderkey) AS doc_id, arg_min(title, o_orderkey) AS title, "
    "arg_min(category, o_orderkey) AS category, content, FALSE AS is_policy FROM ("
    f"SELECT o_orderkey, {REPLY} AS content, {LABEL} AS category, {message('o_orderkey', 'o_custkey')} AS title FROM orders) GROUP BY content",
    "policies": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, {q('POLICY_' + d['category'].upper())}, {q(d['name'])}, {q(d['category'])}, "
        + q("POLICY GUIDANCE: " + d["resolution_guidance"] + "\nSCOPE: " + d["description"])
        + ", TRUE)"
        for i, d in enumerate(INTENTS)
    )
    + ") t(doc_ord, doc_id, title, category, content, is_policy)",
    "dim": "SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, {q(d['category'])}, {q(d['risk_level'])}, {str(d['requires_human_escalation']).upper()}, {q(d['resolution_guidance'])})"
        for i, d in enumerate(INTENTS)
    )
    + ") t(ord, intent, risk_level, requires_human_escalation, resolution_guidance)",
}

# Brand filter, one row per id (ids are unique here), pairs with history.
def thread_ctes(source: str) -> list[tuple[str, str]]:
    brand = q(fx.BRAND)
    return [
        ("own", f"SELECT tweet_id FROM {source} WHERE author_id = {brand}"),
        ("answered", f"SELECT in_response_to_tweet_id AS tweet_id FROM {source} WHERE author_id = {brand} AND in_response_to_tweet_id IS NOT NULL"),
        (
            "kept",
            f"SELECT * FROM {source} WHERE tweet_id IN (SELECT tweet_id FROM own UNION SELECT tweet_id FROM answered) "
            "OR coalesce(in_response_to_tweet_id IN (SELECT tweet_id FROM own), FALSE)",
        ),
        (
            "replies",
            f"SELECT b.tweet_id AS reply_id, c.tweet_id AS customer_id, b.text AS raw_brand_reply, c.text AS raw_customer_message, "
            "c.created_at AS customer_created_at, b.created_at AS brand_created_at "
            f"FROM kept b JOIN kept c ON b.in_response_to_tweet_id = c.tweet_id WHERE b.author_id = {brand} AND c.inbound",
        ),
        (
            "walk",
            "SELECT tweet_id AS start, tweet_id AS anc, in_response_to_tweet_id AS up, 0 AS dist, inbound, text FROM kept "
            "WHERE tweet_id IN (SELECT customer_id FROM replies) UNION ALL "
            "SELECT w.start, k.tweet_id, k.in_response_to_tweet_id, w.dist + 1, k.inbound, k.text FROM walk w JOIN kept k ON w.up = k.tweet_id",
        ),
        (
            "history",
            "SELECT start, arg_max(anc, dist) AS root_id, count(*) FILTER (dist > 0 AND inbound) AS prior_customers, "
            f"string_agg(CASE WHEN inbound THEN '[Customer]: ' ELSE '[{fx.BRAND}]: ' END || {clean('text')}, {q(fx.TURN_SEPARATOR)} ORDER BY dist DESC) "
            "FILTER (dist > 0) AS prior_context FROM walk GROUP BY start",
        ),
    ]


TREE_PAIRS = (
    "SELECT 'amz_' || customer_id || '_' || reply_id AS pair_id, root_id::VARCHAR AS conversation_id, (prior_customers + 1)::INT AS turn_index, "
    "customer_id::VARCHAR AS customer_tweet_id, reply_id::VARCHAR AS brand_tweet_id, "
    f"{clean('raw_customer_message')} AS customer_message, raw_customer_message, {clean('raw_brand_reply')} AS brand_reply, raw_brand_reply, "
    f"coalesce(prior_context, {q(fx.NO_CONTEXT)}) AS thread_context, customer_created_at, brand_created_at "
    "FROM replies JOIN history ON start = customer_id"
)


def with_(names: list, body: str) -> str:
    """A query with the named expressions in front; (name, sql) pairs add expressions of their own."""
    parts: list[tuple[str, str]] = []

    def add(entry) -> None:
        if isinstance(entry, str):
            parts.append((entry, CTES[entry]))
        elif isinstance(entry, tuple):
            parts.append(entry)
        else:
            for e in entry:
                add(e)

    add(names)
    # A recursive expression cannot be materialized.
    return "WITH RECURSIVE " + ", ".join(
        f"{n} AS {'' if n == 'walk' else 'MATERIALIZED '}({s})" for n, s in parts
    ) + " " + body


def tfidf(queries: str, docs: str, max_terms: int = fx.MAX_TERMS, threshold: float = fx.MIN_SCORE, k: int = fx.TOP_K) -> list[tuple[str, str]]:
    """CTEs for index and search: hits(qid, doc_ord, score, rank)."""
    grams = (
        "SELECT {key}, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)::BIGINT), lambda i: w[i] || ' ' || w[i + 1]))) AS term "
        "FROM (SELECT {key}, regexp_extract_all(lower({text}), '" + WORD.replace("{", "{{").replace("}", "}}") + "{{2,}}') AS w FROM {source})"
    )
    body = "coalesce(title, '') || ' ' || content || ' category_' || coalesce(nullif(category, ''), 'general')"
    return [
        ("d_tf", "SELECT doc_ord, term, count(*) AS tf FROM (" + grams.format(key="doc_ord", text=body, source=docs) + ") GROUP BY ALL"),
        (
            "vocab",
            f"SELECT term, ln((1 + (SELECT count(*) FROM {docs})) / (1 + count(*))::DOUBLE) + 1 AS idf FROM d_tf GROUP BY term "
            f"ORDER BY sum(tf) DESC, term LIMIT {max_terms}",
        ),
        ("d_w", "SELECT doc_ord, term, (1 + ln(tf)) * idf AS w FROM d_tf JOIN vocab USING (term)"),
        ("d_n", "SELECT doc_ord, sqrt(sum(w * w)) AS n FROM d_w GROUP BY doc_ord"),
        ("q_tf", "SELECT qid, term, count(*) AS tf FROM (" + grams.format(key="qid", text="text", source=queries) + ") GROUP BY ALL"),
        ("q_w", "SELECT qid, term, (1 + ln(tf)) * idf AS w FROM q_tf JOIN vocab USING (term)"),
        ("q_n", "SELECT qid, sqrt(sum(w * w)) AS n FROM q_w GROUP BY qid"),
        ("dots", "SELECT qid, doc_ord, sum(a.w * b.w) AS dot FROM q_w a JOIN d_w b USING (term) GROUP BY ALL"),
        (
            "eff",
            "SELECT qid, doc_ord, round(dot / q_n.n / d_n.n * CASE WHEN coalesce(x.category, '') = '' THEN 1 "
            f"WHEN x.category IS NOT DISTINCT FROM y.category THEN {fx.SAME_CATEGORY_BOOST}::DOUBLE ELSE {fx.OTHER_CATEGORY_FACTOR}::DOUBLE END, 12) AS raw "
            f"FROM dots JOIN q_n USING (qid) JOIN d_n USING (doc_ord) JOIN {queries} x USING (qid) JOIN {docs} y USING (doc_ord)",
        ),
        (
            "hits",
            "SELECT qid, doc_ord, round(least(raw, 1.0), 4) AS score, rank FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY qid ORDER BY raw DESC, doc_ord) AS rank FROM eff WHERE raw >= {threshold}::DOUBLE) WHERE rank <= {k}",
        ),
    ]


STRATA = GOLD_STRATA
