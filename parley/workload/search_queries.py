"""Queries on retrieval, drafting and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions import text as tx
from parley.functions.rates import rounded
from parley.operators import drafting, precedents, retrieval
from parley.operators.taxonomy import policy_documents
from parley.plans.triage import flatten_state, triage
from parley.session import stage
from parley.workload import seeds
from parley.workload import sql as s
from parley.workload.label_queries import PRODUCTION_STORE, policy_sql
from parley.workload.registry import query

# Index and search over whole documents -------------------------------------------


@query(
    "tfidf_index",
    s.with_(
        ["docs", "queries", s.tfidf("queries", "docs")],
        "SELECT doc_ord, term, round(w / n, 6) AS weight FROM d_w JOIN d_n USING (doc_ord)",
    ),
)
def _(spark, sf):
    index = retrieval.tfidf_index(seeds.docs(spark, sf))
    return index.postings.select("doc_ord", "term", rounded("weight", 6).alias("weight"))


_SEARCH = s.with_(["docs", "queries", s.tfidf("queries", "docs")], "SELECT qid, doc_ord, score, rank::INT AS rank FROM hits")


@query("tfidf_search", _SEARCH)
def _(spark, sf):
    index = retrieval.tfidf_index(seeds.docs(spark, sf))
    return retrieval.tfidf_search(seeds.queries(spark, sf), index)


@query("tfidf_search_few_queries", _SEARCH)
def _(spark, sf):
    # Index beyond the bound, queries within it.
    index = retrieval.tfidf_index(seeds.docs(spark, sf))
    return retrieval.tfidf_search(seeds.queries(spark, sf), index, broadcast_rows=index.n_postings - 1)


@query("tfidf_search_shuffled", _SEARCH)
def _(spark, sf):
    # Both sides too large to broadcast; hot terms split.
    index = retrieval.tfidf_index(seeds.docs(spark, sf))
    return retrieval.tfidf_search(seeds.queries(spark, sf), index, broadcast_rows=0, hot_term_docs=100)


def _overlap_sql(threshold: float) -> str:
    words = r"list_distinct(regexp_extract_all(lower({}), '\S+'))"
    return s.with_(
        [
            "docs",
            "queries",
            ("qw", f"SELECT qid, category, {words.format('text')} AS w FROM queries"),
            ("dw", f"SELECT doc_ord, category AS dc, {words.format('content')} AS w FROM docs"),
            (
                "sc",
                "SELECT qid, doc_ord, len(list_intersect(qw.w, dw.w)) / greatest(len(qw.w), 1)::DOUBLE AS score FROM qw JOIN dw ON category IS NULL OR category = dc",
            ),
        ],
        f"SELECT qid, doc_ord, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_ord) AS rank FROM sc WHERE score >= {threshold}::DOUBLE) WHERE rank <= 3",
    )


@query("token_overlap_search", _overlap_sql(0.0))
def _(spark, sf):
    out = retrieval.overlap_search(seeds.queries(spark, sf), seeds.docs(spark, sf))
    return out.select("qid", "doc_ord", rounded("score", 6).alias("score"), "rank")


@query("token_overlap_search_threshold", _overlap_sql(0.2))
def _(spark, sf):
    out = retrieval.overlap_search(seeds.queries(spark, sf), seeds.docs(spark, sf), threshold=0.2)
    return out.select("qid", "doc_ord", rounded("score", 6).alias("score"), "rank")


@query(
    "token_intersection",
    s.with_(["pairs"], r"SELECT pair_id, len(list_intersect(list_distinct(regexp_extract_all(lower(customer_message), '\S+')), list_distinct(regexp_extract_all(lower(brand_reply), '\S+'))))::INT AS common FROM pairs"),
)
def _(spark, sf):
    return seeds.pairs(spark, sf).select("pair_id", retrieval.token_intersection("customer_message", "brand_reply").alias("common"))


# Triage over a store of policies and replies ---------------------------------------

_STORE = (
    "store",
    "SELECT doc_ord, doc_id, title, category, content, is_policy FROM policies UNION ALL SELECT doc_ord, doc_id, title, category, content, is_policy FROM reply_docs",
)
_ESC, _WHY = policy_sql("cleaned", "qualified")


REPLY_STORE = ["policies", "reply_docs", _STORE]


def triage_ctes(source: str, key: str, text: str, store: list = REPLY_STORE) -> list:
    """CTEs of the whole job: triaged(k, cleaned, intent, ..., ids, scores)."""
    return [
        store,
        "dim",
        ("cleaned_rows", f"SELECT {key} AS id, {s.redact(text)} AS cleaned FROM {source}"),
        s.heuristic("cleaned_rows", "id", "cleaned"),
        ("asked", "SELECT id, cleaned, md5(intent || chr(1) || cleaned) AS qid, p.* FROM cleaned_rows JOIN predicted p ON k = id"),
        ("questions", "SELECT qid, any_value(cleaned) AS text, any_value(intent) AS category FROM asked GROUP BY qid"),
        s.tfidf("questions", "store"),
        (
            "found",
            "SELECT qid, list(doc_id ORDER BY rank) AS ids, list(score ORDER BY rank) AS scores, list(content ORDER BY rank) AS contents, list(category ORDER BY rank) AS cats, "
            "list(title ORDER BY rank) AS titles FROM hits JOIN store USING (doc_ord) GROUP BY qid",
        ),
        (
            "triaged",
            f"SELECT id, cleaned, intent, confidence, {_ESC} AS escalate, {_WHY} AS escalate_reason, "
            f"CASE WHEN ids IS NULL THEN {s.q(fx.NO_DOCS_REPLY)} ELSE {s.q(fx.GREETING)} || regexp_replace(regexp_replace({s.strip('contents[1]')}, "
            rf"'\s*\^[A-Z]{{2,3}}\s*$', ''), '^@{s.WORD}+\s+', '') END AS draft_reply, coalesce(ids, []) AS ids, coalesce(scores, []) AS scores, coalesce(contents, []) AS contents, "
            "coalesce(cats, []) AS cats, coalesce(titles, []) AS titles, qualified "
            "FROM (SELECT *, len(list_filter(coalesce(scores, []), lambda x: x >= 0.15::DOUBLE)) AS qualified FROM asked LEFT JOIN found USING (qid)) z",
        ),
    ]


def store_index(spark, sf) -> retrieval.TermIndex:
    docs = precedents.corpus_union(policy_documents(spark, "orders"), seeds.reply_docs(spark, sf))
    return retrieval.tfidf_index(stage(docs, "store"))


def run_triage(spark, sf):
    return triage(seeds.messages(spark, sf), store_index(spark, sf))


_MSG = ["msgs", triage_ctes("msgs", "msg_id", "text")]


@query(
    "triage",
    s.with_(
        _MSG,
        "SELECT id AS msg_id, cleaned, intent, confidence, escalate, escalate_reason, draft_reply, array_to_string(ids, ',') AS citations, "
        "array_to_string(list_transform(scores, lambda x: printf('%.4f', x)), ',') AS scores FROM triaged",
    ),
)
def _(spark, sf):
    return run_triage(spark, sf).select(
        "msg_id",
        "cleaned",
        "intent",
        "confidence",
        "escalate",
        "escalate_reason",
        "draft_reply",
        F.array_join("citations", ",").alias("citations"),
        F.array_join(F.transform("grounding_sources", lambda g: F.format_string("%.4f", g["score"])), ",").alias("scores"),
    )


def _precedent_triage(spark, sf):
    """The job as it runs in production: precedents are chosen from the pairs, indexed, and searched."""
    docs = stage(precedents.build_precedents(seeds.pairs(spark, sf)), "store")
    return triage(seeds.messages(spark, sf), retrieval.tfidf_index(docs))


@query(
    "triage_with_precedents",
    s.with_(
        ["msgs", triage_ctes("msgs", "msg_id", "text", ["pairs", "policies", PRODUCTION_STORE])],
        "SELECT id AS msg_id, intent, escalate, draft_reply, array_to_string(ids, ',') AS citations FROM triaged",
    ),
)
def _(spark, sf):
    return _precedent_triage(spark, sf).select(
        "msg_id", "intent", "escalate", "draft_reply", F.array_join("citations", ",").alias("citations")
    )


@query(
    "flatten_state",
    s.with_(
        _MSG,
        "SELECT id AS query_id, cleaned AS cleaned_query, intent, confidence AS intent_confidence, len(ids)::INT AS retrieved_doc_count, draft_reply AS draft_response, "
        "escalate AS should_escalate, escalate_reason AS escalation_reason, array_to_string(ids, ',') AS citations FROM triaged",
    ),
)
def _(spark, sf):
    return flatten_state(run_triage(spark, sf))


@query(
    "grounding_sources",
    s.with_(
        _MSG,
        "SELECT id AS msg_id, unnest(ids) AS doc_id, unnest(scores) AS score, unnest(cats) AS category, unnest(titles) AS customer_issue, md5(unnest(contents)) AS content FROM triaged",
    ),
)
def _(spark, sf):
    return run_triage(spark, sf).select("msg_id", F.explode("grounding_sources").alias("g")).select(
        "msg_id", "g.doc_id", "g.score", "g.category", "g.customer_issue", F.md5("g.content").alias("content")
    )


@query("citations", s.with_(_MSG, "SELECT array_to_string(ids, ',') AS citations, count(*) AS n FROM triaged GROUP BY 1"))
def _(spark, sf):
    out = run_triage(spark, sf)
    return out.groupBy(F.array_join(drafting.citations(F.col("grounding_sources")), ",").alias("citations")).agg(F.count("*").alias("n"))


@query("draft_reply", s.with_(_MSG, "SELECT draft_reply, count(*) AS n FROM triaged GROUP BY 1"))
def _(spark, sf):
    return run_triage(spark, sf).groupBy("draft_reply").agg(F.count("*").alias("n"))


_LINES = (
    "list_transform(range(1, len(ids)::BIGINT + 1), lambda i: '[' || i || '] Document ID: ' || ids[i] || ' | Category: ' || cats[i] || ' | Score: ' || printf('%.2f', scores[i]) "
    f"|| chr(10) || '    Verified Content: \"' || {s.strip('contents[i]')} || '\"')"
)


@query(
    "prompt_context_block",
    s.with_(
        _MSG,
        "SELECT id AS msg_id, md5('CONVERSATION HISTORY:' || chr(10) || 'earlier turns' || chr(10) || chr(10) || CASE WHEN len(ids) = 0 THEN 'RETRIEVED PRECEDENTS: No verified precedents found.' "
        f"ELSE 'RETRIEVED PRECEDENTS & POLICY GUIDANCE:' || chr(10) || array_to_string({_LINES}, chr(10)) END) AS block FROM triaged",
    ),
)
def _(spark, sf):
    block = drafting.prompt_context(F.col("grounding_sources"), F.lit(" earlier turns "))
    return run_triage(spark, sf).select("msg_id", F.md5(block).alias("block"))


@query(
    "url_attestation",
    s.with_(
        ["pairs"],
        rf"SELECT pair_id, array_to_string(list_filter(regexp_extract_all(brand_reply || ' or ' || customer_message, {s.q(fx.URL_PATTERN)}), lambda u: NOT contains(brand_reply, u)), ' ') AS unattested FROM pairs",
    ),
)
def _(spark, sf):
    from parley.operators.judge import unattested_urls

    said = F.concat("brand_reply", F.lit(" or "), "customer_message")
    urls = unattested_urls(said, F.col("brand_reply"))
    return seeds.pairs(spark, sf).select("pair_id", F.array_join(urls, " ").alias("unattested"))
