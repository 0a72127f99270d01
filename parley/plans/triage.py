"""Triage of a message table: redact, score intents, retrieve, draft, decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import schemas
from parley.functions import text as tx
from parley.functions.rates import rounded
from parley.operators.drafting import citations, draft_reply, grounding_sources, qualified_count
from parley.operators.intents import heuristic_intent
from parley.operators.policy import TRIAGE_POLICY, PolicyConfig, escalation_policy
from parley.operators.retrieval import TermIndex, tfidf_search, with_documents
from parley.session import stage

Classifier = Callable[[DataFrame, str], DataFrame]
Retriever = Callable[[DataFrame], DataFrame]


def pattern_classifier(df: DataFrame, text: str) -> DataFrame:
    """The default classifier: the pattern pack without the probability map, which triage does not return."""
    return heuristic_intent(df, text, probabilities=False)


def classify(messages: DataFrame, classifier: Classifier = pattern_classifier) -> DataFrame:
    """Redacted text, prediction, and the key that equal (intent, text) questions share."""
    cleaned = messages.withColumn("cleaned", tx.redact(F.col("text")))
    return classifier(cleaned, "cleaned").withColumn(
        "qid", F.md5(F.concat_ws("\u0001", F.coalesce("intent", F.lit("")), "cleaned"))
    )


def retrieve(classified: DataFrame, retriever: Retriever) -> DataFrame:
    """(qid, sources) for each distinct question. Copies of a message are searched once."""
    questions = classified.groupBy("qid").agg(
        F.any_value("cleaned").alias("text"), F.any_value("intent").alias("category")
    )
    return grounding_sources(retriever(questions))


def index_retriever(index: TermIndex) -> Retriever:
    return lambda questions: with_documents(tfidf_search(questions, index), index.docs)


def triage(
    messages: DataFrame,
    index: TermIndex | None = None,
    *,
    classifier: Classifier = pattern_classifier,
    retriever: Retriever | None = None,
    drafter: Callable[[Column], Column] = draft_reply,
    policy: PolicyConfig = TRIAGE_POLICY,
    staged: bool = True,
) -> DataFrame:
    """One decision and draft per message (msg_id, text).

    With `staged`, the scored table is written once, because both the search and the final join read it. A reply is
    drafted for every message, escalated or not.
    """
    keep = ["msg_id", "text", "cleaned", "qid", "intent", "confidence", "is_ambiguous", "margin", "explanation"]
    classified = classify(messages.select("msg_id", "text"), classifier).select(*keep)
    if staged:
        classified = stage(classified, "classified")
    found = retrieve(classified, retriever or index_retriever(index))
    if staged:
        # One row per question. The join shuffles both sides directly, so a question that very many messages share is
        # split by adaptive execution, and a small result is broadcast by its true size.
        found = stage(found, "found")
    none = F.array().cast(schemas.SOURCES)
    joined = classified.join(found, "qid", "left").withColumn("grounding_sources", F.coalesce("sources", none))
    decided = joined.withColumn(
        "_decision",
        escalation_policy(
            F.col("cleaned"),
            F.col("intent"),
            F.col("confidence"),
            F.col("is_ambiguous"),
            qualified_count(F.col("grounding_sources"), policy.min_retrieval_score),
            policy,
        ),
    )
    return decided.select(
        "msg_id",
        "cleaned",
        "intent",
        rounded("confidence", 4).alias("confidence"),
        F.col("_decision.escalate").alias("escalate"),
        F.col("_decision.reason").alias("escalate_reason"),
        drafter(F.col("grounding_sources")).alias("draft_reply"),
        citations(F.col("grounding_sources")).alias("citations"),
        "grounding_sources",
    )


def flatten_state(triaged: DataFrame) -> DataFrame:
    """Flat record per message with the number of retrieved documents."""
    return triaged.select(
        F.col("msg_id").alias("query_id"),
        F.col("cleaned").alias("cleaned_query"),
        "intent",
        F.col("confidence").alias("intent_confidence"),
        F.size("grounding_sources").alias("retrieved_doc_count"),
        F.col("draft_reply").alias("draft_response"),
        F.col("escalate").alias("should_escalate"),
        F.col("escalate_reason").alias("escalation_reason"),
        F.array_join("citations", ",").alias("citations"),
    )
