"""Views over the given tables, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions import text as tx
from parley.operators.policy import gold_escalation_label
from parley.session import spread
from parley.workload.phrases import PHRASES, REPLIES, REPLY_KEYS, TAILS

TIER_OF_PRIORITY = {
    "1-URGENT": "high_risk",
    "2-HIGH": "multi_issue",
    "3-MEDIUM": "routine",
    "4-NOT SPECIFIED": "ambiguous",
    "5-LOW": "angry_profane",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def _choice(texts: list[str], index: Column, n: Column | None = None) -> Column:
    """texts[index], with {n} filled in."""
    picked = F.get(F.expr(tx.literals(texts)), index.cast("int"))
    return picked if n is None else F.replace(picked, F.lit("{n}"), n.cast("string"))


def _phrase_index() -> Column:
    return F.col("o_orderkey") % len(PHRASES)


def _message(key: Column, customer: Column) -> Column:
    return F.concat(
        _choice([p for _, p in PHRASES], key % len(PHRASES)), _choice(TAILS, customer % len(TAILS), customer)
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """msg_id, text, created_at: one message per order."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("msg_id"),
        _message(F.col("o_orderkey"), F.col("o_custkey")).alias("text"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("not a date"))
        .otherwise(tx.format_created_at(F.col("o_orderdate").cast("timestamp")))
        .alias("created_at"),
    )


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold records: label of the phrase, tier from the order priority, escalation from the label rules."""
    o = table(spark, sf, "orders")
    phrase = _choice([p for _, p in PHRASES], _phrase_index())
    tier = F.lit("routine")
    for priority, name in TIER_OF_PRIORITY.items():
        tier = F.when(F.col("o_orderpriority") == priority, F.lit(name)).otherwise(tier)
    rows = o.select(
        F.format_string("GOLDEN_%09d", "o_orderkey").alias("id"),
        _message(F.col("o_orderkey"), F.col("o_custkey")).alias("message_text"),
        F.lit(fx.NO_CONTEXT).alias("thread_context"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("turn_index"),
        _choice([i for i, _ in PHRASES], _phrase_index()).alias("true_intent"),
        F.when(F.length(phrase) < 8, F.lit("low_signal")).otherwise(tier).alias("difficulty"),
        _choice(REPLIES, (F.col("o_orderkey") + F.col("o_custkey")) % len(REPLIES), F.col("o_custkey") % REPLY_KEYS).alias(
            "reference_brand_reply"
        ),
    )
    label = gold_escalation_label(F.col("true_intent"), F.col("message_text"), F.col("difficulty"))
    return rows.withColumn("_l", label).select(
        "id",
        "message_text",
        "thread_context",
        "turn_index",
        "true_intent",
        F.col("_l.escalate").alias("true_escalate"),
        F.col("_l.reason").alias("escalate_reason"),
        "difficulty",
        F.lit(fx.REVIEW_PENDING).alias("review_status"),
        "reference_brand_reply",
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Dialogue pairs: one per order."""
    o = table(spark, sf, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.format_string("amz_%d_%d", key, key + 1_000_000_000).alias("pair_id"),
        customer.cast("string").alias("conversation_id"),
        (key % 4 + 1).cast("int").alias("turn_index"),
        key.cast("string").alias("customer_tweet_id"),
        (key + 1_000_000_000).cast("string").alias("brand_tweet_id"),
        _message(key, customer).alias("customer_message"),
        _choice(REPLIES, (key + customer) % len(REPLIES), customer % REPLY_KEYS).alias("brand_reply"),
        F.when(key % 4 == 0, F.lit(fx.NO_CONTEXT))
        .otherwise(F.lit("[Customer]: hello | [AmazonHelp]: how can we help?"))
        .alias("thread_context"),
        F.when(key % 50 == 0, F.lit("not a date"))
        .otherwise(tx.format_created_at(F.col("o_orderdate").cast("timestamp")))
        .alias("customer_created_at"),
    )


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Raw messages with branching reply threads: blocks of 64 events, each a binary tree."""
    e = table(spark, sf, "events")
    key = F.col("event_id")
    off = key % 64
    brand = F.col("event_type").isin("purchase", "click")
    other = F.col("event_type") == "error"
    return e.select(
        (key + 1).alias("tweet_id"),
        F.when(brand, F.lit(fx.BRAND))
        .when(other, F.lit("OtherBrand"))
        .otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string")))
        .alias("author_id"),
        (~(brand | other)).alias("inbound"),
        tx.format_created_at(F.col("ts")).alias("created_at"),
        F.concat(F.lit("@x"), F.col("user_id").cast("string"), F.lit(" "), _message(key, F.col("user_id"))).alias("text"),
        F.lit(None).cast("string").alias("response_tweet_id"),
        F.when(key % 97 == 5, key + 1_000_000_000_000)
        .when(off > 0, key - off + F.floor(off / 2) + 1)
        .alias("in_response_to_tweet_id"),
    )


def chat(spark: SparkSession, sf: str) -> DataFrame:
    """Raw messages from conversations: users are customers, assistants the brand, system turns are left out."""
    c = table(spark, sf, "conversations")
    key = F.col("conv_id") * 1_000_000 + F.col("turn") + 1
    return c.where("role <> 'system'").select(
        key.alias("tweet_id"),
        F.when(F.col("role") == "assistant", F.lit(fx.BRAND))
        .otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
        .alias("author_id"),
        (F.col("role") == "user").alias("inbound"),
        F.lit(None).cast("string").alias("created_at"),
        "text",
        F.lit(None).cast("string").alias("response_tweet_id"),
        F.when(F.col("turn") > 0, key - 1).alias("in_response_to_tweet_id"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("role <> 'system'")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("role").alias("author_id"),
        (F.col("role") == "assistant").alias("is_brand_reply"),
        "text",
        F.col("turn").alias("pos"),
        F.create_map(F.lit("category"), F.when(F.col("turn") % 3 == 0, F.lit("returns_refunds"))).alias("metadata"),
    )


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as an index corpus; the language is the category."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("doc_ord"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.col("source").alias("title"),
        F.col("lang").alias("category"),
        F.col("text").alias("content"),
        F.lit(False).alias("is_policy"),
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as questions; two of three ask for a category."""
    b = table(spark, sf, "benchmark")
    kind = F.col("item_id") % 3
    return b.select(
        F.col("item_id").cast("string").alias("qid"),
        "text",
        F.when(kind == 0, F.lit("en")).when(kind == 1, F.lit("de")).alias("category"),
    )


def reply_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct brand replies as documents, labelled by the customer's phrase, in order of first use."""
    o = table(spark, sf, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(
        key,
        _choice(REPLIES, (key + customer) % len(REPLIES), customer % REPLY_KEYS).alias("content"),
        _choice([i for i, _ in PHRASES], _phrase_index()).alias("category"),
        _message(key, customer).alias("title"),
    )
    first = rows.groupBy("content").agg(
        F.min("o_orderkey").alias("doc_ord"), F.min_by(F.struct("category", "title"), "o_orderkey").alias("f")
    )
    return first.select(
        (F.col("doc_ord") + 12).alias("doc_ord"),
        F.format_string("REPLY_%d", "doc_ord").alias("doc_id"),
        F.col("f.title").alias("title"),
        F.col("f.category").alias("category"),
        "content",
        F.lit("orders").alias("source_url_or_id"),
        F.lit(False).alias("is_policy"),
    )
