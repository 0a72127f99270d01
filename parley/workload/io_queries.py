"""Queries that write a table with a sink, read it back with a source, and return what arrived."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.operators.precedents import corpus_union
from parley.operators.taxonomy import policy_documents
from parley.operators.threads import PAIR_ORDER
from parley.plans import evaluate as plan
from parley.session import stage_root
from parley.sources import readers, writers
from parley.streaming.triage import triage_stream
from parley.workload import seeds
from parley.workload import sql as s
from parley.workload.label_queries import KEYWORD_RUN, keyword_run
from parley.workload.metric_queries import _RUNS, RATES, prf_sql, rates_sql, tier_sql
from parley.workload.registry import query
from parley.workload.search_queries import _MSG, _STORE, store_index


def _folder(spark, name: str) -> str:
    return f"{stage_root(spark)}/parley/{name}-{uuid.uuid4().hex}"


# Ids of 19 digits, which a double cannot hold.
_SHIFT = 1_000_000_000_000_000_001
_RAW_SQL = (
    f"SELECT tweet_id + {_SHIFT} AS tweet_id, author_id, inbound, created_at, text, "
    f"in_response_to_tweet_id + {_SHIFT} AS in_response_to_tweet_id FROM tree"
)
_RAW_COLS = ["tweet_id", "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id"]


@query("scan_messages_csv", s.with_(["tree"], _RAW_SQL))
def _(spark, sf):
    path = _folder(spark, "dump")
    parent = F.concat((F.col("in_response_to_tweet_id") + _SHIFT).cast("string"), F.lit(".0"))
    dump = seeds.tree(spark, sf).withColumns({"tweet_id": F.col("tweet_id") + _SHIFT, "in_response_to_tweet_id": parent})
    dump.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_messages(spark, path, _RAW_COLS)


@query("scan_messages_csv_multiline", s.with_(["chat"], "SELECT tweet_id, author_id, inbound, text FROM chat"))
def _(spark, sf):
    # Conversation texts hold quotes and line breaks.
    path = _folder(spark, "dump")
    seeds.chat(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return readers.read_messages(spark, path, ["tweet_id", "author_id", "inbound", "text"])


_PAIR_COLS = "pair_id, conversation_id, turn_index, customer_message, brand_reply, thread_context, customer_created_at"


@query("scan_pairs_parquet", s.with_(["pairs"], f"SELECT {_PAIR_COLS} FROM pairs"))
def _(spark, sf):
    path = _folder(spark, "pairs")
    seeds.pairs(spark, sf).write.parquet(path)
    return readers.read_pairs(spark, path).select(*_PAIR_COLS.split(", "))


@query(
    "sink_pairs",
    s.with_(
        ["pairs"],
        f"SELECT 'all' AS part, pair_id, customer_message, brand_reply FROM pairs UNION ALL SELECT * FROM (SELECT 'sample', pair_id, customer_message, brand_reply FROM pairs ORDER BY {', '.join(PAIR_ORDER)} LIMIT 50)",
    ),
)
def _(spark, sf):
    path = _folder(spark, "export")
    pairs = seeds.pairs(spark, sf)
    writers.write_pairs(pairs, path)
    cols = ["pair_id", "customer_message", "brand_reply"]
    back = spark.read.schema(pairs.schema).option("header", True).option("escape", '"')
    rows = back.csv(f"{path}/pairs_csv").select(F.lit("all").alias("part"), *cols)
    return rows.unionByName(back.csv(f"{path}/pairs_sample").select(F.lit("sample").alias("part"), *cols))


_DOCS = "SELECT doc_ord, doc_id, title, category, content, is_policy FROM store"


@query("sink_precedents", s.with_(["policies", "reply_docs", _STORE], _DOCS))
def _(spark, sf):
    path = _folder(spark, "precedents")
    writers.write_precedents(corpus_union(policy_documents(spark, "orders"), seeds.reply_docs(spark, sf)), path, by_category=True)
    return readers.load_precedents(spark, path).select("doc_ord", "doc_id", "title", "category", "content", "is_policy")


@query("load_precedents", s.with_(["reply_docs"], "SELECT doc_ord, doc_id, title, FALSE AS is_policy FROM reply_docs"))
def _(spark, sf):
    # is_policy is absent from the file; a path that does not exist adds nothing.
    path = _folder(spark, "precedents")
    seeds.reply_docs(spark, sf).drop("is_policy").write.parquet(path)
    cols = ["doc_ord", "doc_id", "title", "is_policy"]
    return readers.load_precedents(spark, path).select(cols).unionByName(readers.load_precedents(spark, path + "-absent").select(cols))


_GOLD_COLS = "id, message_text, thread_context, turn_index, true_intent, true_escalate, escalate_reason, difficulty, review_status, reference_brand_reply"


@query("sink_gold_jsonl", s.with_(["gold"], f"SELECT {_GOLD_COLS} FROM gold"))
def _(spark, sf):
    path = _folder(spark, "gold")
    writers.write_gold(seeds.gold(spark, sf), path)
    return readers.read_gold(spark, path)


@query("scan_gold_jsonl", s.with_(["gold"], f"SELECT {_GOLD_COLS} FROM gold"))
def _(spark, sf):
    # Each record is preceded by a blank line and a comment.
    path = _folder(spark, "gold")
    gold = seeds.gold(spark, sf)
    lines = gold.select(F.concat(F.lit("  \n# "), "id", F.lit("\n"), F.to_json(F.struct(*gold.columns))).alias("value"))
    lines.write.text(path)
    return readers.read_gold(spark, path)


_RESULT_COLS = "id, difficulty, true_intent, predicted_intent, true_escalate, predicted_escalate"


def _results(spark, sf):
    return keyword_run(spark, sf).select(*_RESULT_COLS.split(", "))


@query("sink_result_json", s.with_(KEYWORD_RUN, f"SELECT {_RESULT_COLS} FROM base"))
def _(spark, sf):
    path = _folder(spark, "results")
    writers.write_records(_results(spark, sf), path)
    return readers.read_records(spark, path, lines=True).select(*_RESULT_COLS.split(", "))


@query("scan_result_records", s.with_(KEYWORD_RUN, f"SELECT {_RESULT_COLS} FROM base"))
def _(spark, sf):
    """Files that each hold one JSON array of records."""
    path = _folder(spark, "result-arrays")
    writers.write_record_arrays(_results(spark, sf), path, ["id"], 500)
    return readers.read_records(spark, path).select(*_RESULT_COLS.split(", "))


@query("scan_result_json_array", s.with_(_RUNS, rates_sql("runs", "system")))
def _(spark, sf):
    """Nested baseline results: one JSON object with a map of systems, as written by the summary sink."""
    from parley.operators import baselines, metrics

    path = _folder(spark, "baselines")
    rates = metrics.escalation_rates(baselines.baseline_runs(seeds.gold(spark, sf)), ["system"])
    # Three systems.
    body = F.struct(
        F.col("total").alias("total_samples"),
        *RATES,
        F.struct(
            F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("tn").alias("true_negatives"), F.col("fn").alias("false_negatives")
        ).alias("escalation_confusion"),
    )
    nested = rates.agg(F.map_from_entries(F.collect_list(F.struct("system", body))).alias("baselines"))
    writers.write_records(nested, path)
    return readers.read_baseline_results(spark, path).select(
        "system", F.col("total_samples").alias("total"), "tp", "fp", "tn", "fn", *RATES
    )


@query(
    "summary_json",
    s.with_(
        KEYWORD_RUN,
        "SELECT 'intent' AS part, intent AS key, f1 AS value FROM (" + prf_sql("base") + ") UNION ALL SELECT 'tier', difficulty, intent_accuracy FROM (" + tier_sql("base") + ")"
        f" UNION ALL SELECT 'all', 'escalation_recall', escalation_recall FROM ({rates_sql('base')})",
    ),
)
def _(spark, sf):
    path = _folder(spark, "summary")
    records = _results(spark, sf).withColumn(
        "judge_evaluation",
        F.struct(*[F.lit(5).alias(a) for a in ("grounding_score", "correctness_score", "tone_score", "completeness_score")], F.lit(5.0).alias("overall_score"), F.lit(True).alias("passed")),
    )
    writers.write_records(plan.summary(records), path)
    schema = (
        "escalation_metrics struct<escalation_recall:double>, per_intent_metrics map<string,struct<f1:double>>, "
        "tier_stratification map<string,struct<intent_accuracy:double>>"
    )
    row = readers.read_records(spark, path, schema)
    intents = row.select(F.explode("per_intent_metrics").alias("key", "v")).select(F.lit("intent").alias("part"), "key", F.col("v.f1").alias("value"))
    tiers = row.select(F.explode("tier_stratification").alias("key", "v")).select(F.lit("tier").alias("part"), "key", F.col("v.intent_accuracy").alias("value"))
    whole = row.select(F.lit("all").alias("part"), F.lit("escalation_recall").alias("key"), F.col("escalation_metrics.escalation_recall").alias("value"))
    return intents.unionByName(tiers).unionByName(whole)


@query(
    "triage_stream",
    s.with_(_MSG, "SELECT id AS msg_id, intent, escalate, escalate_reason, draft_reply, array_to_string(ids, ',') AS citations FROM triaged"),
)
def _(spark, sf):
    """Messages arrive as files, each twice; every id is scored once."""
    inbox, out = _folder(spark, "inbox"), _folder(spark, "stream")
    messages = seeds.messages(spark, sf).select("msg_id", "text", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    blank = messages.select((-F.col("msg_id") - 1).alias("msg_id"), F.lit("  ").alias("text"), "ts")
    messages.unionByName(messages).unionByName(blank).write.parquet(inbox)
    stream = spark.readStream.schema(messages.schema).parquet(inbox)
    triage_stream(stream, store_index(spark, sf), out, _folder(spark, "stream-state")).awaitTermination()
    done = spark.read.parquet(out)
    return done.select("msg_id", "intent", "escalate", "escalate_reason", "draft_reply", F.array_join("citations", ",").alias("citations"))
