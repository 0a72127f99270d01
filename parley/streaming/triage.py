"""Triage of messages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from parley.functions import text as tx
from parley.operators.retrieval import TermIndex
from parley.plans.triage import triage
from parley.session import path_exists, stage, staged_scope
from parley.streaming.ledger import Ledger


def accepted(messages: DataFrame) -> DataFrame:
    """Non-blank messages. No watermark is set, because Spark drops the rows that are older than it."""
    return messages.where(F.length(tx.strip(F.coalesce("text", F.lit("")))) > 0)


def _decided_ids(spark: SparkSession, out: str, messages: DataFrame, batch_id: int) -> DataFrame:
    kind = messages.schema["msg_id"].dataType.simpleString()
    rows = spark.read.schema(f"msg_id {kind}, batch long").parquet(out).where(F.col("batch") <= batch_id)
    return rows.select(F.col("msg_id").alias("_id"))


def triage_stream(
    messages: DataFrame,
    index: TermIndex,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    **triage_options,
) -> StreamingQuery:
    """Write a decision per arriving message (msg_id, text) to parquet under `out`, each id once, however late it comes.

    Ids are looked up in a ledger beside the checkpoint, of which a batch reads only the parts its ids fall into; event
    time plays no part. Messages without an id cannot be told from one another: each gets its decision.
    A new checkpoint takes an empty `out` only. A checkpoint without a ledger has it built from the decisions once.

    Top-k needs a window, which streams do not allow, so each micro-batch runs the batch job against the staged
    index. A batch overwrites its own folders, so a replay after a failure leaves no duplicates. What a batch stages is
    deleted once its decisions are written, or have failed to be.
    """
    spark = messages.sparkSession
    if path_exists(spark, out) and not path_exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{out} holds decisions, but {checkpoint} is new and would write over them")
    ledger_folder = f"{checkpoint.rstrip('/')}-ledger"

    def score(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        ledger = Ledger(session, ledger_folder, batch.schema["msg_id"].dataType)
        with staged_scope(session):
            if not ledger.has(batch_id - 1):
                ledger.rebuild(_decided_ids(session, out, batch, batch_id - 1), batch_id - 1)
            named = stage(batch.where("msg_id is not null").dropDuplicates(["msg_id"]), "arrived")
            known = ledger.seen(named.select(F.col("msg_id").alias("_id")), batch_id)
            new = named.join(known, F.col("msg_id") == F.col("_id"), "left_anti")
            fresh = stage(new.unionByName(batch.where("msg_id is null")), "fresh")
            triage(fresh, index, **triage_options).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            ledger.add(fresh.where("msg_id is not null").select(F.col("msg_id").alias("_id")), batch_id)

    return (
        accepted(messages)
        .select("msg_id", "text")
        .writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
