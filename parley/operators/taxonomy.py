"""Intent dimension and the policy documents made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import schemas
from parley.fixed.taxonomy import INTENTS

INTENT_NAMES = [d["category"] for d in INTENTS]
MANDATORY = [d["category"] for d in INTENTS if d["requires_human_escalation"]]
RISK = {d["category"]: d["risk_level"] for d in INTENTS}
OTHER = "other_unclear"


def taxonomy_dim(spark: SparkSession) -> DataFrame:
    """Twelve rows, one per intent."""
    fields = [f.strip().split(" ")[0] for f in schemas.TAXONOMY.split(",")][1:]
    rows = [(i, *[d[f] for f in fields]) for i, d in enumerate(INTENTS)]
    return spark.createDataFrame(rows, schemas.TAXONOMY)


def taxonomy_lookup(df: DataFrame, intent: str) -> DataFrame:
    """Add risk level, mandatory-handoff flag and guidance for the intent in a column."""
    dim = taxonomy_dim(df.sparkSession).select(
        F.col("category").alias(intent), "risk_level", "requires_human_escalation", "resolution_guidance"
    )
    return df.join(F.broadcast(dim), intent, "left")


def policy_documents(spark: SparkSession, source: str = "taxonomy") -> DataFrame:
    """One policy document per intent."""
    return taxonomy_dim(spark).select(
        F.col("intent_ord").cast("long").alias("doc_ord"),
        F.concat(F.lit("POLICY_"), F.upper("category")).alias("doc_id"),
        F.col("name").alias("title"),
        "category",
        F.concat(F.lit("POLICY GUIDANCE: "), "resolution_guidance", F.lit("\nSCOPE: "), "description").alias("content"),
        F.lit(source).alias("source_url_or_id"),
        F.lit(True).alias("is_policy"),
    )
