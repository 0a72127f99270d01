"""Gold set: stratified pick, fill, curated rows, review queue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley import schemas
from parley.fixed import wording as fx
from parley.fixed.gold_strata import CURATED_ROWS, GOLD_STRATA
from parley.functions import text as tx
from parley.functions.prefilter import fold
from parley.operators.assignment import WALK_ROWS, assign
from parley.operators.intents import heuristic_intent
from parley.operators.policy import gold_escalation_label
from parley.operators.taxonomy import MANDATORY
from parley.operators.threads import PAIR_ORDER
from parley.operators.topn import first_per_group, number_rows
from parley.session import stage

GOLD_COLUMNS = [f.strip().split(" ")[0] for f in schemas.GOLD.split(",")]


def gold_candidates(pairs: DataFrame) -> DataFrame:
    """English pairs whose reply has more than ten characters."""
    return pairs.where(tx.is_english(F.col("customer_message")) & (F.length("brand_reply") > 10))


def exclude_used(pool: DataFrame, used: DataFrame, key: str = "pair_id") -> DataFrame:
    return pool.join(used.select(key), key, "left_anti")


def stratified_pick(
    candidates: DataFrame, order: list[str] = PAIR_ORDER, scale: int = 1, walk_rows: int = WALK_ROWS
) -> DataFrame:
    """For each stratum in turn, its first matching rows that no earlier stratum took; quotas are multiplied by `scale`.

    Earlier strata can take at most the sum of their quotas, so the first rows of each stratum up to the sum of all
    quotas decide the result. Those few are found with distributed steps and then walked. Where they can be more than
    `walk_rows`, parallel rounds settle the same selection instead.
    """
    quotas = [q * scale for _, _, _, q in GOLD_STRATA]
    bound = sum(quotas)
    folded = candidates.withColumn("_folded", fold(F.col("customer_message")))
    patterns = [p for _, p, _, _ in GOLD_STRATA]
    tagged = folded.select(
        F.explode(F.expr(tx.which_sql("customer_message", patterns, "_folded"))).alias("stratum"),
        F.struct(*order).alias("pos"),
        "pair_id",
    )
    if len(quotas) * bound > walk_rows:
        quota = F.get(F.array(*[F.lit(q) for q in quotas]), F.col("stratum"))
        taken = assign(tagged, "pair_id", "stratum", "stratum", "pos", quota, max(quotas))
        flat = taken.select("stratum", "pair_id", *[F.col("pos")[c].alias(f"o{i}") for i, c in enumerate(order)])
        placed = number_rows(flat, ["stratum", *[f"o{i}" for i in range(len(order))]])
        return candidates.join(placed.select(F.col("position").cast("long").alias("gold_ord"), "stratum", "pair_id"), "pair_id")
    few = first_per_group(tagged, ["stratum"], [F.col("pos")], bound, spread=F.col("pair_id"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for stratum, part in rows.sort_values(["stratum", "rank"]).groupby("stratum", sort=True):
            free = [p for p in part["pair_id"] if p not in used][: quotas[stratum]]
            used.update(free)
            out += [(stratum, p) for p in free]
        return pd.DataFrame(
            [(i + 1, s, p) for i, (s, p) in enumerate(out)], columns=["gold_ord", "stratum", "pair_id"]
        )

    picked = few.select("stratum", "rank", "pair_id").groupBy(F.lit(1).alias("all")).applyInPandas(
        walk, "gold_ord long, stratum int, pair_id string"
    )
    # At most `bound` rows.
    return candidates.join(F.broadcast(picked), "pair_id")


def _gold_rows(rows: DataFrame) -> DataFrame:
    """Rows with gold_ord, true_intent and difficulty to gold records."""
    message = tx.strip(F.col("customer_message"))
    return (
        rows.withColumn("message_text", message)
        .withColumn("_label", gold_escalation_label(F.col("true_intent"), F.col("message_text"), F.col("difficulty")))
        .select(
            F.format_string("GOLDEN_%03d", "gold_ord").alias("id"),
            "message_text",
            tx.strip(F.col("thread_context")).alias("thread_context"),
            "turn_index",
            "true_intent",
            F.col("_label.escalate").alias("true_escalate"),
            F.col("_label.reason").alias("escalate_reason"),
            "difficulty",
            F.lit(fx.REVIEW_PENDING).alias("review_status"),
            tx.strip(F.col("brand_reply")).alias("reference_brand_reply"),
        )
    )


def _pick_labels(picked: DataFrame) -> DataFrame:
    intents = F.expr(tx.literals([i for i, _, _, _ in GOLD_STRATA]))
    tiers = F.expr(tx.literals([t for _, _, t, _ in GOLD_STRATA]))
    return picked.withColumn("true_intent", F.get(intents, F.col("stratum"))).withColumn(
        "difficulty", F.get(tiers, F.col("stratum"))
    )


def gold_pick(pairs: DataFrame) -> DataFrame:
    return _gold_rows(_pick_labels(stratified_pick(gold_candidates(pairs))))


def gold_fill(candidates: DataFrame, used: DataFrame, start: int, needed: int, seed: int = 42) -> DataFrame:
    """Pseudo-random unused rows, labelled by the pattern pack, numbered after the picked ones."""
    order = tx.hash_order(seed, F.col("pair_id"))
    drawn = exclude_used(candidates, used).orderBy(order, "pair_id").limit(needed)
    labelled = heuristic_intent(drawn.withColumn("_msg", tx.strip(F.col("customer_message"))), "_msg", probabilities=False)
    tiered = labelled.withColumn("difficulty", F.when(F.col("is_ambiguous"), "ambiguous").otherwise("routine"))
    # `needed` is a parameter of the job, so this window is small.
    numbered = first_per_group(
        tiered.withColumn("_all", F.lit(1)).withColumn("_hash", order), ["_all"], [F.col("_hash"), F.col("pair_id")], needed, "gold_ord", F.col("pair_id")
    ).withColumn("gold_ord", F.col("gold_ord") + start)
    return _gold_rows(numbered.withColumnRenamed("intent", "true_intent"))


def build_gold(pairs: DataFrame, target: int = fx.GOLD_TARGET, seed: int = 42) -> DataFrame:
    """Stratified pick, filled up to the target size."""
    candidates = gold_candidates(pairs)
    picked = stage(stratified_pick(candidates), "gold-pick")
    count = picked.count()
    rows = _gold_rows(_pick_labels(picked))
    if count >= target:
        return rows
    return rows.unionByName(gold_fill(candidates, picked, count, target - count, seed))


def curated_gold(pairs: DataFrame, order: list[str] = PAIR_ORDER) -> DataFrame:
    """The first corpus row that matches each curated pattern, or the curated text itself."""
    message = F.col("customer_message")
    english = pairs.where(tx.ascii_share(message) > 0.88).withColumn("_folded", fold(message))
    found = (
        english.select(
            F.explode(F.expr(tx.which_sql("customer_message", [d["pattern"] for d in CURATED_ROWS], "_folded"))).alias("idx"),
            F.struct(*order).alias("pos"),
            F.struct(
                tx.strip(message).alias("message_text"),
                "thread_context",
                tx.strip(F.col("brand_reply")).alias("reference_brand_reply"),
                "turn_index",
            ).alias("row"),
        )
        .groupBy("idx")
        .agg(F.min_by("row", "pos").alias("row"))
    )
    fields = ["message_text", "thread_context", "reference_brand_reply", "true_intent", "true_escalate", "escalate_reason", "difficulty"]
    types = ["string", "string", "string", "string", "boolean", "string", "string"]
    dim = pairs.sparkSession.createDataFrame(
        [(i, *[d[f] for f in fields]) for i, d in enumerate(CURATED_ROWS)],
        "idx int, " + ", ".join(f"{f} {t}" for f, t in zip(fields, types)),
    )
    joined = dim.join(found, "idx", "left")
    pick = lambda f: F.when(F.col("row").isNotNull(), F.col("row")[f]).otherwise(F.col(f)).alias(f)
    return joined.select(
        F.format_string("GOLDEN_%03d", F.col("idx") + 1).alias("id"),
        pick("message_text"),
        pick("thread_context"),
        F.coalesce(F.col("row.turn_index"), F.lit(1)).alias("turn_index"),
        "true_intent",
        "true_escalate",
        "escalate_reason",
        "difficulty",
        F.lit(fx.REVIEW_PENDING).alias("review_status"),
        pick("reference_brand_reply"),
    )


def review_queue(gold: DataFrame, audit_percent: int = 20, seed: int = 42) -> DataFrame:
    """Every risky or edge-case row and a pseudo-random audit of the remaining routine rows."""
    must = F.col("true_intent").isin(MANDATORY) | F.col("difficulty").isin("ambiguous", "multi_issue")
    audit = (F.col("difficulty") == "routine") & (tx.hash_percent(seed, F.col("id")) < audit_percent)
    return gold.where(must | audit).withColumn(
        "review_reason", F.when(must, F.lit("mandatory")).otherwise(F.lit("audit"))
    )


def gold_field_aliases(raw: DataFrame, documents: bool = False) -> DataFrame:
    """Older field names and defaults to the current gold columns; with `documents` also the expected doc_ids."""
    expected = [F.coalesce("grounding_doc_ids", F.array().cast("array<string>")).alias("grounding_doc_ids")] if documents else []
    not_empty = lambda c: F.when(c != "", c)
    return raw.select(
        "id",
        F.coalesce(not_empty(F.col("message_text")), F.col("query"), F.lit("")).alias("message_text"),
        F.coalesce(not_empty(F.col("true_intent")), F.col("expected_intent")).alias("true_intent"),
        F.coalesce("true_escalate", "expected_escalate", F.lit(False)).alias("true_escalate"),
        F.coalesce("difficulty", F.lit("routine")).alias("difficulty"),
        *expected,
    )
