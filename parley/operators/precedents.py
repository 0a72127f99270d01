"""Precedent corpus: capped, deduplicated past replies beside the policy documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions import text as tx
from parley.operators.assignment import WALK_ROWS, assign
from parley.operators.intents import heuristic_intent
from parley.operators.taxonomy import INTENT_NAMES, policy_documents
from parley.operators.threads import PAIR_ORDER
from parley.operators.topn import first_per_group, number_rows

N_POLICIES = len(INTENT_NAMES)


def usable_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.length("customer_message") > 15) & (F.length("brand_reply") > 20))


def brand_turn_documents(turns: DataFrame) -> DataFrame:
    """Brand turns of ten or more characters as documents."""
    return turns.where(F.col("is_brand_reply") & (F.length(tx.strip(F.col("text"))) >= 10)).select(
        F.col("turn_id").alias("doc_id"),
        F.col("text").alias("content"),
        F.col("metadata")["category"].alias("category"),
        F.col("conversation_id").alias("source_url_or_id"),
    )


def _caps(default: int, special: dict[str, int]) -> Column:
    out = F.lit(default)
    for intent, cap in special.items():
        out = F.when(F.col("category") == intent, F.lit(cap)).otherwise(out)
    return out


def greedy_cap(
    pairs: DataFrame,
    cap: int = fx.COMMON_CAP,
    special_caps: dict[str, int] | None = None,
    stop_at: int | None = None,
    order: list[str] = PAIR_ORDER,
    walk_rows: int = WALK_ROWS,
) -> DataFrame:
    """Walk the pairs in order; accept one unless its reply signature is already accepted or its intent is full.

    The walk is sequential, but only few rows can matter. Of equal (signature, intent) rows only the first can be
    accepted. At most `stop_at` signatures are accepted, so at most that many rows of an intent can be passed over
    for their signature, and the first cap + stop_at rows of each intent decide everything. Those are found with
    distributed steps; the walk itself sees a number of rows set by the parameters, whatever the corpus size.
    Where the parameters allow more than `walk_rows`, parallel rounds settle the same selection instead.
    """
    special = special_caps or {}
    total = sum(special.get(i, cap) for i in INTENT_NAMES)
    stop = total if stop_at is None else max(min(stop_at, total), 1)
    known = usable_pairs(pairs).select(
        *order,
        "pair_id",
        "turn_index" if "turn_index" not in order else F.lit(None).alias("_none"),
        tx.strip(F.col("customer_message")).alias("title"),
        tx.strip(F.col("brand_reply")).alias("content"),
        F.concat(F.lit("conversation_"), "conversation_id").alias("source_url_or_id"),
    )
    labelled = heuristic_intent(known.drop("_none"), "title", probabilities=False).withColumnRenamed("intent", "category")
    rows = labelled.select(
        tx.reply_signature(F.col("content")).alias("signature"),
        "category",
        F.struct(*order).alias("pos"),
        F.struct("pair_id", "title", "content", "source_url_or_id").alias("doc"),
    )
    firsts = rows.groupBy("signature", "category").agg(
        F.min("pos").alias("pos"), F.min_by("doc", "pos").alias("doc")
    )
    most = max([cap, *special.values()])
    if len(INTENT_NAMES) * (most + stop) > walk_rows:
        taken = assign(firsts, "signature", "category", "pos", "pos", _caps(cap, special), most)
        flat = taken.select("category", *[F.col("pos")[c].alias(f"o{i}") for i, c in enumerate(order)], "doc.*")
        placed = number_rows(flat, [f"o{i}" for i in range(len(order))]).where(F.col("position") <= stop)
        return placed.select(
            (F.col("position") - 1).cast("long").alias("accept_ord"), "pair_id", "title", "category", "content", "source_url_or_id"
        )
    few = first_per_group(
        firsts, ["category"], [F.col("pos")], max([cap, *special.values()]) + stop, spread=F.col("signature")
    ).where(F.col("rank") <= _caps(cap, special) + stop)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([f"o{i}" for i in range(len(order))], kind="stable")
        seen: set[str] = set()
        taken: dict[str, int] = {}
        keep = []
        for i, (signature, category) in enumerate(zip(rows["signature"], rows["category"])):
            if signature in seen or taken.get(category, 0) >= special.get(category, cap):
                continue
            seen.add(signature)
            taken[category] = taken.get(category, 0) + 1
            keep.append(i)
            if len(keep) >= stop:
                break
        out = rows.iloc[keep].copy()
        out["accept_ord"] = range(len(out))
        return out[["accept_ord", "pair_id", "title", "category", "content", "source_url_or_id"]]

    flat = few.select(
        "signature", "category", *[F.col("pos")[c].alias(f"o{i}") for i, c in enumerate(order)], "doc.*"
    )
    return flat.groupBy(F.lit(1).alias("all")).applyInPandas(
        walk, "accept_ord long, pair_id string, title string, category string, content string, source_url_or_id string"
    )


def _as_documents(accepted: DataFrame) -> DataFrame:
    return accepted.select(
        (F.col("accept_ord") + N_POLICIES).alias("doc_ord"),
        F.concat(F.lit("PRECEDENT_"), "pair_id").alias("doc_id"),
        "title",
        "category",
        "content",
        "source_url_or_id",
        F.lit(False).alias("is_policy"),
    )


def build_precedents(pairs: DataFrame, target: int = fx.STORE_TARGET) -> DataFrame:
    """Policy documents first, then accepted precedents up to the target size."""
    accepted = greedy_cap(
        pairs, fx.COMMON_CAP, {i: fx.RARE_CAP for i in fx.RARE_INTENTS}, stop_at=target - N_POLICIES
    )
    return corpus_union(policy_documents(pairs.sparkSession), _as_documents(accepted))


def build_precedents_flat(pairs: DataFrame, cap: int = fx.COMMON_CAP) -> DataFrame:
    """Fallback corpus: the same cap for every intent."""
    accepted = greedy_cap(pairs, cap, stop_at=cap * len(INTENT_NAMES))
    return corpus_union(policy_documents(pairs.sparkSession), _as_documents(accepted))


def corpus_union(policies: DataFrame, precedents: DataFrame) -> DataFrame:
    return policies.unionByName(precedents)


def doc_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Later documents replace earlier ones with the same doc_id but keep their place.

    Both sides have doc_ord, unique within a side; incoming rows come after existing ones.
    """
    both = existing.select("*", F.lit(0).alias("_load")).unionByName(incoming.select("*", F.lit(1).alias("_load")))
    when = F.struct("_load", "doc_ord")
    rest = [c for c in existing.columns if c not in ("doc_id", "doc_ord")]
    merged = both.groupBy("doc_id").agg(
        F.min(when).alias("_place"), F.max_by(F.struct(*rest), when).alias("_row")
    )
    return merged.select("doc_id", F.col("_place._load").alias("load"), F.col("_place.doc_ord").alias("doc_ord"), "_row.*")
