"""Raw messages to dialogue pairs, and the profile of a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parley.fixed import wording as fx
from parley.operators import profile
from parley.operators.threads import brand_messages, dialogue_pairs, exportable, head_pairs, one_row_per_id
from parley.session import stage


def build_pairs(messages: DataFrame, brand: str = fx.BRAND, max_pairs: int | None = None) -> DataFrame:
    """Brand filter, thread rebuilding, optional head, length filter."""
    # The brand's messages are read several times below: turns, parents, replies, customers.
    kept = stage(one_row_per_id(brand_messages(messages, brand)), "messages")
    pairs = dialogue_pairs(kept, brand)
    if max_pairs:
        pairs = head_pairs(pairs, max_pairs)
    return exportable(pairs)


def explore(pairs: DataFrame) -> dict[str, DataFrame]:
    """Every profile table of a pair corpus, by name. The pairs are staged once, whatever they are built from."""
    pairs = stage(pairs, "explored-pairs")
    return {
        "summary": profile.corpus_summary(pairs),
        "customer_lengths": profile.length_stats(pairs, "customer_message"),
        "reply_lengths": profile.length_stats(pairs, "brand_reply"),
        "date_range": profile.date_range(pairs, "customer_created_at"),
        "monthly_volume": profile.monthly_volume(pairs, "customer_created_at"),
        "turns": profile.turn_distribution(pairs),
        "opening_bigrams": profile.opening_bigrams(pairs),
        "opening_trigrams": profile.opening_trigrams(pairs),
        "content_keywords": profile.content_keywords(pairs),
        "content_bigrams": profile.content_bigrams(pairs),
        "reply_boilerplate": profile.boilerplate_report(pairs, "brand_reply"),
        "customer_boilerplate": profile.boilerplate_report(pairs, "customer_message"),
        "top_replies": profile.boilerplate_values(pairs, "brand_reply", 5),
        "top_messages": profile.boilerplate_values(pairs, "customer_message", 5),
        "sample": profile.sample_pairs(pairs),
    }
