"""Reply drafts and prompt text from retrieved documents.

`sources` columns are arrays of structs ordered by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions import text as tx


def grounding_sources(hits: DataFrame) -> DataFrame:
    """(qid, sources): the ranked documents of each query as an array; at most k entries."""
    not_empty = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    issue = F.coalesce(
        not_empty(F.col("customer_query")) if "customer_query" in hits.columns else F.lit(None).cast("string"),
        not_empty(F.col("title")),
        F.when(F.coalesce("is_policy", F.lit(False)), F.lit(fx.POLICY_TITLE)).otherwise(F.lit(fx.HISTORY_TITLE)),
    )
    entry = F.struct(
        "rank",
        "doc_id",
        "category",
        "score",
        "content",
        F.coalesce("title", F.lit("")).alias("title"),
        issue.alias("customer_issue"),
    )
    ranked = hits.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    return ranked.select(
        "qid",
        F.transform(
            "ranked",
            lambda r: F.struct(
                *[r[f].alias(f) for f in ("doc_id", "category", "score", "content", "title", "customer_issue")]
            ),
        ).alias("sources"),
    )


def citations(sources: Column) -> Column:
    return F.transform(sources, lambda s: s["doc_id"])


def qualified_count(sources: Column, min_score: float) -> Column:
    return F.size(F.filter(sources, lambda s: s["score"] >= min_score))


def draft_reply(sources: Column) -> Column:
    """Greeting and the best document's text without its sign-off and leading handle."""
    best = tx.strip(F.get(sources, F.lit(0))["content"])
    body = F.regexp_replace(best, "(?Ud)" + fx.SIGN_OFF, "")
    body = F.regexp_replace(body, "(?Ud)" + fx.LEADING_HANDLE, "")
    return F.when(F.size(sources) == 0, F.lit(fx.NO_DOCS_REPLY)).otherwise(
        F.coalesce(F.concat(F.lit(fx.GREETING), body), F.lit(fx.SPECIALIST_REPLY))
    )


def prompt_context(sources: Column, thread_context: Column | None = None, turns: Column | None = None) -> Column:
    """History and numbered precedents as one block of text. The history is a text, or an array of turns, a line each."""
    lines = F.transform(
        sources,
        lambda s, i: F.format_string(
            '[%d] Document ID: %s | Category: %s | Score: %s\n    Verified Content: "%s"',
            i + 1,
            s["doc_id"],
            F.when(F.coalesce(s["category"], F.lit("")) == "", F.lit("general")).otherwise(s["category"]),
            F.format_number(s["score"], 2),
            tx.strip(s["content"]),
        ),
    )
    block = F.when(
        F.size(sources) > 0,
        F.concat(F.lit("RETRIEVED PRECEDENTS & POLICY GUIDANCE:\n"), F.array_join(lines, "\n")),
    ).otherwise(F.lit("RETRIEVED PRECEDENTS: No verified precedents found."))
    if turns is not None:
        lines = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("- "), t)), "\n")
        said = F.when(F.size(turns) > 0, F.concat(F.lit("CONVERSATION HISTORY:\n"), lines))
        return F.concat_ws("\n\n", said, block)
    if thread_context is None:
        return block
    history = F.when(
        F.coalesce(thread_context, F.lit("")) != "",
        F.concat(F.lit("CONVERSATION HISTORY:\n"), tx.strip(thread_context)),
    )
    return F.concat_ws("\n\n", history, block)
