"""Search by blocks of documents and queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parley.operators import retrieval

DOCS = "doc_ord long, doc_id string, title string, category string, content string, is_policy boolean"
ASK = "qid string, text string, category string"


@pytest.mark.parametrize("hot", [10**6, 3])
def test_blocks_give_what_one_block_gives(spark, monkeypatch, hot):
    """Blocks of few postings and few query terms, copies among the documents and among the questions."""
    monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", 60)
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 7)
    docs = [(i, f"d{i}", None, "ab"[i % 2] if i % 5 else None, f"the w{i % 13} x{i % 7} y{i % 3}", False) for i in range(80)]
    asked = [(f"q{i}", f"the w{i % 6} y{i % 2}", [None, "a", "b"][i % 3]) for i in range(24)] + [("none", "zz", None)]
    index = retrieval.tfidf_index(spark.createDataFrame(docs, DOCS))
    queries = spark.createDataFrame(asked, ASK)
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "doc_ord", "score", "rank").collect())
    small = rows(retrieval.tfidf_search(queries, index))
    assert len(small) == 72 and small == rows(retrieval.tfidf_search(queries, index, broadcast_rows=0, hot_term_docs=hot))


def test_vocabulary_ranks_only_terms_that_can_be_chosen(spark):
    """Ties at the last total are settled by the term."""
    totals = spark.range(5000).select(F.format_string("t%04d", "id").alias("term"), (F.col("id") % 5).alias("total"))
    chosen = [r.term for r in retrieval.vocabulary(totals, 1500).orderBy("term_id").collect()]
    assert chosen == sorted([f"t{i:04d}" for i in range(4, 5000, 5)] + [f"t{i:04d}" for i in range(3, 2500, 5)])
