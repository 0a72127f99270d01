from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parley.operators import retrieval
from parley.operators.index_store import IndexStore
from parley.plans.store import default_documents, default_index
from parley.plans.triage import triage
from parley.sources import writers
from parley.streaming.triage import triage_stream
from test_retrieval import ASK, DOCS, random_corpus


def plain(versions):
    """Documents after all writes: an id keeps its first place and takes its last row."""
    place, rows = {}, {}
    for docs in versions:
        for d in sorted(docs):
            place.setdefault(d[1], len(place))
            rows[d[1]] = d[2:]
    return [(place[i], i, *rows[i]) for i in sorted(place, key=place.get)]


def weights(index):
    return {(r.doc_ord, r.term): (r.doc_category, round(r.weight, 9)) for r in index.postings.collect()}


@pytest.mark.parametrize("max_terms", [15000, 25])
def test_versions_equal_a_rebuild(spark, tmp_path, max_terms):
    first, queries = random_corpus(3)
    other, _ = random_corpus(4, n_docs=30)
    # Replaced, new and repeated ids in one write; then a replaced one again.
    second = [(i, d[1] if i < 20 else f"new{i}", *d[2:]) for i, d in enumerate(other)] + [(900, "new25", "t", "a", "late order", False)]
    third = [(0, "d3", None, "b", "refund refund late", False), (1, "new25", None, None, "", False)]
    store = IndexStore(spark, str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        store.load()
    asked = spark.createDataFrame(queries, ASK)
    for n, docs in enumerate((first, second, third), 1):
        assert store.upsert(spark.createDataFrame(docs, DOCS)) == n - 1
        want_docs = plain([first, second, third][:n])
        rebuilt = retrieval.tfidf_index(spark.createDataFrame(want_docs, DOCS), max_terms)
        loaded = store.load(max_terms)
        assert loaded.n_docs == rebuilt.n_docs == len(want_docs)
        assert weights(loaded) == weights(rebuilt)
        assert {(r.term, r.df) for r in loaded.vocab.collect()} == {(r.term, r.df) for r in rebuilt.vocab.collect()}
        assert sorted((r.doc_ord, r.doc_id, r.content) for r in loaded.docs.collect()) == [(d[0], d[1], d[4]) for d in want_docs]
    hits = lambda index: sorted(map(tuple, retrieval.tfidf_search(asked, index).collect()))
    want = hits(rebuilt)
    assert hits(loaded) == want
    # One version stands for all; the folders of the others go.
    assert store.compact() == 3
    store.vacuum()
    assert [p.name for p in (tmp_path / "index" / "counts").glob("version=*")] == ["version=3"]
    assert weights(store.load(max_terms)) == weights(rebuilt) and store.upsert(spark.createDataFrame(third, DOCS)) == 4
    assert weights(store.load(max_terms)) == weights(rebuilt)


def test_a_failed_write_does_not_count(spark, tmp_path):
    docs, _ = random_corpus(5, n_docs=10)
    store = IndexStore(spark, str(tmp_path))
    store.upsert(spark.createDataFrame(docs, DOCS))
    before = weights(store.load())
    # Rows without a commit, as a lost driver leaves them.
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/docs/version=1")
    spark.createDataFrame([(0, "a", "late", 5)], "doc_ord long, doc_category string, term string, tf long").write.parquet(f"{tmp_path}/counts/version=1")
    assert weights(store.load()) == before and store.documents().count() == len(docs)
    assert store.upsert(spark.createDataFrame([(0, "x", None, "a", "late", False)], DOCS)) == 1
    assert store.load().n_docs == len(docs) + 1


def test_a_restarted_stream_answers_from_the_stored_index(spark, tmp_path):
    inbox, out, state, folder = (str(tmp_path / n) for n in ("inbox", "out", "state", "index"))
    schema = "msg_id long, text string"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        triage_stream(stream, IndexStore(spark, folder).load(), out, state).awaitTermination()
        return {r.msg_id: list(r.citations) for r in spark.read.parquet(out).collect()}

    one = [(0, "d0", None, "returns_refunds", "refunds take days", False), (1, "d1", None, "x", "other words", False)]
    IndexStore(spark, folder).upsert(spark.createDataFrame(one, DOCS))
    assert run([(1, "i want refunds")]) == {1: ["d0"]}
    IndexStore(spark, folder).upsert(spark.createDataFrame([(0, "d2", None, "returns_refunds", "i want refunds", False)], DOCS))
    assert run([(2, "i want refunds")]) == {1: ["d0"], 2: ["d2", "d0"]}


def test_default_store(spark, tmp_path):
    none = default_documents(spark, str(tmp_path / "absent"))
    assert none.count() == 12 and none.where("is_policy").count() == 12
    pairs = spark.createDataFrame(
        [(f"p{i}", f"c{i}", 1, f"where is my parcel number {i}", f"Your parcel {i} is on its way to you today") for i in range(5)],
        "pair_id string, conversation_id string, turn_index int, customer_message string, brand_reply string",
    )
    built = default_documents(spark, None, pairs.withColumn("brand_tweet_id", F.lit("1")))
    assert built.count() == 17
    writers.write_precedents(built, str(tmp_path / "store"))
    index = default_index(spark, str(tmp_path / "store"))
    assert index.n_docs == 17
    answered = triage(spark.createDataFrame([(1, "where is my parcel")], "msg_id long, text string"), index).first()
    assert answered.citations
