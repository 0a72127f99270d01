"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from parley.llm import (
    exact_dedup,
    html_templates,
    language_id,
    ngram_join,
    packing,
    sentencepiece_viterbi,
    sharding,
    token_store,
    topk_search,
    toxicity,
)
from parley.llm.tokens import public_path

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "Hello there, this is a text about words", "en", "a"),
    (4, "Hello there, this is a text about words", "en", "b"),
    (4, "Hello there, this is a text about words", "en", "b"),
    (5, LONG, None, "b"),
    (6, " \t\n", "fr", "c"),
    (7, "123 456 !", "fr", "c"),
    (None, "no id has this text here", "en", "c"),
    (8, "hello THERE, this is a text about words", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, kept string"
WORD = public_path()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(
        {"length": F.lit("x"), "shard": F.lit(1), "node": F.lit("y"), "score": F.lit(2.0)}
    )


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_exact_dedup(docs, empty):
    out = exact_dedup.exact_groups(docs, F.col("text")).collect()
    assert len(out) == len(ROWS)
    same = [r for r in out if r["carried"] == ROWS[2][1]]
    assert {r["keep_id"] for r in same} == {4} and {r["group_size"] for r in same} == {3}
    assert sum(r["kept"] for r in same) == 1  # one of the two rows with the largest id
    blank = [r for r in out if not r["carried"]]
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in blank} == {(1, 2, False), (2, 2, True)}
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert exact_dedup.exact_groups(empty, F.col("text")).count() == 0


def test_sharding(docs, empty):
    placed, versions = sharding.shard(docs, 3, slots=64)
    out = placed.collect()
    assert len(out) == len(ROWS)
    for s in {r["shard"] for r in out}:
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["size"] == 8 and by_id[1]["text_crc32"] == 0
    assert by_id[5]["text_crc32"] == zlib.crc32(LONG.encode()) and by_id[5]["size"] == len(LONG) + 8
    assert all(r["rebalanced_shard"] in (r["shard"], 3) for r in out)
    assert {r["version"] for r in versions.collect()} == {1, 2}
    assert sharding.shard(empty, 3)[0].count() == 0


def test_token_store(docs, empty, spark):
    store = token_store.write_store(docs, WORD, segment_tokens=1000)
    out = token_store.read_documents(store).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    assert out[1]["ids_crc32"] == zlib.crc32((2).to_bytes(4, "little"))
    wanted = spark.createDataFrame([(5, 0), (5, 29_000), (1, 0), (1, 1), (99, 0)], "doc_id long, place long")
    from parley.llm.tokens import word_ids

    ids = memoryview(word_ids(WORD).encode(LONG)).cast("I")
    got = {(r["doc_id"], r["place"]): r["token"] for r in token_store.tokens_at(store, wanted).collect()}
    assert got == {(5, 0): ids[0], (5, 29_000): ids[29_000], (1, 0): 2}
    assert token_store.read_documents(token_store.write_store(empty, WORD)).count() == 0


def test_packing(docs, empty):
    out = packing.pack_documents(docs, WORD, budget=64, ids=True)
    rows = out.collect()
    assert sum(r["length"] for r in rows) == sum(len(r["ids"]) // 4 for r in rows)
    fill: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
        assert fill[r["sequence_id"]] <= 64
    assert sorted(fill) == list(range(len(fill)))
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    whole = packing.sequences(out, budget=64).collect()
    assert len(whole) == len(fill) and {len(r["ids"]) for r in whole} == {256}
    assert packing.pack_documents(empty, WORD).count() == 0


def test_ngram_join(docs, empty):
    out = {r["doc_id"]: r for r in ngram_join.join(docs).collect()}
    assert out[1]["n_shingles"] == out[2]["n_shingles"] == out[6]["n_shingles"] == 0
    assert (out[1]["component_id"], out[2]["component_id"], out[6]["component_id"]) == (1, 2, 6)
    assert out[3]["component_id"] == out[4]["component_id"] == out[8]["component_id"] == 3
    assert out[7]["n_shingles"] == 1 and out[5]["component_id"] == 5
    left = ngram_join.keep_one(docs)
    assert left.columns and sorted(left.columns) == sorted(docs.columns)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert ngram_join.join(empty).count() == 0


def test_language_stage_without_a_known_language(spark):
    import corpus_pipeline

    rows = [(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "слова", None), (5, "中文", None)]
    kept = corpus_pipeline.drop_without_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]


def test_language_id(docs, empty):
    model = language_id.train(docs)
    out = {r["doc_id"]: r for r in language_id.identify(docs, model, spans=True).collect()}
    assert len(out) == 9
    for k in (1, 2, 6, 7):
        assert (out[k]["_language"]["lang_pred"], out[k]["_language"]["score"]) == ("und", 0.0)
    assert out[3]["_language"]["lang_pred"] == "en" and out[3]["_language"]["spans"][0]["start"] == 0
    assert out[3]["score"] == 2.0
    nothing = language_id.train(empty)
    assert {r[0] for r in language_id.identify(docs, nothing).select("_language.lang_pred").collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["_toxicity"] <= 1 for r in out)
    blank = {r["_toxicity"] for r in out if not (r["text"] or "").strip()}
    assert len(blank) == 1
    none = toxicity.train(docs, labels.where("doc_id < 0"))
    assert {r["_toxicity"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_topk_search(docs, empty):
    rows = topk_search.search(docs, F.col("doc_id") == 3, k=3).orderBy("rank").collect()
    # Copies tie and are ordered by id; the repeated row is found twice.
    assert [r["doc_id"] for r in rows] == [3, 4, 4]
    assert topk_search.search(docs, F.col("doc_id") == 1).count() == 0
    assert topk_search.search(empty, F.lit(True)).count() == 0


def test_sentencepiece(docs, empty):
    path = public_path("piece_bpe_32k.model")
    back = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(docs, path), path).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    assert {r["n_ids"] for r in back if r["doc_id"] in (1, 2)} == {0}
    assert sentencepiece_viterbi.encode(empty, path).count() == 0


def test_html(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>T {0}</h1><p>One&amp;{0}<br>more<p>Two  {0}</article></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(6)]
    rows += [(10, None, None), (11, None, ""), (12, "x", "plain <b>text"), (0, "http://a.example/0", page.format(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    out = html_templates.extract(pages).collect()
    assert len(out) == len(rows)
    text = {r["page_id"]: r["text"] for r in out}
    assert text[3] == "T 3\nOne&3 more\nTwo 3"
    assert text[10] == text[11] == "" and text[12] == "plain text"
    assert html_templates.extract(pages.where("page_id < 0")).count() == 0


def test_exact_dedup_carries_columns_of_any_name(spark):
    rows = [(1, "same", "h", 7, "w", "b"), (2, "same", "i", 8, "x", "c"), (3, "other", "j", 9, "y", "d"), (4, "oth3r", "k", 1, "z", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _head string, _bytes long, _whole string, _long string")
    assert sorted(tuple(r) for r in exact_dedup.drop_copies(docs).collect()) == rows[1:]


def test_near_copies_go_by_row(spark):
    one = " ".join(f"w{i}" for i in range(60))
    near, other = one + " more", " ".join(f"v{i}" for i in range(60))
    rows = [(3, one), (5, near), (5, other), (None, near + " words"), (None, "five words that stand alone here"), (9, None)]
    left = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[5]], key=repr)


def test_search_keeps_queries_apart_that_share_an_id(spark):
    rows = [(50, "alpha beta"), (50, "alpha beta"), (1, "alpha gamma"), (2, "delta"), (50, "delta epsilon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    twice = topk_search.search(docs, F.col("doc_id") == 50).collect()
    alone = topk_search.search(docs.where("doc_id != 50").unionByName(docs.limit(0)), F.col("doc_id") == 1).collect()
    assert alone[0].doc_id == 1
    by_query = {}
    for r in twice:
        by_query.setdefault(round(r.score, 9), 0)
        by_query[round(r.score, 9)] += 1
    tops = sorted(round(r.score, 9) for r in twice if r["rank"] == 1)
    # Both copies ask alike and get the same best score; the third text is a query of its own.
    assert len(tops) == 3 and tops[0] == tops[1] or tops[1] == tops[2]
    assert {r.query_id for r in twice} == {50} and len([r for r in twice if r["rank"] == 1]) == 3
