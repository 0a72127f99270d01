from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.operators import retrieval
from parley.operators.drafting import draft_reply, grounding_sources, prompt_context

DOCS = "doc_ord long, doc_id string, title string, category string, content string, is_policy boolean"
ASK = "qid string, text string, category string"


def brute(docs, queries, k=3, threshold=0.05, max_terms=15000):
    """Plain TF-IDF with one- and two-word terms."""

    def terms(text):
        words = re.findall(r"\w{2,}", text.lower())
        return Counter(words + [" ".join(p) for p in zip(words, words[1:])])

    bags = [terms(f"{d[2] or ''} {d[4]} category_{d[3] or 'general'}") for d in docs]
    total = Counter()
    for b in bags:
        total.update(b)
    vocab = {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:max_terms]}
    idf = {t: math.log((1 + len(docs)) / (1 + sum(t in b for b in bags))) + 1 for t in vocab}

    def unit(bag):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in bag.items() if t in vocab}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / n for t, x in v.items()}

    vectors = [unit(b) for b in bags]
    out = {}
    for qid, text, category in queries:
        q = unit(terms(text))
        scored = []
        for d, v in zip(docs, vectors):
            s = sum(w * v.get(t, 0) for t, w in q.items())
            if category:
                s *= 1.35 if d[3] == category else 0.65
            if s >= threshold:
                scored.append((-round(s, 12), d[0]))
        out[qid] = [(d, round(min(-s, 1), 4)) for s, d in sorted(scored)[:k]]
    return {q: v for q, v in out.items() if v}


def random_corpus(seed, n_docs=60, n_queries=25):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "x", "ünï", "order", "refund", "late"] + [f"w{i}" for i in range(40)]
    pick = lambda n: " ".join(rng.choices(words, weights=[20] * 9 + [1] * 40, k=n))
    docs = [(i, f"d{i}", rng.choice([None, pick(2)]), rng.choice([None, "a", "b"]), pick(rng.randint(1, 30)), False) for i in range(n_docs)]
    docs += [(n_docs + i, f"copy{i}", *docs[0][2:]) for i in range(5)]
    return docs, [(f"q{i}", pick(rng.randint(1, 8)), rng.choice([None, "", "a", "zz"])) for i in range(n_queries)] + [("none", "qqq", None)]


@pytest.mark.parametrize("path", ["small index", "few queries", "both large"])
@pytest.mark.parametrize("max_terms", [15000, 25])
def test_search_equals_brute_force(spark, path, max_terms):
    docs, queries = random_corpus(max_terms)
    index = retrieval.tfidf_index(spark.createDataFrame(docs, DOCS), max_terms)
    bound = {"small index": 10**6, "few queries": index.n_postings - 1, "both large": 0}[path]
    hits = retrieval.tfidf_search(spark.createDataFrame(queries, ASK), index, broadcast_rows=bound, hot_term_docs=10)
    got: dict = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc_ord, r.score))
    want = brute(docs, queries, max_terms=max_terms)
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
    for q, v in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in v], abs=1e-4)


def test_category_boost_reverses_a_ranking_and_clamps(spark):
    docs = [(0, "d0", None, "a", "late parcel", False), (1, "d1", None, "b", "late parcel today", False)]
    index = retrieval.tfidf_index(spark.createDataFrame(docs, DOCS))
    hits = retrieval.tfidf_search(spark.createDataFrame([("n", "late parcel", None), ("b", "late parcel", "b"), ("a", "late parcel category_a", "a")], ASK), index)
    got = {(r.qid, r["rank"]): (r.doc_ord, r.score) for r in hits.collect()}
    assert got["n", 1][0] == 0 and got["b", 1][0] == 1
    assert got["a", 1] == (0, 1.0)
    with pytest.raises(ValueError):
        retrieval.tfidf_search(spark.createDataFrame([], ASK), index, threshold=0.0)


def test_overlap_search(spark):
    docs = [
        (0, "d0", None, "a", "Red red fish", False),
        (1, "d1", None, "b", "blue fish", False),
        (2, "d2", None, "a", "nothing", False),
        (3, "d3", None, "a", "blue sky", False),
    ]
    queries = [("1", "blue fish fish", None), ("2", "fish", "a"), ("3", "zzz", None), ("4", "", None), ("5", "zzz", "none")]
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(queries, ASK)
    got: dict = {}
    for r in retrieval.overlap_search(q, d).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc_ord, r.score))
    assert got == {
        "1": [(1, 1.0), (0, 0.5), (3, 0.5)],
        "2": [(0, 1.0), (2, 0.0), (3, 0.0)],
        "3": [(0, 0.0), (1, 0.0), (2, 0.0)],
        "4": [(0, 0.0), (1, 0.0), (2, 0.0)],
    }
    some = retrieval.overlap_search(q, d, threshold=0.6).collect()
    assert {(r.qid, r.doc_ord) for r in some} == {("1", 1), ("2", 0)}


def test_drafts(spark):
    hits = spark.createDataFrame(
        [("q", 1, "d1", "a", 0.125, " @Bob see https://x.org ^SD", "", True), ("q", 2, "d2", None, 0.1, "other", "t", False)],
        "qid string, rank int, doc_id string, category string, score double, content string, title string, is_policy boolean",
    )
    rows = grounding_sources(hits)
    row = rows.select("sources", draft_reply(F.col("sources")).alias("draft"), prompt_context(F.col("sources"), F.lit("hi")).alias("block")).first()
    assert row.draft == "Hello! see https://x.org"
    assert [s.customer_issue for s in row.sources] == ["Policy Specification", "t"]
    assert row.block == (
        "CONVERSATION HISTORY:\nhi\n\nRETRIEVED PRECEDENTS & POLICY GUIDANCE:\n"
        '[1] Document ID: d1 | Category: a | Score: 0.12\n    Verified Content: "@Bob see https://x.org ^SD"\n'
        '[2] Document ID: d2 | Category: general | Score: 0.10\n    Verified Content: "other"'
    )
    none = rows.select(F.slice("sources", 1, 0).alias("s")).select(draft_reply(F.col("s")).alias("d"), prompt_context(F.col("s")).alias("b")).first()
    assert none.d.startswith("Thank you for contacting") and none.b == "RETRIEVED PRECEDENTS: No verified precedents found."


def test_pruned_join_forms_few_of_the_plain_rows(spark):
    from parley.operators import pruned_join
    from parley.workload import seeds

    sf = "/root/testdata/sf0.01"
    index = retrieval.tfidf_index(seeds.docs(spark, sf))
    terms = retrieval.query_terms(seeds.queries(spark, sf), index).cache()
    plain = terms.agg(F.sum("df")).first()[0]
    blocks = index.blocks = pruned_join.blocks(index.postings, index.vocab)
    ordered = pruned_join.ordered_terms(terms, blocks.bounds).cache()
    factor = pruned_join._factor(1.35, 0.65)
    hits = retrieval.tfidf_search(seeds.queries(spark, sf), index, broadcast_rows=index.n_postings - 1)
    # From the k-th best scores, which the first pass only estimates; it is counted as well.
    floors = hits.groupBy("qid").agg(F.min("score").alias("floor"))
    n = ordered.count()
    formed = pruned_join.first_rows(ordered, blocks, n, 10**6, 10**6).count()
    formed += pruned_join.passing_rows(ordered, floors, blocks, factor, 1.35, n, 10**6, 10**6).count()
    assert plain > 100_000 and formed < 0.15 * plain


def plain_overlap(docs, queries, k, threshold):
    out = {}
    for qid, text, category in queries:
        words = set(text.lower().split())
        scored = []
        for d in docs:
            if category and d[3] != category:
                continue
            score = len(words & set(d[4].lower().split())) / max(len(words), 1)
            if score >= threshold:
                scored.append((-score, d[0]))
        out[qid] = [(d, -s) for s, d in sorted(scored)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("bound", [10**6, 0])
@pytest.mark.parametrize("threshold", [0.0, 0.34, 1.0])
def test_overlap_equals_plain_counts(spark, monkeypatch, bound, threshold):
    """Hot words are split over several keys where nothing is broadcast; the first pass is cut short."""
    docs, queries = random_corpus(7, n_docs=120)
    queries += [("long", " ".join(d[4] for d in docs[:3]), None), ("blank", " ", "a")]
    monkeypatch.setattr(retrieval.containment, "FIRST_POSTINGS", 15)
    found = retrieval.overlap_search(spark.createDataFrame(queries, ASK), spark.createDataFrame(docs, DOCS), 4, threshold, bound, 5)
    got: dict = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc_ord, r.score))
    assert got == plain_overlap(docs, queries, 4, threshold)


def test_overlap_joins_a_hot_word_for_few_documents(spark):
    """A word that every document holds is no candidate once rarer words settle the result."""
    from parley.operators import containment

    docs = [(i, f"d{i}", None, "a", f"the w{i % 50} x{i % 3}", False) for i in range(600)]
    queries = spark.createDataFrame([(f"q{i}", f"the w{i} x{i % 3}", None) for i in range(10)], ASK)
    q = queries.selectExpr("qid", "'' AS q_category", "split(text, ' ') AS words", "3 AS n_words")
    bags = spark.createDataFrame(docs, DOCS).selectExpr("doc_ord", "category AS doc_category", "split(content, ' ') AS d_words")
    d_words = bags.selectExpr("doc_ord", "doc_category", "size(d_words) AS size", "explode(d_words) AS word")
    ordered = containment._ordered(q, d_words.groupBy("word").agg(F.count("*").alias("df")))
    floors = q.selectExpr("qid", "3 AS least")
    formed = containment.passing(ordered, floors, d_words, 30, 10**6, 10**6).count()
    plain = d_words.join(ordered, "word").count()
    assert formed == 120 and plain > 8_000
    for bound in (10**6, 0):
        best = containment.search(q, bags, 3, 0.0, bound, 100)
        assert best.count() == 30 and best.where("score < 1").count() == 0
