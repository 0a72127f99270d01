"""Merkle manifest, ball-tree search and suffix sort against plain versions, and their small cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import ball_tree, merkle, suffix_dedup
from parley.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, doc string, tree string, h int, score double, carried string"


def frame(spark, rows):
    """Rows of (doc_id, text, lang) with columns named like the operators' own."""
    return spark.createDataFrame([(*r, "x", "y", 1, 0.5, "z") for r in rows], DOCS)


# Repeated strings --------------------------------------------------------------


def plain_repeats(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of what is kept) by a set of seen strings."""
    docs = sorted({(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows})
    seen, cuts = set(), {}
    for doc, data in docs:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            gram = data[i : i + length]
            if gram in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(gram)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        cuts[doc, data] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((d, *cuts[-(1 << 63) if d is None else d, (t or "").encode()]) for d, t in rows), key=repr)


def found_repeats(df):
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_ranks_are_the_order_of_suffixes(values):
    ranks = suffix_dedup.suffix_ranks(np.array(values, np.int64)).tolist()
    assert ranks == [1 + sorted(values[j:] for j in range(len(values))).index(values[i:]) for i in range(len(values))]


def passages(seed, n):
    """Texts that share passages at shifted places, with small edits, runs of one byte and short periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                passage = rng.choice(shared)
                at = rng.randint(0, len(passage) // 2)
                parts.append(passage[at : at + rng.randint(50, 300)])
            elif kind < 0.6:
                parts.append(rng.choice(["a", "ab", "xyz", "\0"]) * rng.randint(30, 150))
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(1, 30))))
        text = rng.choice(["", " "]).join(parts)
        if rng.random() < 0.3 and len(text) > 10:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((i, text))
    rows += [(n + i, rows[rng.randrange(n)][1]) for i in range(n // 5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("variant", ["blocks", "large grams", "slices"])
def test_repeats_equal_a_set_of_strings(spark, monkeypatch, seed, variant):
    rows = passages(seed, 60)
    if variant == "blocks":
        monkeypatch.setattr(suffix_dedup, "BLOCK", 2_000)
    if variant == "large grams":
        monkeypatch.setattr(suffix_dedup, "KEY_SEGMENTS", 1)
    if variant == "slices":
        monkeypatch.setattr(suffix_dedup, "SLICE", 150)
    got = found_repeats(frame(spark, [(d, t, "en") for d, t in rows]))
    assert got == plain_repeats(rows, 100)
    assert sum(r[2] for r in got) > 1000


def test_repeats_small_cases(spark):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    rows = [(None, None), (1, ""), (2, long), (2, long), (2, long[5:] + "!"), (None, long[:120]), (3, "a" * 500), (4, "short"), (4, "short"), (5, long[:99])]
    got = found_repeats(frame(spark, [(d, t, None) for d, t in rows]))
    # Rows with one id order by a hash of their text, so the text that comes second is taken from the result.
    at_two = [r for r in got if r[0] == 2]
    assert len(at_two) == 3 and at_two[0] in at_two[1:] + [at_two[0]]
    rest = [r for r in plain_repeats([r for r in rows if r[0] != 2], 100) if r[0] not in (None, 2)]
    assert [r for r in got if r[0] not in (None, 2)] == rest
    assert {r[2] for r in got if r[0] is None} == {0}  # null ids come first
    assert found_repeats(frame(spark, [(1, "x", None)]).where("doc_id < 0")) == []


def test_repeats_of_the_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_suffix_dedup"](spark, SF).collect()), key=repr)
    assert got == plain_repeats(rows, 100)


# Merkle manifest ----------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(hashes):
    """Root, and for each leaf its steps of (left, right)."""
    paths, level, owners = [[] for _ in hashes], list(hashes), [[i] for i in range(len(hashes))]
    while len(level) > 1:
        nodes, own = [], []
        for at in range(0, len(level), 8):
            run = level[at : at + 8]
            for slot in range(len(run)):
                for leaf in owners[at + slot]:
                    paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            nodes.append(sha("".join(run)))
            own.append([x for group in owners[at : at + 8] for x in group])
        level, owners = nodes, own
    return level[0], paths


def plain_manifest(rows):
    """rows: (doc_id, tree, leaf) to (doc_id, leaf, subroot, root, path)."""
    trees: dict = {}
    for doc, tree, leaf in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        trees.setdefault(tree, []).append((doc, leaf))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    subs = {t: plain_tree([leaf for _, leaf in trees[t]]) for t in names}
    root, above = plain_tree([subs[t][0] for t in names])
    return [
        (doc, leaf, subs[t][0], root, subs[t][1][i] + above[k])
        for k, t in enumerate(names)
        for i, (doc, leaf) in enumerate(trees[t])
    ]


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [65, 1, 8, 513, 0, 7], [3] * 20])
def test_manifest_equals_a_plain_tree(spark, sizes):
    langs = [None, "", "a", "b", "zz", "é", *[f"l{i}" for i in range(20)]]
    rows = [(i * 7 + k, langs[k], sha(f"{k}-{i}")) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "doc_id long, tree string, leaf string, carried string, pos int")
    out = merkle.manifest(df)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    # Every leaf folds to the root, and another leaf does not.
    folded = out.select("root", merkle.fold(F.col("leaf"), F.col("path")).alias("a"), merkle.fold(F.lit("0"), F.col("path")).alias("b"))
    assert all(r.a == r.root and r.b != r.root for r in folded.collect())


def test_manifest_small_cases(spark):
    rows = [(None, "a", sha("n")), (1, "a", sha("x")), (1, "a", sha("x")), (1, "a", sha("b")), (2, None, sha("x"))]
    schema = "doc_id long, tree string, leaf string"
    out = merkle.manifest(spark.createDataFrame(rows, schema).withColumn("carried", F.lit(None).cast("string")))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert merkle.manifest(spark.createDataFrame([], schema).withColumn("carried", F.lit("x"))).collect() == []
    fields = spark.createDataFrame([(1, None, "", "é:")], "a long, b string, c string, d string")
    assert fields.select(merkle.leaf_hash(*[F.col(c) for c in "abcd"])).first()[0] == sha("1:1-0:3:é:")


def test_manifest_finds_every_changed_text(spark):
    out = QUERIES["op12_merkle_manifest"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    changed = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & F.col("text").rlike("[A-Z]")
    assert out.where(F.col("verified") == changed).count() == 0
    assert 0 < out.where("verified").count() < out.count()


# Ranked search --------------------------------------------------------------------


def plain_search(items, docs, k=20):
    def bag(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower))

    bags = [(d, bag(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // max(n_terms, 1)
            score = sum(
                c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m))
                for t, c in bag(text).items()
                if t in b
            )
            if score > 0:
                scored.append((-score, -(1 << 63) if d is None else d, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


WORDS = ["alpha", "Beta", "ünï", "中文", "x1", "İstanbul", "a", "ref"] + [f"w{i}" for i in range(60)]


def corpus(seed, n=300):
    rng = random.Random(seed)
    text = lambda most: "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(rng.randint(0, most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(n + i, docs[0][1]) for i in range(30)] + [(5, "alpha beta"), (5, "alpha beta"), (None, "alpha"), (n + 90, None), (n + 91, " .;")]
    items = [(i, text(12)) for i in range(20)] + [(20, None), (21, "!"), (22, "unknownword"), (3, "alpha alpha w1"), (3, "alpha alpha w1")]
    return items, docs


@pytest.mark.parametrize("block", [60, 1_000_000])
@pytest.mark.parametrize("k", [1, 20])
def test_search_equals_plain_scores(spark, monkeypatch, block, k):
    items, docs = corpus(block + k)
    monkeypatch.setattr(ball_tree, "BLOCK_POSTINGS", block)
    if k == 1:
        monkeypatch.setattr(ball_tree, "BLOCK_QUERIES", 7)
    df = frame(spark, [(d, t, "en") for d, t in docs])
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in ball_tree.search(asked, df, k).collect()), key=repr)
    want = plain_search(items, docs, k)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want] and got == want
    assert ball_tree.search(asked, df.where("doc_id < 0"), k).collect() == []
    assert ball_tree.search(asked.where("item_id < 0"), df, k).collect() == []


def test_long_text_is_counted_in_slices(monkeypatch):
    text = " ".join(f"Wört{i % 13}" for i in range(3000))
    whole = ball_tree.term_counts(text)
    monkeypatch.setattr(ball_tree, "SLICE", 17)
    assert ball_tree.term_counts(text) == whole and whole["wört5".encode()] == 231


def test_bounds_leave_out_subtrees_and_lose_nothing():
    rng = np.random.default_rng(5)
    n, n_terms = 2000, 120
    topic = rng.integers(0, 12, n)
    rows = [np.unique(np.concatenate([10 * t + rng.integers(0, 10, 8), rng.integers(0, n_terms, 2)])) for t in topic]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    cols = np.concatenate(rows)
    vals = rng.integers(1, 10**9, len(cols))
    tree = ball_tree.build_tree(np.arange(n), starts, cols, vals, n_terms)
    assert sorted(tree.ids.tolist()) == list(range(n))
    dense = np.zeros(n_terms, np.int64)
    matrix = np.zeros((n, n_terms), np.int64)
    for i in range(n):
        matrix[i, cols[starts[i] : starts[i + 1]]] = vals[starts[i] : starts[i + 1]]
    leaves = sum(c is None for c in tree.children)
    visited = 0
    for t in range(12):
        terms, counts = np.arange(10 * t, 10 * t + 10), np.arange(1, 11)
        best = ball_tree.Best.none(20)
        visited += ball_tree.search_tree(tree, terms, counts, best, dense)
        scores = matrix[:, terms] @ counts
        order = np.lexsort((np.arange(n), -scores))[:20]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
    assert not dense.any() and visited < 0.6 * 12 * leaves
