from __future__ import annotations

import random

import pytest

from parley.fixed.gold_strata import GOLD_STRATA
from parley.functions import text as tx
from parley.operators import gold, precedents
from parley.operators.topn import first_per_group, number_rows, running_sums
from pyspark.sql import functions as F

TEXTS = {
    "returns_refunds": "i really need a refund for it",
    "order_status_delay": "please tell me the order status",
    "other_unclear": "good morning to everyone here",
    "account_access_security": "someone hacked me since monday",
}
PAIRS = (
    "pair_id string, conversation_id string, turn_index int, brand_tweet_id string, customer_message string, "
    "brand_reply string, thread_context string"
)


def random_pairs(rng, n, signatures):
    rows = []
    for i in range(n):
        intent = rng.choice(list(TEXTS))
        # One signature and one intent hold a large part of the rows.
        sig = 0 if rng.random() < 0.33 else rng.randint(0, signatures)
        rows.append((f"p{i:05d}", f"{rng.randint(0, 50)}", rng.randint(1, 3), f"{i:06d}", TEXTS[intent], f"reply number {sig:05d} is long enough", "None"))
    return rows


def walk(rows, cap, special, stop):
    intent_of = {v: k for k, v in TEXTS.items()}
    seen, taken, out = set(), {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        sig, cat = r[5].strip()[:60].lower(), intent_of[r[4]]
        if sig in seen or taken.get(cat, 0) >= special.get(cat, cap):
            continue
        seen.add(sig)
        taken[cat] = taken.get(cat, 0) + 1
        out.append(r[0])
        if len(out) >= stop:
            break
    return out


@pytest.mark.parametrize("cap,special,stop,signatures", [(3, {}, 36, 40), (5, {"other_unclear": 2}, 9, 6), (2, {"returns_refunds": 7}, 400, 300)])
def test_greedy_cap_equals_the_sequential_walk(spark, cap, special, stop, signatures):
    rows = random_pairs(random.Random(cap), 400, signatures)
    got = precedents.greedy_cap(spark.createDataFrame(rows, PAIRS), cap, special, stop).orderBy("accept_ord").collect()
    assert [r.pair_id for r in got] == walk(rows, cap, special, stop)


def test_signature_counts_only_when_accepted(spark):
    same = "the very same reply for both of them"
    rows = [
        ("p1", "1", 1, "1", TEXTS["other_unclear"], "first reply fills the category", "None"),
        ("p2", "2", 1, "2", TEXTS["other_unclear"], same, "None"),
        ("p3", "3", 1, "3", TEXTS["returns_refunds"], same, "None"),
    ]
    got = precedents.greedy_cap(spark.createDataFrame(rows, PAIRS), 1).collect()
    assert {r.pair_id for r in got} == {"p1", "p3"}


def test_build_puts_policies_first(spark):
    docs = precedents.build_precedents(spark.createDataFrame(random_pairs(random.Random(1), 50, 30), PAIRS), target=20)
    rows = docs.orderBy("doc_ord").collect()
    assert len(rows) == 20 and [r.doc_ord for r in rows] == list(range(20))
    assert all(r.is_policy for r in rows[:12]) and rows[12].doc_id.startswith("PRECEDENT_p")


def test_doc_upsert_keeps_the_place(spark):
    schema = "doc_ord long, doc_id string, content string"
    old = spark.createDataFrame([(0, "a", "1"), (1, "b", "2")], schema)
    new = spark.createDataFrame([(0, "c", "3"), (1, "a", "4"), (2, "a", "5")], schema)
    rows = precedents.doc_upsert(old, new).orderBy("load", "doc_ord").collect()
    assert [(r.doc_id, r.content) for r in rows] == [("a", "5"), ("b", "2"), ("c", "3")]


def test_gold_pick_equals_the_sequential_walk(spark):
    import re

    rng = random.Random(5)
    words = ["where is my", "tracking number", "return label", "how do i return", "broken", "hacked", "charged twice", "compatible with", "porch", "stolen", "delivered", "refund"]
    rows = [
        (f"p{i:04d}", f"{rng.randint(0, 40)}", 1, f"{i:05d}", " ".join(rng.sample(words, 3)) + " thing", "a reply of some length", "None")
        for i in range(600)
    ]
    used, expected = set(), []
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
    for _, pattern, _, quota in GOLD_STRATA:
        found = [r[0] for r in ordered if re.search(pattern, r[4], re.I) and r[0] not in used][:quota]
        used.update(found)
        expected += found
    picked = gold.stratified_pick(gold.gold_candidates(spark.createDataFrame(rows, PAIRS)))
    assert [r.pair_id for r in picked.orderBy("gold_ord").collect()] == expected
    built = gold.build_gold(spark.createDataFrame(rows, PAIRS), target=len(expected) + 25)
    assert built.count() == len(expected) + 25 and built.select("id").distinct().count() == built.count()


def test_first_per_group_with_a_hot_group(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"), "id"
    )
    for n in (2, 1500):
        got = first_per_group(df, ["g"], [F.desc("id")], n).groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("top"))
        want = df.groupBy("g").agg(F.least(F.count("*"), F.lit(n)).alias("n"), F.max("id").alias("top"))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_positions_and_running_sums(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    assert number_rows(df, ["k"]).where("position != k + 1").count() == 0
    sums = running_sums(df, ["k"], {"s": F.col("k")})
    assert sums.where("s != k * (k + 1) / 2 or position != k + 1").count() == 0


def test_english_filter(spark):
    df = spark.createDataFrame([("hello there",), ("сколько это стоит",), ("hi",), ("   ab   ",)], "t string")
    assert [r[0] for r in df.select(tx.is_english(F.col("t"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize("cap,special,stop,signatures", [(3, {}, 36, 40), (5, {"other_unclear": 2}, 9, 6), (2, {"returns_refunds": 7}, 400, 300)])
def test_rounds_equal_the_sequential_walk(spark, cap, special, stop, signatures):
    rows = random_pairs(random.Random(cap), 400, signatures)
    got = precedents.greedy_cap(spark.createDataFrame(rows, PAIRS), cap, special, stop, walk_rows=0).orderBy("accept_ord").collect()
    assert [r.pair_id for r in got] == walk(rows, cap, special, stop)
    assert [r.accept_ord for r in got] == list(range(len(got)))


def test_rounds_at_caps_of_a_million(spark):
    """The default bound sends caps of this size to the rounds; some intents fill, most do not."""
    rows = random_pairs(random.Random(8), 20_000, 6_000)
    special = {"returns_refunds": 900, "other_unclear": 300}
    got = precedents.greedy_cap(spark.createDataFrame(rows, PAIRS), 1_000_000, special, 5_000).orderBy("accept_ord").collect()
    assert [r.pair_id for r in got] == walk(rows, 1_000_000, special, 5_000)
    assert len(got) > 3_000


def test_strata_in_rounds_equal_the_walk(spark):
    words = ["where is my", "tracking number", "return label", "how do i return", "broken", "hacked", "charged twice", "stolen", "delivered", "refund"]
    rng = random.Random(11)
    rows = [
        (f"p{i:05d}", f"{rng.randint(0, 90)}", 1, f"{i:06d}", " ".join(rng.sample(words, 3)) + " please", "a long enough reply", "None")
        for i in range(600)
    ]
    pairs = spark.createDataFrame(rows, PAIRS)
    for scale in (1, 3):
        pick = lambda bound: sorted((r.gold_ord, r.stratum, r.pair_id) for r in gold.stratified_pick(pairs, scale=scale, walk_rows=bound).collect())
        walked = pick(10**9)
        assert pick(0) == walked and len(walked) > 30


def test_length_sketches_merge(spark):
    from parley.operators import profile

    rng = random.Random(2)
    texts = ["x" * min(int(rng.paretovariate(0.6)), 9_000) for _ in range(30_000)] + [None, ""]
    whole = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parts = [profile.length_sketch(whole.where(F.col("i") % 3 == k), "t") for k in range(3)]
    merged = profile.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    exact = {r.unit: r for r in profile.length_stats(whole, "t").collect()}
    lengths = sorted(len(t) for t in texts if t is not None)
    for r in profile.sketch_stats(merged).collect():
        e = exact[r.unit]
        assert (r.texts, r.min, r.max) == (e.texts, e.min, e.max)
        assert r["mean"] == pytest.approx(e["mean"]) and r["std"] == pytest.approx(e["std"])
        if r.unit == "char":
            for q, value in ((0.25, r.p25), (0.5, r.median), (0.75, r.p75), (0.95, r.p95)):
                below, upto = sum(x < value for x in lengths), sum(x <= value for x in lengths)
                assert below / len(lengths) - 0.02 <= q <= upto / len(lengths) + 0.02
    assert profile.sketch_stats(profile.merge_sketches(profile.length_sketch(whole.limit(0), "t"))).count() == 0
