from __future__ import annotations

import random

from pyspark.sql import functions as F

from parley.operators import threads
from parley.plans.corpus import build_pairs

SCHEMA = "tweet_id long, author_id string, inbound boolean, created_at string, text string, in_response_to_tweet_id long"
BRAND = "AmazonHelp"


def walk(rows):
    """Plain reference walk: tweet_id -> (root, prior texts)."""
    by_id = {r[0]: r for r in rows}
    out = {}
    for start in by_id:
        seen, at = [], start
        while at is not None and at in by_id and at not in seen:
            seen.append(at)
            at = by_id[at][5]
        turns = [f"[{'Customer' if by_id[i][2] else BRAND}]: {by_id[i][4]}" for i in reversed(seen[1:])]
        out[start] = (seen[-1], " | ".join(turns) or None, sum(by_id[i][2] for i in seen[1:]))
    return out


def check(spark, rows):
    got = {
        r.tweet_id: (r.root_id, r.prior_context or None, r.prior_customers)
        for r in threads.lineage(spark.createDataFrame(rows, SCHEMA)).collect()
    }
    assert got == walk(rows)


def message(i, parent, inbound=True):
    return (i, f"u{i}" if inbound else BRAND, inbound, None, f"t{i}", parent)


def test_random_graphs_with_cycles_and_gaps(spark):
    rng = random.Random(7)
    for n in (1, 2, 9, 60):
        rows = [message(i, rng.choice([None, rng.randint(1, n + 3), rng.randint(1, n)]), rng.random() < 0.6) for i in range(1, n + 1)]
        check(spark, rows)


def test_two_cycle_and_self_reply(spark):
    check(spark, [message(1, 2), message(2, 1, False), message(3, 3), message(4, 1)])


def test_cycle_with_tail_beside_a_long_thread(spark):
    rows = [message(1, 2), message(2, 1, False)]
    rows += [message(i, i - 1 if i > 10 else 2, i % 2 == 0) for i in range(10, 60)]  # a tail into the cycle
    rows += [message(i, i - 1 if i > 1000 else None) for i in range(1000, 2500)]
    check(spark, rows)
    got = threads.lineage(spark.createDataFrame(rows, SCHEMA)).where("tweet_id < 60")
    longest = got.agg(F.max(F.length("prior_context"))).first()[0]
    assert longest < 52 * 25  # one run around the cycle and the tail, each turn once


def test_one_thread_holds_most_rows(spark):
    check(spark, [message(i, i - 1 if i > 1 else None, i % 2 == 1) for i in range(1, 301)] + [message(i, None) for i in range(1000, 1010)])


def test_one_message_has_very_many_replies(spark):
    rows = [message(1, None)] + [message(i, 1, False) for i in range(2, 2000)]
    pairs = build_pairs(spark.createDataFrame([(*r[:4], "text " + r[4], r[5]) for r in rows], SCHEMA))
    assert pairs.count() == 1998
    assert pairs.select("conversation_id", "turn_index", "thread_context").distinct().collect() == [("1", 1, "None (opening turn)")]


def test_brand_filter_and_pairs(spark):
    rows = [
        message(1, None),
        message(2, 1, False),
        message(3, 2),
        message(4, 3, False),
        message(5, 4, False),  # the brand answers itself: no pair
        message(6, 99, False),  # parent is not there: no pair
        message(7, None),  # no contact with the brand
        message(8, 7),
    ]
    kept = threads.brand_messages(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.tweet_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6]
    pairs = {r.pair_id: r for r in threads.dialogue_pairs(kept).collect()}
    assert set(pairs) == {"amz_1_2", "amz_3_4"}
    assert pairs["amz_3_4"].thread_context == "[Customer]: t1 | [AmazonHelp]: t2"
    assert (pairs["amz_3_4"].turn_index, pairs["amz_3_4"].conversation_id) == (2, "1")


def test_copies_of_an_id_become_one_row(spark):
    df = spark.createDataFrame([message(1, None), (1, "u1", True, None, "zz", None)], SCHEMA)
    assert [r.text for r in threads.one_row_per_id(df).collect()] == ["zz"]


def test_thread_views(spark):
    turns = spark.createDataFrame(
        [("c", 0, True, "hi"), ("c", 1, False, "q1"), ("c", 2, False, "q2"), ("d", 0, True, "x")],
        "conversation_id string, pos long, is_brand_reply boolean, text string",
    )
    got = {r[0]: (r[1], r[2]) for r in threads.thread_views(turns).collect()}
    assert got == {"c": ("q1", 1), "d": (None, 1)}
    assert threads.brand_replies(turns).count() == 2
    assert threads.thread_views(turns).select(F.sum("brand_replies")).first()[0] == 2
