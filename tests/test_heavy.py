from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.operators import heavy, metrics, profile
from parley.operators.drafting import prompt_context
from parley.operators.threads import brand_messages
from parley.workload import seeds


def skewed(seed, n=3000, words=400):
    rng = random.Random(seed)
    return [f"w{min(int(rng.paretovariate(0.7)), words)}" if rng.random() < 0.95 else None for _ in range(n)]


@pytest.mark.parametrize("buckets", [7, 64, 1 << 20])
@pytest.mark.parametrize("k", [1, 10, 1000])
def test_two_rounds_equal_one(spark, buckets, k):
    """Ties at the last place, fewer values than asked for, and buckets that hold many values."""
    values = skewed(k + buckets)
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = sorted(((-n, v) for v, n in Counter(v for v in values if v is not None).items()))[:k]
    got = heavy.most_frequent(df, "v", k, two_rounds=True, buckets=buckets).collect()
    assert [(-r.n, r.v) for r in got] == want
    assert heavy.most_frequent(df.limit(0), "v", k, two_rounds=True, buckets=buckets).count() == 0


def test_second_round_holds_few_grams(spark):
    grams = profile.ngrams(seeds.table(spark, "/root/testdata/sf0.01", "documents"), "text", 1)
    everything = grams.distinct().count()
    kept = heavy.candidates(grams, "gram", 20).distinct().count()
    assert 20 <= kept < everything / 10


def test_texts_are_counted_by_digest(spark):
    texts = ["a", "a", "b", "b", "c", None, None, "", "", "d" * 5000, "d" * 5000, "d" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.value, r.n) for r in heavy.most_frequent_texts(df, "t", 3).collect()]
    assert got == [("d" * 5000, 3), ("", 2), ("a", 2)]
    report = profile.boilerplate_report(df, "t").first()
    assert (report.total, report.distinct_values) == (12, 5)
    assert heavy.most_frequent_texts(df.limit(0), "t", 3).count() == 0
    # Only winners' texts are joined, by their digests.
    plan = heavy.digest_counts(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_md5" in plan and "hashpartitioning(t" not in plan


def test_failing_ids_in_input_order(spark):
    rows = [("z", 1, "a", "a", True, True), ("b", 2, "a", "x", True, True), ("y", 3, "a", "a", True, False), ("a", 4, None, "a", False, False)]
    df = spark.createDataFrame(rows, "id string, ord int, true_intent string, predicted_intent string, true_escalate boolean, predicted_escalate boolean")
    got = sorted(tuple(r) for r in metrics.failing_ids(df, ["ord"]).collect())
    assert got == [(1, "b", 3), (2, "y", 3), (3, "a", 3)]
    assert [r.id for r in metrics.failing_ids(df, ["id"]).orderBy("position").collect()] == ["a", "b", "y"]
    assert metrics.failing_ids(df.where("ord = 1"), ["ord"]).collect() == []


def test_history_as_turns(spark):
    df = spark.createDataFrame([(["hi", "where is it"],), ([],), (None,)], "turns array<string>")
    none = F.array().cast("array<struct<doc_id:string,category:string,score:double,content:string>>")
    blocks = [r[0] for r in df.select(prompt_context(none, turns=F.col("turns"))).collect()]
    end = "RETRIEVED PRECEDENTS: No verified precedents found."
    assert blocks == ["CONVERSATION HISTORY:\n- hi\n- where is it\n\n" + end, end, end]


def test_brand_messages_read_whole_rows_once(spark, tmp_path):
    rows = [(1, "B", None, "own"), (2, "u", 1, "answer"), (3, "u", 2, "far"), (4, "B", 3, "own"), (5, "u", 4, "answer"), (6, "u", None, "far"), (7, "u", 99, "far")]
    spark.createDataFrame(rows, "tweet_id long, author_id string, in_response_to_tweet_id long, text string").write.parquet(str(tmp_path / "m"))
    kept = brand_messages(spark.read.parquet(str(tmp_path / "m")), "B")
    assert sorted(r.tweet_id for r in kept.collect()) == [1, 2, 3, 4, 5]
    scans = kept._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    reads = [f for f in kept.inputFiles() if str(tmp_path) in f]
    assert scans == 3 and len(reads) == len(set(reads))
