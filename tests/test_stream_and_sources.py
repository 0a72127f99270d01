from __future__ import annotations

import json
import random
from pathlib import Path

import pytest

from parley.operators import gold, profile, retrieval
from parley.operators.quality import missing_fields
from parley.session import drop_staged, release_stages, stage, stage_counted, stage_root
from parley.sources import readers, writers
from parley.streaming import ledger as ledger_module
from parley.streaming.triage import triage_stream
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

DOCS = "doc_ord long, doc_id string, title string, category string, content string, is_policy boolean"


def test_stream_scores_each_message_once(spark, tmp_path):
    index = retrieval.tfidf_index(
        spark.createDataFrame([(0, "d0", "refund", "returns_refunds", "refunds take days", False), (1, "d1", "t", "x", "other", False)], DOCS)
    )
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    schema = "msg_id long, text string, ts timestamp"

    def arrive(rows):
        spark.createDataFrame(rows, "msg_id long, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(inbox)

    def drain():
        stream = spark.readStream.schema(schema).parquet(inbox)
        triage_stream(stream, index, out, state).awaitTermination()
        return sorted((r.msg_id, r.intent) for r in spark.read.parquet(out).collect())

    before = set(Path(stage_root(spark).removeprefix("file:"), "parley").iterdir())
    arrive([(1, "i want a refund"), (2, "   "), (1, "i want a refund")])
    assert drain() == [(1, "returns_refunds")]
    # A later run resumes from its checkpoint; a repeated id is not scored again.
    arrive([(1, "i want a refund"), (3, "hello")])
    assert drain() == [(1, "returns_refunds"), (3, "other_unclear")]
    arrive([(4, "hello")])
    assert [k for k, _ in drain()] == [1, 3, 4]
    # Batches leave no staged tables behind.
    assert set(Path(stage_root(spark).removeprefix("file:"), "parley").iterdir()) == before


def test_stream_keeps_late_messages_and_drops_late_repeats(spark, tmp_path):
    index = retrieval.tfidf_index(spark.createDataFrame([(0, "d0", "refund", "x", "refunds take days", False)], DOCS))
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    seen = []
    for rows in (
        [(1, "hello", "2024-03-09")],
        [(2, "hello", "2024-03-20")],
        # New ones and repeated ones, all older than the newest of before by more than a day.
        [(3, "hello", "2024-01-01"), (1, "hello", "2024-03-09"), (2, "hello", "2024-01-02"), (None, "hello", "2024-01-01")],
        [(3, "hello", "2024-05-01"), (None, "hello", "2024-05-01"), (4, "hello", None)],
    ):
        frame = spark.createDataFrame(rows, "msg_id long, text string, day string")
        frame.select("msg_id", "text", F.col("day").cast("timestamp").alias("ts")).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("msg_id long, text string, ts timestamp").parquet(inbox)
        triage_stream(stream, index, out, state).awaitTermination()
        seen.append(sorted(r.msg_id or 0 for r in spark.read.parquet(out).collect()))
    # Messages without an id are each decided.
    assert seen == [[1], [1, 2], [0, 1, 2, 3], [0, 0, 1, 2, 3, 4]]
    with pytest.raises(ValueError, match="holds decisions"):
        triage_stream(stream, index, out, state + "-new")


def test_ledger_reads_few_ids_whatever_the_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_module, "FAN", 3)
    monkeypatch.setattr(ledger_module, "BUCKET_IDS", 20)
    ledger = ledger_module.Ledger(spark, str(tmp_path / "ledger"), LongType())
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "_id long")
    decided: set[int] = set()
    read = []
    for batch in range(14):
        asked = {batch * 40 + 3, 3, 47, 10**9 + batch}
        assert {r[0] for r in ledger.seen(frame(asked), batch).collect()} == asked & decided
        paths = ledger.paths(frame([7]), ledger.runs(batch - 1))
        read.append(sum(spark.read.parquet(p).count() for p in paths))
        fresh = set(range(batch * 40, batch * 40 + 40))
        ledger.add(frame(fresh), batch)
        # A batch that is done again after a failure leaves the same ledger.
        if batch in (4, 8):
            ledger.add(frame(fresh), batch)
        decided |= fresh
        runs = ledger.runs(batch)
        assert sum(r.ids for r in runs) == len(decided) and len(runs) <= 6
    # A look-up of one id reads one bucket a run; the whole history is 560 ids.
    assert max(read) <= 6 * 40 and read[-1] < 200
    kept = {p.name for p in (tmp_path / "ledger").iterdir()} - {"manifest"}
    assert len(kept) <= 10
    again = ledger_module.Ledger(spark, str(tmp_path / "again"), LongType())
    again.rebuild(frame(decided), 13)
    assert {r[0] for r in again.seen(frame([1, 559, 560]), 14).collect()} == {1, 559}


def test_messages_csv(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "my_twcs.csv").write_text(
        "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
        '1,115712,True,Tue Oct 31 22:10:47 +0000 2017,"a ""quoted""\nline",2,3.0\n'
        "2,AmazonHelp,False,x,plain,,\n"
    )
    (tmp_path / "raw" / "other.csv").write_text("a,b\n1,2\n")
    df = readers.read_messages(spark, str(tmp_path / "raw"))
    rows = df.orderBy("tweet_id").collect()
    assert (rows[0].text, rows[0].in_response_to_tweet_id, rows[0].inbound) == ('a "quoted"\nline', 3, True)
    assert rows[1].in_response_to_tweet_id is None and not rows[1].inbound
    assert readers.read_messages(spark, str(tmp_path / "raw"), ["text"], 1).count() == 1
    assert readers.locate_dump(spark, str(tmp_path / "raw")).endswith("my_twcs.csv")


@pytest.mark.parametrize("size", [40, 150, 10_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_ranges_equal_the_reader_of_whole_files(spark, tmp_path, size, end):
    """Quoted line breaks, commas, doubled quotes, a record longer than many ranges, and no line break at the end."""
    rng = random.Random(size)
    bits = ['"', '""', ",", "\n", "\r\n", "\n\n", "word", "ünï ", " ", "x"]
    rows, folder = [], tmp_path / "dump"
    folder.mkdir()
    for part in range(3):
        lines = [HEAD.strip()]
        for i in range(60):
            text = "".join(rng.choices(bits, k=rng.randint(0, 12))) + ("\nlong line" * 60 if i == 30 else "")
            author = rng.choice(["u1", "a,b", 'q"q', ""])
            rows.append((part * 100 + i, author or None, i % 2 == 0, text or None, None if i % 3 else i))
            quoted = ",".join('"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r ') else v for v in (author, "True" if i % 2 == 0 else "False", "x"))
            lines.append(f"{part * 100 + i},{quoted},\"{text.replace(chr(34), chr(34) * 2)}\",,{'' if i % 3 else f'{i}.0'}")
            if i % 20 == 7:
                lines.append("")
        (folder / f"part-{part}.csv").write_bytes((end.join(lines) + (end if part else "")).encode())
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = readers.read_messages(spark, str(folder))
        got = sorted((r.tweet_id, r.author_id, r.inbound, r.text, r.in_response_to_tweet_id) for r in df.collect())
        assert got == sorted(rows)
        lines = spark.read.option("lineSep", "\n").text(str(folder))
        n_ranges = lines.select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        assert n_ranges > 30 if size < 200 else n_ranges >= 3
        assert [r.tweet_id for r in readers.read_messages(spark, str(folder), ["tweet_id"], 65).collect()] == [*range(60), *range(100, 105)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = spark.read.schema(df.schema).option("header", True).option("multiLine", True).option("escape", '"')
    own = whole.csv(str(folder)).select("tweet_id", "author_id", "inbound", "text").orderBy("tweet_id").collect()
    assert [tuple(r) for r in own] == [r[:4] for r in sorted(rows)] or end == "\r\n"


def test_csv_with_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + '1,u,True,x,"hi,,\n')
    with pytest.raises(Exception, match="odd number of quotes"):
        readers.read_messages(spark, str(tmp_path)).collect()


HEAD = "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"


def test_dump_by_any_name_and_exact_ids(spark, tmp_path):
    for folder, name in (("a", "dump.csv"), ("b", "TWCS.CSV")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text(HEAD + "926173847362519043,u,True,x,hi,,926173847362519041\n")
        row = readers.read_messages(spark, str(tmp_path / folder)).first()
        assert (row.tweet_id, row.in_response_to_tweet_id) == (926173847362519043, 926173847362519041)
        assert readers.read_messages(spark, str(tmp_path / folder / name)).count() == 1
    assert readers.read_messages(spark, str(tmp_path / "b"), name="*twcs*.csv").count() == 1


def test_missing_dump_and_broken_ids_are_errors(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "notes.txt").write_text("x")
    for kwargs in ({}, {"name": "*.csv"}):
        with pytest.raises(FileNotFoundError):
            readers.read_messages(spark, str(tmp_path / "none"), **kwargs)
    (tmp_path / "bad.csv").write_text(HEAD + "1,u,True,x,hi,,9.2e17\n")
    with pytest.raises(Exception, match="not a whole number"):
        readers.read_messages(spark, str(tmp_path / "bad.csv")).collect()


def test_months_and_days_are_utc(spark):
    df = spark.createDataFrame([("Wed Nov 01 03:10:47 +0000 2017",)], "created_at string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert profile.monthly_volume(df, "created_at").first().month == "2017-11"
            assert tuple(profile.date_range(df, "created_at").first()) == ("2017-11-01", "2017-11-01")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_gold_lines(spark, tmp_path):
    record = {"id": "GOLDEN_001", "message_text": "", "query": "q", "expected_intent": "returns_refunds", "expected_escalate": True}
    path = tmp_path / "gold.jsonl"
    path.write_text("\n# note\n   \n" + json.dumps(record) + "\n" + json.dumps({"id": "x", "message_text": "Grüße", "true_escalate": False, "difficulty": "ambiguous"}) + "\n")
    records = readers.gold_records(spark.read.text(str(path)))
    got = {r.id: r for r in gold.gold_field_aliases(records).collect()}
    assert (got["GOLDEN_001"].message_text, got["GOLDEN_001"].true_escalate, got["GOLDEN_001"].difficulty) == ("q", True, "routine")
    assert (got["x"].message_text, got["x"].true_escalate, got["x"].difficulty) == ("Grüße", False, "ambiguous")
    lines = missing_fields(spark.createDataFrame([('{"id": 1}',), ("broken",)], "value string"))
    assert [len(r.missing) for r in lines.collect()] == [8, 9]
    writers.write_gold(readers.read_gold(spark, str(path)), str(tmp_path / "out"))
    assert "Grüße" in "".join(f.read_text() for f in (tmp_path / "out").glob("*.json"))


def test_json_array_of_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        json.dumps([{"id": "a", "judge_evaluation": {"passed": False, "tone_score": 3}, "grounding_sources": [{"doc_id": "d", "score": 0.5}]}, {"id": "b"}], indent=2)
    )
    rows = {r.id: r for r in readers.read_records(spark, str(tmp_path / "r.json")).collect()}
    assert rows["a"].judge_evaluation.tone_score == 3 and rows["a"].grounding_sources[0].doc_id == "d"
    assert rows["b"].judge_evaluation is None


def test_stage(spark):
    df, n = stage_counted(spark.range(10), "t", F.count_if(F.col("id") > 6))
    assert n == 3 and df.count() == 10
    assert stage_root(spark) in df.inputFiles()[0].replace("file://", "").replace("file:", "")
    drop_staged(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0])
    kept = stage(spark.range(3), "t")
    assert kept.count() == 3
    release_stages(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])
