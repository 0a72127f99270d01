"""Headline jobs on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every job runs once on the
smallest tables first, so that no timed job carries the compilation of code. `scaling` gives search and threads on a
tenth of the data beside the timed size.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from parley.operators import baselines, metrics, precedents, profile, retrieval
from parley.plans import corpus, evaluate, triage
from parley.session import local_session, stage
from parley.workload import seeds

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df: DataFrame) -> None:
    """Compute every column of every row."""
    df.write.format("noop").mode("overwrite").save()


def jobs_for(spark, sf: str) -> dict:
    """Headline jobs over the tables below sf, in the order in which they build on each other."""
    state: dict = {}

    def build_precedents() -> None:
        state["store"] = stage(precedents.build_precedents(seeds.pairs(spark, sf)), "store")

    def index_precedents() -> None:
        state["index"] = retrieval.tfidf_index(state["store"])

    def triage_messages() -> None:
        run(triage.triage(seeds.messages(spark, sf), state["index"]))

    def evaluate_gold() -> None:
        gold = seeds.gold(spark, sf)
        records = stage(evaluate.evaluated_records(gold, state["index"]), "records")
        for table in evaluate.evaluate(records).values():
            run(table)

    def index_documents() -> None:
        state["documents"] = retrieval.tfidf_index(seeds.docs(spark, sf))

    def search_documents() -> None:
        run(retrieval.tfidf_search(seeds.queries(spark, sf), state["documents"]))

    return {
        "dialogue_pairs_conversations": lambda: run(corpus.build_pairs(seeds.chat(spark, sf))),
        "dialogue_pairs_reply_tree": lambda: run(corpus.build_pairs(seeds.tree(spark, sf))),
        "length_stats_documents": lambda: run(profile.length_stats(seeds.table(spark, sf, "documents"), "text")),
        "ngrams_documents": lambda: run(profile.ngram_topk(seeds.table(spark, sf, "documents"), "text")),
        "pii_audit_documents": lambda: run(profile.pii_audit(seeds.table(spark, sf, "documents"), "text")),
        "boilerplate_pairs": lambda: run(profile.boilerplate_report(seeds.pairs(spark, sf), "customer_message")),
        "build_precedents": build_precedents,
        "index_precedents": index_precedents,
        "triage_messages": triage_messages,
        "baselines_gold": lambda: run(metrics.escalation_rates(baselines.baseline_runs(seeds.gold(spark, sf)), ["system"])),
        "evaluate_gold": evaluate_gold,
        "index_documents": index_documents,
        "search_documents": search_documents,
    }


def timed(jobs: dict) -> dict[str, float]:
    seconds = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS))
    parent = os.path.dirname(SF)
    if os.path.isdir(f"{parent}/sf0.001"):
        timed(jobs_for(spark, f"{parent}/sf0.001"))
    rows = {
        "triage_messages": "orders",
        "evaluate_gold": "orders",
        "baselines_gold": "orders",
        "build_precedents": "orders",
        "index_documents": "documents",
        "ngrams_documents": "documents",
        "dialogue_pairs_reply_tree": "events",
    }
    seconds = timed(jobs_for(spark, SF))
    tenth = f"{parent}/sf{float(SF.rsplit('sf', 1)[-1]) / 10:g}"
    pair = ("dialogue_pairs_reply_tree", "index_documents", "search_documents")
    small = jobs_for(spark, tenth) if os.path.isdir(tenth) else {}
    scaling = {n: {"tenth": s, "whole": seconds[n]} for n, s in timed({n: small[n] for n in pair if small}).items()}
    rates = {n: round(spark.read.parquet(f"{SF}/{t}.parquet").count() / seconds[n]) for n, t in rows.items()}
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "scaling": scaling,
                "sf": SF.rsplit("sf", 1)[-1],
                "cores": CPUS,
                "spark": spark.version,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
