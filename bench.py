"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` selects the data, ``BENCH_CPUS`` the local cores.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Flagship matching first, then one representative per family.
HEADLINE = [
    "r7_retrieve_and_rerank", "r4_bm25_scores", "p9_hard_constraints", "j16_many_profiles",
    "s7_normalize_postings", "a17_schema_conformance", "u2_upsert_jobs", "u1_discover_companies",
    "u6_merge_sources", "s11_url_list", "a5_source_metrics", "u4_poll_health", "w1_failure_streaks",
    "w6_aimd_replay", "a8_latency_by_ats", "a6_freshness_by_ats", "r9_prompt_batches",
    "f12_decode_responses", "m1_ndcg", "m5_precision_by_tier", "w2_precision_trend",
    "a24_metrics_long", "st6_poll_rate", "st1_ingest", "r11_end_to_end",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from vacancia.plans import catalog
    from vacancia.session import configure

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    spark.range(1000).selectExpr("sum(id)").collect()          # start the executors
    queries = catalog.queries()
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    picked = os.environ.get("BENCH_QUERIES")
    names = picked.split(",") if picked else HEADLINE
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):        # compile the JVM code paths on the smallest tables first
        for name in names:
            queries[name](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    if "r7_retrieve_and_rerank" in times:
        out["documents_ranked_per_sec"] = round(n_docs / times["r7_retrieve_and_rerank"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
