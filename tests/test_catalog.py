"""The registered queries: contract, coverage and agreement with their oracles."""
import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tools.check import canonical
from vacancia.plans.domain import TABLES

# One query per family; the whole catalogue is compared by tools/check.py.
SAMPLE = ["s7_normalize_postings", "u2_upsert_jobs", "s13_crawl_jsonl", "u6_merge_sources", "w1_failure_streaks",
          "w6_aimd_replay", "a24_metrics_long", "p9_hard_constraints", "r7_retrieve_and_rerank",
          "f12_decode_responses", "m1_ndcg", "p20_triage_views", "st3_health"]


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 140
    assert len(oracles) / len(queries) > 0.95


def test_entry(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "title", "bm25_score", "combined"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description])
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
