import re
from collections import Counter

import duckdb

import __spark_entry__ as entry
from tests.llm.conftest import prose
from vacancia.llm.quality import RULES, filter_quality, measure, quality_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_match_brute_force(awkward):
    got = sorted(tuple(r) for r in quality_report(awkward).select(*STATS).collect())
    assert got == sorted(brute(r["text"]) for r in awkward.select("text").collect())


def test_repeated_windows_overlap_and_touch(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "a b c x a b c d b c d", "p q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_report(df).collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_verdict_does_not_depend_on_the_order(spark, awkward):
    good = spark.createDataFrame(
        [(1, prose(9, 200)), (2, "### " * 80), (3, "NO WAY " * 60), (4, prose(8, 49)), (5, "same line\n" * 60)],
        "doc_id long, text string")
    kept = {r["doc_id"] for r in quality_report(good).filter("kept").collect()}
    assert kept == {1} == {r["doc_id"] for r in filter_quality(good).collect()}
    assert filter_quality(awkward).columns == awkward.columns
    assert all(r["n_words"] >= 50 for r in quality_report(awkward).filter("kept").collect())


def test_the_cascade_is_ordered_by_rejection_per_cost(spark, sf_dir):
    found = measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {m.rule for m in found} == set(RULES)
    assert [m.gain for m in found] == sorted((m.gain for m in found), reverse=True)


def test_empty_table(nothing):
    assert quality_report(nothing).count() == 0 and filter_quality(nothing).count() == 0


def test_oracle(spark, sf_dir):
    name = "op6_quality_cascade"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r) for r in entry.queries()[name](spark, sf_dir).select(*columns).collect()) == want
