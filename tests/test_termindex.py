"""The maintained posting index equals a full recomputation, batch by batch."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vacancia.candidate import Profile
from vacancia.operators.dedup import exclude_seen
from vacancia.operators.retrieval import corpus_stats, query_hits, search_text
from vacancia.operators.constraints import eligible
from vacancia.streaming import matching
from vacancia.streaming.termindex import ROWS, TermIndex

PROFILE = Profile(name="p", role_targets=("backend engineer",), strong=("python", "kafka"), working=("sql",),
                  hard_constraints=(("max_years_experience", "3"),))
JOB = ("job_id bigint, company_slug string, title string, url string, location string, department string, "
       "description string")


def job(i, version=0):
    words = ["python", "kafka", "sql", "cooking", "rust", "data"]
    body = " ".join(words[(i * 7 + version * 3 + k) % 6] for k in range(3 + (i + version) % 9))
    years = "needs 9+ years of experience " if (i + version) % 5 == 0 else ""
    return (i, f"co{i % 4}", f"Backend Engineer {i % 17}" if i % 3 else f"Data Cook {i % 13}", f"u{i}",
            "Remote" if i % 2 else None, None, years + body + " and much more text for a description")


def scorer(frame):
    answers = ["[" + ",".join('{"qualified":true,"score":%d,"reasoning":"x"}' % (50 + i) for i in range(int(n))) + "]"
               for n in frame["n_jobs"]]
    return pd.DataFrame({"batch_id": frame["batch_id"], "response": answers, "latency_ms": 1.0, "error": None})


def full(spark, jobs, runs):
    """Statistics of the open postings, from their texts."""
    fresh = spark.createDataFrame(jobs, JOB)
    if runs:
        fresh = exclude_seen(fresh, spark.createDataFrame(runs, "company_slug string, title string"))
    allowed = eligible(fresh, PROFILE, text="description")
    words = search_text(F.col("title"), F.col("location"), F.col("department"), F.col("description"))
    rows = query_hits(allowed, TermIndex(spark, "file:/tmp/none", PROFILE).terms, words)
    stats = corpus_stats(rows, TermIndex(spark, "file:/tmp/none", PROFILE).terms).first()
    return fresh.count(), stats["n_docs"], stats["avg_len"], stats["df"], sorted(
        (r["job_id"], r["doc_len"], [tuple(h) for h in r["hits"]]) for r in rows.collect())


def kept(index):
    c = index.corpus().first()
    return index.open_count(), c["n_docs"], c["avg_len"], c["df"], sorted(
        (r["job_id"], r["doc_len"], [tuple(h) for h in r["hits"]]) for r in index.open_rows().collect())


def test_changes_removals_and_runs_are_retracted(spark, tmp_path):
    index = TermIndex(spark, f"file://{tmp_path}/i", PROFILE, text="description", fanout=2)
    table, runs = {}, []
    steps = [
        (range(0, 40), 0, [], []),
        (range(30, 60), 1, [3, 7, 35], []),                        # 30 to 39 change, some of them leave
        (range(60, 63), 0, [], [("co1", "Backend Engineer 1"), ("co2", "Data Cook 2"), ("no", "such")]),
        (range(63, 90), 0, [61, 200], [("co1", "Backend Engineer 1"), ("co3", "Backend Engineer 11")]),
        (range(0, 5), 2, [], []),                                   # 3 comes back
    ]
    for b, (ids, version, gone, scored) in enumerate(steps):
        put = [job(i, version) for i in ids]
        table.update({j[0]: j for j in put})
        for g in gone:
            table.pop(g, None)
        runs += scored
        given = (spark.createDataFrame(put, JOB), spark.createDataFrame([(g,) for g in gone], "job_id bigint"),
                 spark.createDataFrame(runs, "company_slug string, title string"))
        index.apply(b, *given, query="q")
        want = full(spark, list(table.values()), runs)
        assert kept(index) == want
        if b in (1, 3):                                             # a retried batch changes nothing
            index.apply(b, *given, query="q")
            assert kept(index) == want
    assert len(index.rows_log.version().entries) <= 3


def test_an_empty_index(spark, tmp_path):
    index = TermIndex(spark, f"file://{tmp_path}/i", PROFILE, text="description")
    assert index.open_count() == 0 and index.open_rows().count() == 0
    index.apply(0, query="q")
    assert index.open_count() == 0
    assert matching.indexed_tick(index, spark.createDataFrame([], JOB), scorer, min_new=1) is None
    assert spark.createDataFrame([], ROWS).columns[:3] == ["job_id", "company_slug", "title"]


@pytest.mark.parametrize("files", [1, 4])
def test_runs_equal_the_full_recomputation(spark, tmp_path, files):
    """Each tick's run is that of the whole tables at that time, with the runs before it excluded."""
    jobs = [job(i) for i in range(120)]
    for f in range(files):
        spark.createDataFrame(jobs[f::files], JOB).coalesce(1).write.parquet(f"{tmp_path}/in/f{f}")
    arrivals = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(
        f"{tmp_path}/in")
    seen, columns = [], ["company_slug", "title", "url", "score", "band", "reasoning"]

    def load_runs(s, batch_id):
        return s.read.parquet(*[f"{tmp_path}/runs/{b}" for b in range(batch_id)]) if batch_id else None

    def save(df, batch_id):
        df.write.parquet(f"{tmp_path}/runs/{batch_id}")

    def load_jobs(s):
        return s.read.option("recursiveFileLookup", "true").schema(JOB).parquet(f"{tmp_path}/in")
    index = TermIndex(spark, f"file://{tmp_path}/index", PROFILE, text="description", fanout=3)
    real = index.apply

    def noted(batch_id, df, **more):
        seen.append(sorted(r["job_id"] for r in df.select("job_id").collect()))
        real(batch_id, df, **more)
    index.apply = noted
    matching.matching_stream(arrivals, index, load_jobs, load_runs, save, scorer, f"{tmp_path}/c", available_now=True,
                             k=20, n=6, batch=4, min_new=5).awaitTermination()
    assert len(seen) == files and sorted(sum(seen, [])) == list(range(120))
    there = []
    for b in range(files):
        there += seen[b]
        runs = load_runs(spark, b)
        want = matching.matching_tick(spark.createDataFrame([jobs[i] for i in there], JOB), runs, PROFILE, scorer, k=20, n=6,
                                      batch=4, min_new=5, text="description")
        got = spark.read.parquet(f"{tmp_path}/runs/{b}")
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
