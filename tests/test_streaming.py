"""Streams fed in several micro-batches must leave what the batch operators compute."""
import random
from contextlib import contextmanager

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_ordered import aimd, machine
from vacancia.plans.streams import ROCKSDB, drain, source
from vacancia.streaming import ingest, matching, rates, state
from vacancia.streaming.tables import read_last
from vacancia.candidate import Profile

POLL = ("poll_id bigint, company_id bigint, t bigint, status string, throttled boolean, ats_type string, "
        "attempted_at timestamp")


@pytest.fixture(scope="module")
def poll_files(spark, tmp_path_factory):
    """Twelve files in time order, half of the rows of one company."""
    rng, root, rows = random.Random(3), tmp_path_factory.mktemp("polls"), []
    for i in range(1200):
        company = 0 if rng.random() < 0.5 else rng.randrange(1, 6)
        bad = rng.random() < (0.85 if 300 < i < 700 else 0.2)
        rows.append((i, company, 1_700_000_000 + i * 240, "error" if bad else "success", rng.random() < 0.05))
    for b in range(12):
        part = spark.createDataFrame(rows[b * 100:(b + 1) * 100],
                                     "poll_id bigint, company_id bigint, t bigint, status string, throttled boolean")
        part.withColumn("ats_type", F.when(F.col("company_id") == 0, "lever").otherwise("ashby")) \
            .withColumn("attempted_at", F.timestamp_seconds("t")).coalesce(1) \
            .write.parquet(f"{root}/in/f{b:02d}")
    return f"{root}/in", rows


def stream(spark, path):
    return spark.readStream.schema(POLL).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(path)


def test_health_stream(spark, poll_files, tmp_path):
    path, rows = poll_files
    state.health_stream(stream(spark, path), f"{tmp_path}/s", f"{tmp_path}/c", True).awaitTermination()
    got = {r.company_id: (r.consecutive_failures, r.d, r.n) for r in read_last(
        spark, f"{tmp_path}/s", state.HEALTH).select("*", F.unix_seconds("disabled_at").alias("d"),
                                                     F.unix_seconds("next_poll_at").alias("n")).collect()}
    per = {}
    for r in rows:
        per.setdefault(r[1], []).append(r)
    assert got == {c: machine(items) for c, items in per.items()}


def test_aimd_stream(spark, poll_files, tmp_path):
    path, rows = poll_files
    ceilings = {"lever": (6, 100), "ashby": (3, 250)}
    state.aimd_stream(stream(spark, path), f"{tmp_path}/s", f"{tmp_path}/c", ceilings, True).awaitTermination()
    got = {r.ats_type: (r.current_concurrent, r.current_interval_ms, r.clean_window) for r in read_last(
        spark, f"{tmp_path}/s", state.AIMD).collect()}
    for ats, pick in (("lever", lambda r: r[1] == 0), ("ashby", lambda r: r[1] != 0)):
        assert got[ats] == aimd([r for r in rows if pick(r)], *ceilings[ats])


POLLS = "poll_id bigint, company_id bigint, t bigint, status string"


def poll_history(seed=4, companies=4, polls=160):
    """Failing and recovering companies, with equal times."""
    rng, t0 = random.Random(seed), 1_700_000_000
    rows = []
    for c in range(companies):
        at = t0
        for k in range(polls // companies):
            at += rng.choice([0, 60, 900, 7200, 90_000])
            rows.append((c * 1000 + k, c, at, "success" if rng.random() < 0.12 else "error"))
    return rows


@contextmanager
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def polls_in(spark, folder, rows, batches):
    size = -(-len(rows) // batches)
    for b in range(batches):
        spark.createDataFrame(rows[b * size:(b + 1) * size], POLLS).withColumn(
            "attempted_at", F.timestamp_seconds("t")).coalesce(1).write.parquet(f"{folder}/f{b}")
    schema = POLLS + ", attempted_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def read_whole(query, rows, most=60):
    """Processing-time timers keep a stream going; it is stopped when all rows are in."""
    import time
    try:
        for _ in range(most * 4):
            if query.exception() or sum(p["numInputRows"] for p in query.recentProgress) >= rows:
                break
            time.sleep(0.25)
    finally:
        query.stop()
    assert not query.exception() and sum(p["numInputRows"] for p in query.recentProgress) == rows


@pytest.mark.parametrize("batches, hold", [(1, None), (4, None), (4, 10 ** 12), (4, 0)])
def test_stateful_and_folded_schedules_agree(spark, tmp_path, batches, hold):
    """In falling time order every poll but the first batch's comes late; with hold 0 the polls rise and are settled at once."""
    rows = sorted(poll_history(), key=lambda r: (r[2], r[0]), reverse=hold != 0)
    if hold == 0:           # polls of one moment are not parted
        rows = [r for k, r in enumerate(rows) if k == 0 or r[1:3] != rows[k - 1][1:3]]
    last = max(r[2] for r in rows) * 1000
    with rocksdb(spark):
        query = (state.recovery_schedule(polls_in(spark, f"{tmp_path}/in", rows, batches), hold_ms=hold, clock_ms=last)
                 .writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
                 .trigger(processingTime="100 milliseconds").start())
        read_whole(query, len(rows))
    changes = spark.read.schema("company_id bigint, due_ms bigint, sign bigint").parquet(f"{tmp_path}/out")
    got = sorted(map(tuple, state.recovery_schedule_now(changes).collect()))
    state.recovery_stream(polls_in(spark, f"{tmp_path}/in2", rows, batches), f"{tmp_path}/s", f"{tmp_path}/c2", True).awaitTermination()
    want = sorted(map(tuple, state.recovery_points(spark, f"{tmp_path}/s").collect()))
    assert got == want and len(want) > 10
    if batches == 4 and hold is None:
        assert changes.filter("sign = -1").count() > 0


def test_timers_fire_at_the_retry_points(spark, tmp_path):
    """A company disabled an hour less ten seconds ago: two seconds short of a retry, the timer brings it."""
    import time
    now = int(time.time())
    rows = [(k, 7, now - 3590 + k // 5, "error") for k in range(5)]
    polls = polls_in(spark, f"{tmp_path}/in", rows, 1)
    with rocksdb(spark):
        query = (state.recovery_schedule(polls).writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start())
        try:
            for _ in range(60):
                time.sleep(1)
                got = [] if not (tmp_path / "out").exists() else [tuple(r) for r in spark.read.schema(
                    "company_id bigint, due_ms bigint, sign bigint").parquet(f"{tmp_path}/out").collect()]
                if len(got) == 2:
                    break
        finally:
            query.stop()
    assert sorted(got) == [(7, (now - 3590 + 600) * 1000, 1), (7, (now - 3590 + 3600) * 1000, 1)]


@pytest.mark.parametrize("cut", range(0, 100, 9))
def test_settling_changes_no_period(cut):
    polls = np.array([(t * 1000, i, s == "success") for i, c, t, s in poll_history(9, 1, 100)], np.int64)
    rng = np.random.default_rng(1)
    polls = polls[rng.permutation(len(polls))]
    until = int(np.sort(polls[:, 0])[cut])
    left, settled = state.settle(polls, until)
    whole = state.disabled_periods(polls)
    assert state.disabled_periods(left, settled=settled) == [p for p in whole if p[1] is None or p[1] + 1 >= until]


def test_ingest_stream_is_idempotent(spark, tmp_path):
    payload = ("ats_type string, slug string, company_id bigint, body string, status_code int, "
               "aborted boolean, fetched_at timestamp, latency_ms bigint")
    for day in (1, 2):
        body = '{"jobs":[{"shortcode":"W1","title":"v%d","url":"u"}]}' % day
        spark.sql(f"""select 'workable' ats_type, 'co' slug, 1L company_id, '{body}' body, 200 status_code,
            false aborted, timestamp '2024-01-0{day} 00:00:00' fetched_at, 5L latency_ms union all
            select 'workable', 'co', 2L, '{body}', 503, false, timestamp '2024-01-0{day} 00:00:00', 5L"""
                  ).coalesce(1).write.parquet(f"{tmp_path}/in/d{day}")
    src = spark.readStream.schema(payload).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    for _ in range(2):       # the second start finds nothing new
        ingest.ingest_stream(src, f"{tmp_path}/t", f"{tmp_path}/c", True).awaitTermination()
    jobs = ingest.current_jobs(spark, f"{tmp_path}/t").collect()
    assert [(r.external_id, r.title, r.first_seen_at.day) for r in jobs] == [("W1", "v2", 1)]
    log = ingest.poll_log(spark, f"{tmp_path}/t").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in log} == {"success": 2, "error": 2}


@pytest.mark.parametrize("batches", [1, 4])
def test_unsorted_history_loses_nothing(spark, tmp_path, batches):
    """Rows in falling time order over several micro-batches: every posting, window and lag is counted."""
    rows = spark.sql("""select id % 40 company_id, cast(id % 7 as string) external_id, cast(id % 3 as string) raw_json,
        timestamp_seconds(1700000000 - id * 977) fetched_at, timestamp_seconds(1700000000 - id * 977) first_seen_at,
        timestamp_seconds(1699990000 - id * 990) ats_posted_at from range(2000)""")
    for b in range(batches):
        rows.filter(f"int((unix_seconds(fetched_at) - 1600000000) / 977) % {batches} = {b}").coalesce(1).write.parquet(
            f"{tmp_path}/in/f{b}")
    def source():
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option(
            "recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    for _ in range(2):       # a second start finds nothing new
        rates.once_per_posting_stream(source(), f"{tmp_path}/o", f"{tmp_path}/c", True).awaitTermination()
        rates.counting_stream(source(), rates.lag_counts, f"{tmp_path}/n", f"{tmp_path}/cn", True).awaitTermination()
    once = rates.once_per_posting(spark, f"{tmp_path}/o", schema)
    keys = ["company_id", "external_id", "raw_json"]
    assert once.count() == rows.select(*keys).distinct().count() == once.select(*keys).distinct().count()
    counts = rates.folded(spark, f"{tmp_path}/n", "window_start timestamp, window_end timestamp, lag_ms bigint")
    got = {r.window_start: (r.n, r.p50_ms, r.p95_ms) for r in rates.freshness(counts).collect()}
    want = {}
    for r in rows.selectExpr("date_trunc('day', first_seen_at) d",
                             "unix_millis(first_seen_at) - unix_millis(ats_posted_at) lag").collect():
        want.setdefault(r.d, []).append(r.lag)
    rank = lambda xs, p: sorted(xs)[max(0, -(-len(xs) * p // 100) - 1)]
    assert got == {d: (len(x), rank(x, 50), rank(x, 95)) for d, x in want.items()}


def test_matching_tick_gate(spark):
    jobs = spark.createDataFrame([(i, "co", f"Backend Engineer {i}", "u", None, None, "python", "{}")
                                  for i in range(8)],
                                 "job_id bigint, company_slug string, title string, url string, location string, "
                                 "department string, description string, raw_json string")
    profile = Profile(name="p", strong=("python",))

    def scorer(frame):
        import pandas as pd
        return pd.DataFrame({"batch_id": frame["batch_id"], "response": ['[{"score": 70, "qualified": true}]'] * len(frame),
                             "latency_ms": 4.0, "error": None})
    assert matching.matching_tick(jobs, None, profile, scorer, min_new=50) is None
    out = matching.matching_tick(jobs, None, profile, scorer, n=6, batch=3, min_new=5).collect()
    assert len(out) == 6 and sum(r.score == 70 for r in out) == 2
    runs = spark.createDataFrame([("co", f"Backend Engineer {i}") for i in range(4)], "company_slug string, title string")
    assert matching.matching_tick(jobs, runs, profile, scorer, min_new=5) is None


def test_matching_loop_with_every_posting_scored(spark, sf_dir, tmp_path):
    """No tick stores a run then; the query has no rows, as its SQL."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 6 <> 0").withColumn("lang", F.lit("fr"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["st5_matching_loop"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["st5_matching_loop"])
    assert got.columns == [d[0] for d in want.description]
    assert got.collect() == want.fetchall() == []


@pytest.mark.parametrize("layout", ["file", "parts", "partitions"])
def test_a_table_of_part_files_is_streamed_whole(spark, tmp_path, layout):
    rows = spark.range(100).selectExpr("id", "cast(id % 3 as int) as k")
    table = f"{tmp_path}/sf/events.parquet"
    if layout == "file":
        rows.coalesce(1).write.parquet(f"{tmp_path}/made")
        part, = (f for f in (tmp_path / "made").iterdir() if f.name.endswith(".parquet"))
        (tmp_path / "sf").mkdir()
        (tmp_path / "sf" / "events.parquet").write_bytes(part.read_bytes())
        rows.coalesce(1).write.parquet(f"{tmp_path}/sf/other.parquet")
    elif layout == "parts":
        rows.repartition(4).write.parquet(table)
    else:
        rows.repartition(2).write.partitionBy("k").parquet(table)
    got = drain(source(spark, f"{tmp_path}/sf", "events")).select("id", "k").collect()
    assert sorted(map(tuple, got)) == [(i, i % 3) for i in range(100)]


@pytest.mark.parametrize("batches", [1, 4])
def test_recovery_points_count_late_polls(spark, tmp_path, batches):
    """Polls in falling time order: company 7 is disabled until a success, 8 to the last poll, 9 never."""
    hour, day, t0 = 3600, 86400, 1_700_000_000
    rows = [(i, 7, t0 + i * 10, "error") for i in range(7)] + [(10, 7, t0 + 40 + 2 * day, "success")]
    rows += [(20 + i, 8, t0 + day + i, "error") for i in range(5)]
    rows += [(30 + i, 9, t0 + i, "success" if i == 2 else "error") for i in range(6)] + [(40, 9, t0 + 3 * day, "success")]
    rows.sort(key=lambda r: -r[2])
    size = -(-len(rows) // batches)
    for b in range(batches):
        spark.createDataFrame(rows[b * size:(b + 1) * size], "poll_id bigint, company_id bigint, t bigint, status string").withColumn(
            "attempted_at", F.timestamp_seconds("t")).coalesce(1).write.parquet(f"{tmp_path}/in/f{b}")
    state.recovery_stream(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/s", f"{tmp_path}/c", True).awaitTermination()
    got = sorted((r.company_id, r.due_ms // 1000) for r in state.recovery_points(spark, f"{tmp_path}/s").collect())
    assert got == [(7, t0 + 40 + x) for x in (600, hour, 4 * hour, day)] + [
        (8, t0 + day + 4 + x) for x in (600, hour, 4 * hour, day)]
