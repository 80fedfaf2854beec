"""Streaming queries: each runs its stream to the end of the input and reads its sink."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators import ratecontrol
from vacancia.plans.domain import ctes, view
from vacancia.plans.feed import _CONFORM, _normal_sql, VENDOR_SQL
from vacancia.plans.health import health
from vacancia.plans.matching import _REL, _RERANK, PROFILE
from vacancia.plans.registry import Registry, ms, scratch
from vacancia.streaming import ingest, matching, rates, state
from vacancia.streaming.tables import read_all, read_last, write_batch
from vacancia.streaming.termindex import TermIndex

streams = Registry()

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table as a file stream; the table is one file or a folder of part files."""
    file = f"{name}.parquet"
    table = spark.read.parquet(f"{sf}/{file}")
    stream = spark.readStream.schema(table.schema)
    # A file cannot be the path of a stream, so it is picked by its name from the folder above.
    single = [f.rstrip("/").split("/")[-2:].count(file) == 1 and f.endswith(f"/{file}") for f in table.inputFiles()]
    if single == [True]:
        return stream.option("pathGlobFilter", file).parquet(sf)
    return stream.parquet(f"{sf}/{file}")


def streamed(spark: SparkSession, sf: str, derived: str, *tables: str) -> DataFrame:
    """A derived table over streaming inputs."""
    return view(spark, sf, derived, {t: source(spark, sf, t) for t in tables})


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into parquet and read it back."""
    spark = df.sparkSession
    base = scratch(spark, "stream")
    query = (df.writeStream.format("parquet").outputMode(mode)
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@streams.add("st1_ingest", ctes("payloads") + f"""
, p AS ({' UNION ALL '.join(_normal_sql(a).replace('SELECT fetch_id,', 'SELECT company_id, fetched_at, fetch_id,')
        .replace('FROM payloads', "FROM (SELECT * FROM payloads WHERE NOT aborted AND status_code = 200)")
        for a in VENDOR_SQL)})
SELECT company_id, external_id, title, epoch_ms(min(fetched_at)) AS first_seen_at_ms FROM p
GROUP BY ALL""")
def _(spark, sf):
    base = scratch(spark, "ingest")
    payloads = streamed(spark, sf, "payloads", "orders")
    ingest.ingest_stream(payloads, base, f"{base}/checkpoint", available_now=True).awaitTermination()
    return ingest.current_jobs(spark, base).select(
        "company_id", "external_id", "title", ms("first_seen_at"))


@streams.add("st1_ingest_poll_log", ctes("payloads") + f"""
SELECT CASE WHEN aborted THEN 'timeout' WHEN status_code BETWEEN 200 AND 299 AND conformant
  THEN 'success' ELSE 'error' END AS status, count(*) AS n FROM ({_CONFORM}) GROUP BY 1""")
def _(spark, sf):
    base = scratch(spark, "ingest")
    payloads = streamed(spark, sf, "payloads", "orders")
    ingest.ingest_stream(payloads, base, f"{base}/checkpoint", available_now=True).awaitTermination()
    return ingest.poll_log(spark, base).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@streams.add("st2_once_per_posting", """
SELECT DISTINCT l_partkey AS company_id, CAST(l_suppkey AS VARCHAR) AS external_id,
  l_returnflag AS raw_json FROM lineitem""")
def _(spark, sf):
    base = scratch(spark, "once")
    rows = source(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("company_id"), F.col("l_suppkey").cast("string").alias("external_id"),
        F.col("l_returnflag").alias("raw_json"), F.col("l_shipdate").cast("timestamp").alias("fetched_at"))
    rates.once_per_posting_stream(rows, f"{base}/out", f"{base}/checkpoint", True).awaitTermination()
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rates.once_per_posting(spark, f"{base}/out", schema).select("company_id", "external_id", "raw_json")


def counted(rows, partial, schema: str):
    """Stream ``rows`` into partial counts and fold them."""
    base = scratch(rows.sparkSession, "counts")
    rates.counting_stream(rows, partial, f"{base}/out", f"{base}/checkpoint", True).awaitTermination()
    return rates.folded(rows.sparkSession, f"{base}/out", f"window_start timestamp, window_end timestamp{schema}")




_HEALTH = ctes("polls")


@streams.add("st3_health", _HEALTH + """
, last AS (SELECT company_id, max(attempted_at) FILTER (WHERE status = 'success') AS ok
  FROM polls GROUP BY company_id),
 since AS (SELECT p.company_id, p.attempted_at, row_number() OVER (PARTITION BY p.company_id
  ORDER BY attempted_at, poll_id) AS rn FROM polls p JOIN last l USING (company_id)
  WHERE status <> 'success' AND (ok IS NULL OR attempted_at > ok))
SELECT l.company_id, coalesce(max(rn), 0) AS consecutive_failures, coalesce(max(rn), 0) < 5 AS active,
  epoch_ms(min(CASE WHEN rn = 5 THEN s.attempted_at END)) AS disabled_at_ms
FROM last l LEFT JOIN since s USING (company_id) GROUP BY l.company_id""")
def _(spark, sf):
    base = scratch(spark, "health")
    polls = streamed(spark, sf, "polls", "events")
    state.health_stream(polls, f"{base}/state", f"{base}/checkpoint", True).awaitTermination()
    return read_last(spark, f"{base}/state", state.HEALTH).select(
        "company_id", "consecutive_failures", "active", ms("disabled_at"))


@streams.add("st3_recovery_schedule", _HEALTH + """
, p AS (SELECT company_id, poll_id, epoch_ms(attempted_at) AS t, status = 'success' AS ok,
   sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY company_id ORDER BY attempted_at, poll_id)
   AS episode FROM polls),
 f AS (SELECT company_id, episode, t, row_number() OVER (PARTITION BY company_id, episode ORDER BY t, poll_id) AS rn
   FROM p WHERE NOT ok),
 e AS (SELECT company_id, episode - 1 AS episode, t - 1 AS until FROM p WHERE ok),
 d AS (SELECT f.company_id, f.t AS since, coalesce(e.until, (SELECT max(t) FROM p)) AS until
   FROM f LEFT JOIN e ON f.company_id = e.company_id AND f.episode = e.episode WHERE f.rn = 5),
 r AS (SELECT company_id, until, since + unnest(list_concat([600000, 3600000, 14400000],
   list_transform(range(1, greatest(0, (until - since) // 86400000) + 1), lambda k: k * 86400000))) AS due_ms FROM d)
SELECT company_id, due_ms::BIGINT AS due_ms FROM r WHERE due_ms <= until""")
def _(spark, sf):
    """Recovery attempts of disabled companies, from all polls whatever their order."""
    base = scratch(spark, "recovery")
    polls = streamed(spark, sf, "polls", "events")
    state.recovery_stream(polls, f"{base}/polls", f"{base}/checkpoint", True).awaitTermination()
    return state.recovery_points(spark, f"{base}/polls")


@streams.add("st4_aimd", f"""SELECT ats_type, current_concurrent, ceiling_concurrent, current_interval_ms,
  ceiling_interval_ms, clean_window, current_concurrent AS batch_concurrent,
  current_interval_ms AS batch_interval_ms FROM ({health.oracles['w6_aimd_replay']})""")
def _(spark, sf):
    """Controller state a stream leaves, next to the batch replay's (must agree)."""
    base = scratch(spark, "aimd")
    vendors = view(spark, sf, "companies").select("company_id", "ats_type")
    polls = streamed(spark, sf, "polls", "events").join(vendors, "company_id")
    state.aimd_stream(polls, f"{base}/state", f"{base}/checkpoint", available_now=True).awaitTermination()
    streamed_state = read_last(spark, f"{base}/state", state.AIMD)
    batch = ratecontrol.aimd_replay(view(spark, sf, "polls").join(vendors, "company_id"))
    return streamed_state.join(
        batch.select("ats_type", F.col("current_concurrent").alias("batch_concurrent"),
                     F.col("current_interval_ms").alias("batch_interval_ms")), "ats_type")


def _scorer(frame: pd.DataFrame) -> pd.DataFrame:
    """Stand-in model: a fixed answer for every posting of a prompt."""
    def answer(n: int) -> str:
        return "[" + ",".join('{"qualified":true,"score":%d,"reasoning":"fixed answer"}'
                              % (50 + i) for i in range(int(n))) + "]"
    return pd.DataFrame({"batch_id": frame["batch_id"], "response": frame["n_jobs"].map(answer),
                         "latency_ms": 1000.0, "error": None})


RUN = "company_slug string, title string, url string, score double, band string, reasoning string"
_LOOP = """, fresh AS (SELECT * FROM postings p WHERE NOT EXISTS (SELECT 1 FROM stored_runs r
  WHERE r.company_slug = p.company_slug AND r.title = p.title))
""" + _RERANK.replace("FROM postings", "FROM fresh").replace("LIMIT 50)", "LIMIT 30)")


@streams.add("st5_matching_loop", ctes("postings", "stored_runs") + _LOOP + f"""
, gate AS (SELECT b.*, company_slug, url, {_REL} AS relevant FROM best b JOIN (SELECT doc_id, company_slug,
   url FROM postings) USING (doc_id)),
 nb AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) % 20 AS i FROM gate WHERE relevant)
SELECT company_slug, title, url, CAST(50 + i AS DOUBLE) AS score, CASE WHEN 50 + i >= 65 THEN 'push'
  ELSE 'digest' END AS band, 'fixed answer' AS reasoning FROM nb UNION ALL
SELECT company_slug, title, url, 0.0, 'skip', concat('Title "', title, '" not SWE-relevant')
FROM gate WHERE NOT relevant""")
def _(spark, sf):
    """One matching tick per trigger over the index that the arriving postings maintain; reads the stored runs.

    No run is stored if no tick has enough unscored postings; the log of runs is empty then.
    """
    base = scratch(spark, "matching")

    def jobs(s):
        return view(s, sf, "postings").withColumnRenamed("doc_id", "job_id")

    def save(df, batch_id):
        write_batch(df, f"{base}/runs", batch_id)
    index = TermIndex(spark, f"{base}/index", PROFILE, text="description")
    matching.matching_stream(
        streamed(spark, sf, "postings", "documents").withColumnRenamed("doc_id", "job_id"), index, jobs,
        lambda s, b: view(s, sf, "stored_runs"), save, _scorer, f"{base}/checkpoint",
        available_now=True, k=200, n=30).awaitTermination()
    return read_all(spark, f"{base}/runs", RUN)


@streams.add("st6_poll_rate", ctes("polls") + """
, g AS (SELECT CASE WHEN status = 'success' THEN 'success' ELSE 'fail' END AS result,
   time_bucket(INTERVAL 15 SECOND, attempted_at, TIMESTAMP '1970-01-01') AS b FROM polls),
 w AS (SELECT b - to_seconds(15 * i) AS s, result FROM g, (SELECT unnest(range(20)) AS i))
SELECT epoch_ms(s) AS window_start_ms, result, count(*) AS n, round(count(*) / 300, 6) AS rate FROM w
GROUP BY ALL""")
def _(spark, sf):
    counts = counted(streamed(spark, sf, "polls", "events"), rates.poll_counts, ", result string")
    return rates.poll_rates(counts).select(ms("window_start"), "result", "n", F.round("rate", 6).alias("rate"))



_PER_DAY = """
, w AS (SELECT time_bucket(INTERVAL 1 DAY, first_seen_at, TIMESTAMP '1970-01-01') AS s, department
  FROM jobs), c AS (SELECT s, department, count(*) AS n FROM w GROUP BY ALL)
"""


def _ingested(spark, sf):
    return counted(streamed(spark, sf, "jobs", "orders"),
                   lambda df: rates.tumbling_counts(df, "first_seen_at", "1 day", ("department",)),
                   ", department string")


@streams.add("st7_ingested_over_time", ctes("jobs") + _PER_DAY + """
SELECT epoch_ms(s) AS window_start_ms, department, n FROM c""")
def _(spark, sf):
    return _ingested(spark, sf).select(ms("window_start"), "department", "n")


@streams.add("st7_ingested_cumulative", ctes("jobs") + _PER_DAY + """
SELECT epoch_ms(s) AS window_start_ms, department, CAST(sum(n) OVER (PARTITION BY department ORDER BY s) AS BIGINT)
  AS total FROM c""")
def _(spark, sf):
    return rates.cumulative(_ingested(spark, sf), ("department",)).select(ms("window_start"), "department", "total")



@streams.add("st8_labels_per_day", ctes("llm_log") + """
SELECT epoch_ms(date_trunc('day', labeled_at)::TIMESTAMP) AS window_start_ms, count(*) AS n FROM llm_log
GROUP BY ALL""")
def _(spark, sf):
    labels = streamed(spark, sf, "llm_log", "documents")
    counts = counted(labels, lambda df: rates.tumbling_counts(df, "labeled_at", "1 day"), "")
    return counts.select(ms("window_start"), "n")



@streams.add("st10_log_tags", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'matching-loop' WHEN 1 THEN 'scheduler' END AS subsystem
FROM events""")
def _(spark, sf):
    line = F.concat(F.col("ts").cast("string"), F.lit(" ["), F.when(
        F.col("event_id") % 3 == 0, "matching-loop").when(F.col("event_id") % 3 == 1, "scheduler")
        .otherwise("main"), F.lit("] "), "event_type")
    lines = source(spark, sf, "events").select("event_id", line.alias("value"))
    return drain(rates.tag_log_lines(lines)).select("event_id", "subsystem")


@streams.add("st11_freshness", ctes("jobs") + """
, w AS (SELECT time_bucket(INTERVAL 1 DAY, first_seen_at, TIMESTAMP '1970-01-01') AS s,
   epoch_ms(first_seen_at) - epoch_ms(ats_posted_at) AS lag FROM jobs WHERE ats_posted_at IS NOT NULL)
SELECT epoch_ms(s) AS window_start_ms, count(*) AS n, quantile_disc(lag, 0.5) AS p50_ms,
  quantile_disc(lag, 0.95) AS p95_ms FROM w GROUP BY s""")
def _(spark, sf):
    counts = counted(streamed(spark, sf, "jobs", "orders"), rates.lag_counts, ", lag_ms bigint")
    return rates.freshness(counts).select(ms("window_start"), "n", "p50_ms", "p95_ms")
