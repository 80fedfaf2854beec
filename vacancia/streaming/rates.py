"""Windowed metrics of streams: rates, counts, latency targets, log tags.

Histories arrive in any order, so nothing here waits for a watermark and drops
what comes after it. A stream appends small partial counts per micro-batch to a
log that merges and folds old batches, and a reader folds what is left; a row counts whenever it
arrives, and a retried batch replaces its counts.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacancia.operators.ordered import order_statistics, running_totals
from vacancia.streaming.tables import read_all, write_batch


def _windowed(rows: DataFrame, w, *keys: str) -> DataFrame:
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def poll_counts(polls: DataFrame, window: str = "5 minutes", slide: str = "15 seconds") -> DataFrame:
    """Polls by result over a sliding window."""
    result = F.when(F.col("status") == "success", "success").otherwise("fail")
    return _windowed(polls.withColumn("result", result), F.window("attempted_at", window, slide), "result")


def poll_rates(counts: DataFrame, seconds: int = 300) -> DataFrame:
    """Folded poll counts as polls per second."""
    return counts.withColumn("rate", F.col("n") / seconds)


def tumbling_counts(events: DataFrame, time: str, window: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows per tumbling window and key (ingested jobs, matches found, labels)."""
    return _windowed(events, F.window(time, window), *keys)


def cumulative(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Folded counts with ``total``, the running count per key."""
    return running_totals(counts, list(keys), ["window_start"], {"total": F.col("n")})


def lag_counts(jobs: DataFrame, window: str = "1 day") -> DataFrame:
    """Postings by window and posting-to-surface lag."""
    lag = F.unix_millis("first_seen_at") - F.unix_millis("ats_posted_at")
    rows = jobs.filter("ats_posted_at is not null").withColumn("lag_ms", lag)
    return _windowed(rows, F.window("first_seen_at", window), "lag_ms")


def freshness(counts: DataFrame) -> DataFrame:
    """Folded lag counts as exact median and p95 (nearest rank) per window."""
    return order_statistics(counts, ["window_start", "window_end"], "lag_ms",
                            {"p50_ms": ("nearest", 0.5), "p95_ms": ("nearest", 0.95)}, weight="n")


def counting_stream(rows: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                    available_now: bool = False, interval: str = "1 minute") -> StreamingQuery:
    """Write ``partial`` (counts in column n) of every micro-batch under ``path``."""
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (rows.writeStream.foreachBatch(lambda df, batch: write_batch(partial(df), path, batch, _summed))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*[c for c in parts.columns if c != "n"]).agg(F.sum("n").alias("n"))


def folded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The counts of all micro-batches, summed over equal keys; old ones are summed already."""
    return _summed(read_all(spark, path, f"{schema}, n bigint"))


def tag_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add the ``subsystem`` a log line names first, null when none."""
    tag = F.regexp_extract(column, r"(matching-loop|scheduler)", 1)
    return lines.withColumn("subsystem", F.nullif(tag, F.lit("")))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Streaming text source."""
    return spark.readStream.text(path)


POSTING = ["company_id", "external_id", "body_hash"]


def _earliest(rows: DataFrame, time: str) -> DataFrame:
    first = Window.partitionBy(*POSTING).orderBy(F.col(time).asc_nulls_last())
    return rows.withColumn("__turn", F.row_number().over(first)).filter("__turn = 1").drop("__turn")


def once_per_posting_stream(postings: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                            interval: str = "1 minute", time: str = "fetched_at") -> StreamingQuery:
    """Append the earliest row of every posting content of a micro-batch under ``path``."""
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    hashed = postings.withColumn("body_hash", F.xxhash64("raw_json"))
    return (hashed.writeStream.foreachBatch(
        lambda df, batch: write_batch(_earliest(df, time), path, batch, lambda rows: _earliest(rows, time)))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def once_per_posting(spark: SparkSession, path: str, schema: str, time: str = "fetched_at") -> DataFrame:
    """One row per posting content over all micro-batches: the earliest.

    However late or often a repeat arrives, nothing is lost and nothing is kept twice.
    """
    return _earliest(read_all(spark, path, f"{schema}, body_hash bigint"), time).drop("body_hash")
