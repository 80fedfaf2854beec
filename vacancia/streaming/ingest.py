"""Continuous ingest: landed payloads to a posting log and a poll log."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacancia.operators.upsert import upsert_jobs
from vacancia.sources.boards import parse_payloads, parsed_outcomes, parsed_postings
from vacancia.streaming.tables import read_all, write_batch

LOG = ("company_id bigint, external_id string, title string, url string, location string, "
       "department string, ats_posted_at timestamp, first_seen_at timestamp, "
       "updated_at timestamp, raw_json string")
OUTCOME = ("company_id bigint, ats_type string, attempted_at timestamp, status string, "
           "status_code int, latency_ms bigint, jobs_found bigint, error_message string")


def _newest(rows: DataFrame) -> DataFrame:
    return upsert_jobs(None, rows).drop("is_new")


def ingest_batch(payloads: DataFrame, target: str, batch_id: int) -> None:
    """One micro-batch: successful responses to the posting log, all to the poll log.

    Bodies are parsed once; both logs are written from what that gives. A batch writes only its own rows; the
    current table is the fold of the log.
    """
    parsed = parse_payloads(payloads).persist()
    try:
        good = parsed.filter("not aborted and status_code between 200 and 299")
        jobs = parsed_postings(good).select(
            "company_id", "external_id", "title", "url", "location", "department",
            F.col("posted_at").alias("ats_posted_at"), F.col("fetched_at").alias("first_seen_at"),
            F.col("fetched_at").alias("updated_at"), "raw_json")
        write_batch(_newest(jobs), f"{target}/jobs", batch_id, _newest)
        write_batch(parsed_outcomes(parsed), f"{target}/polls", batch_id)
    finally:
        parsed.unpersist()


def ingest_stream(payloads: DataFrame, target: str, checkpoint: str,
                  available_now: bool = False) -> StreamingQuery:
    """Start the ingest of a streaming payload source."""
    writer = payloads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: ingest_batch(df, target, batch_id))
    trigger = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    return writer.trigger(**trigger).start()


def current_jobs(spark: SparkSession, target: str) -> DataFrame:
    """One row per posting: newest content, earliest sighting."""
    return _newest(read_all(spark, f"{target}/jobs", LOG))


def poll_log(spark: SparkSession, target: str) -> DataFrame:
    return read_all(spark, f"{target}/polls", OUTCOME)
