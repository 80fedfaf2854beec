"""MERGE-style operators as one shuffle each: union, then fold per key."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia import rules

JOB_KEY = ["company_id", "external_id"]


def company_id(ats: Column, slug: Column) -> Column:
    """Stable identity of a company from its natural key."""
    return F.xxhash64(ats, slug)


def discover_companies(existing: DataFrame | None, found: DataFrame) -> DataFrame:
    """Companies after a discovery run, with ``is_new``.

    ``found`` has (name, slug, ats_type, ats_url, seen_at, seq). The first name
    and discovery time are kept, the last URL wins, operational state of an
    existing row is carried over.
    """
    fresh = found.select(
        "ats_type", "slug", "name", "ats_url", F.col("seen_at").alias("discovered_at"),
        F.col("seq").cast("bigint").alias("seq"), F.lit(False).alias("old"),
        F.lit(None).cast("struct<active:boolean,next_poll_at:timestamp,poll_interval_ms:bigint,"
                         "consecutive_failures:bigint,disabled_at:timestamp>").alias("state"))
    rows = fresh
    if existing is not None:
        rows = fresh.unionByName(existing.select(
            "ats_type", "slug", "name", "ats_url", "discovered_at",
            F.lit(-1).cast("bigint").alias("seq"), F.lit(True).alias("old"),
            F.struct("active", "next_poll_at", "poll_interval_ms", "consecutive_failures",
                     "disabled_at").alias("state")))
    # An existing row sorts before every fresh one, whatever its clock says.
    order = F.struct(~F.col("old"), F.col("discovered_at"), F.col("seq"))
    merged = rows.groupBy("ats_type", "slug").agg(
        F.min_by("name", order).alias("name"), F.max_by("ats_url", order).alias("ats_url"),
        F.min_by("discovered_at", order).alias("discovered_at"),
        F.min_by("state", order).alias("state"), (~F.bool_or("old")).alias("is_new"))
    return merged.select(
        company_id(F.col("ats_type"), F.col("slug")).alias("company_id"),
        "name", "slug", "ats_type", "ats_url", "discovered_at",
        F.coalesce("state.active", F.lit(True)).alias("active"), F.col("state.next_poll_at"),
        F.coalesce("state.poll_interval_ms", F.lit(rules.POLL_INTERVAL_MS).cast("bigint"))
        .alias("poll_interval_ms"),
        F.coalesce("state.consecutive_failures", F.lit(0).cast("bigint"))
        .alias("consecutive_failures"),
        F.col("state.disabled_at"), "is_new")


def discover_sources(existing: DataFrame | None, found: DataFrame) -> DataFrame:
    """Company/source bridge: the first sighting per (company, source, detail) is kept."""
    fresh = found.select(
        company_id(F.col("ats_type"), F.col("slug")).alias("company_id"),
        "source_type", "source_detail", F.col("seen_at").alias("discovered_at"))
    rows = fresh if existing is None else existing.select(*fresh.columns).unionByName(fresh)
    return rows.groupBy("company_id", "source_type", "source_detail").agg(
        F.min("discovered_at").alias("discovered_at"))


def upsert_jobs(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Jobs after an ingest, with ``is_new``.

    Both sides share the job columns. The newest ``updated_at`` wins every
    column but ``first_seen_at``, whose earliest value is kept; an older fetch
    arriving late never overwrites a newer row.
    """
    columns = [c for c in incoming.columns if c != "seq"]
    seq = F.col("seq") if "seq" in incoming.columns else F.lit(0)
    rows = incoming.select(*columns, seq.cast("bigint").alias("__seq"), F.lit(False).alias("__old"))
    if existing is not None:
        rows = rows.unionByName(existing.select(
            *columns, F.lit(-1).cast("bigint").alias("__seq"), F.lit(True).alias("__old")))
    # The versions of one posting are few; they are ranked where the one shuffle has put them.
    key = Window.partitionBy(*JOB_KEY)
    newest = key.orderBy(F.col("updated_at").desc(), F.col("__old").asc(), F.col("__seq").desc())
    earliest = key.orderBy(F.col("__old").desc(), F.col("first_seen_at").asc())
    merged = rows.select(
        *[c for c in columns if c != "first_seen_at"], F.first("first_seen_at").over(earliest).alias("first_seen_at"),
        (~F.max("__old").over(key)).alias("is_new"), F.row_number().over(newest).alias("__turn"))
    return merged.filter("__turn = 1").select(
        *JOB_KEY, *[c for c in columns if c not in (*JOB_KEY, "first_seen_at")], "first_seen_at", "is_new")


def upsert_jobs_delta(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``upsert_jobs`` for a small increment over a large table.

    Rows whose key is not in the increment pass through untouched. When the
    increment's keys fit the broadcast limit (measured at run time) the large
    side is filtered in place and never shuffled; it is read twice instead.
    """
    keys = incoming.select(*JOB_KEY).distinct()
    columns = [c for c in incoming.columns if c != "seq"]
    kept = existing.select(*columns).join(keys, JOB_KEY, "left_anti").withColumn("is_new", F.lit(False))
    merged = upsert_jobs(existing.select(*columns).join(keys, JOB_KEY, "left_semi"), incoming)
    return merged.unionByName(kept)


def rows_added(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many rows a repeated run added (0 when idempotent)."""
    n = lambda df, sign: df.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") * sign).alias("n"))
    return n(after, 1).unionAll(n(before, -1)).agg(F.sum("n").alias("dedup_rate"))


def first_seen_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: first-seen times that changed between two snapshots."""
    changed = (
        before.select(*JOB_KEY, F.col("first_seen_at").alias("was"))
        .join(after.select(*JOB_KEY, "first_seen_at"), JOB_KEY)
    )
    return changed.agg(F.count_if(F.col("was") != F.col("first_seen_at")).alias("violations"))


def field_population(jobs: DataFrame, required: list[str], nullable: list[str]) -> DataFrame:
    """Share of rows with each field filled: ``required`` also rejects ''."""
    aggs = [F.avg(F.coalesce(F.col(f) != "", F.lit(False)).cast("int")).alias(f) for f in required]
    aggs += [F.avg(F.col(f).isNotNull().cast("int")).alias(f) for f in nullable]
    return jobs.agg(*aggs).unpivot([], required + nullable, "field", "ratio")
