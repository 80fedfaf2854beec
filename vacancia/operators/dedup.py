"""First-wins, latest-wins and source merging.

The winner per key is a rank of one, whose limit Spark also applies below the
shuffle: a task ships one row a key, and no aggregate has to carry whole rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOARD_KEY = ["ats_type", "slug"]
READING_ORDER = ["doc", "line_no", "pos"]


def _winner(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__turn", turn).filter("__turn = 1").drop("__turn")


def dedup_first(df: DataFrame, keys: list[str] = BOARD_KEY,
                order: list[str] = READING_ORDER) -> DataFrame:
    """Keep the first row per key in an explicit order."""
    return _winner(df, keys, [F.col(c).asc() for c in order])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key in an explicit order."""
    return _winner(df, keys, [F.col(c).desc() for c in order])


def latest_labels(log: DataFrame, keys: list[str] = ["key"],
                  order: list[str] = ["labeled_at"]) -> DataFrame:
    """Current labels of a put/delete log; a null value deletes the key."""
    return latest(log, keys, order).filter("value is not null")


def latest_results(runs: DataFrame) -> DataFrame:
    """Current result per (company, title): last run, last position in it.

    ``added_at`` is the time of that run.
    """
    kept = runs.filter("nullif(company_slug, '') is not null and nullif(title, '') is not null")
    return latest(kept, ["company_slug", "title"], ["run_ts", "run_id", "pos"]) \
        .withColumn("added_at", F.col("run_ts"))


def seen_keys(runs: DataFrame) -> DataFrame:
    """Distinct (company_slug, title) of all runs."""
    return (runs.filter("nullif(company_slug, '') is not null and nullif(title, '') is not null")
            .select("company_slug", "title").distinct())


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """One stream of discoveries in source precedence order."""
    out = None
    for rank, df in enumerate(sources):
        tagged = df.withColumn("precedence", F.lit(rank))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """One row per company: the first source in precedence order wins."""
    return dedup_first(union_sources(sources), BOARD_KEY, ["precedence"] + READING_ORDER)


def new_per_source(sources: list[DataFrame]) -> DataFrame:
    """Companies found by each source and how many no earlier source had.

    The sources are read once: they collapse to (company, source), and a rank per company,
    over its distinct sources only, marks the first.
    """
    pairs = union_sources(sources).groupBy(*BOARD_KEY, "source_type").agg(
        F.min("precedence").alias("precedence"))
    turn = F.row_number().over(Window.partitionBy(*BOARD_KEY).orderBy("precedence", "source_type"))
    return pairs.withColumn("__turn", turn).groupBy("source_type").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("__turn") == 1).alias("new"))


def exclude_seen(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs whose (company_slug, title) no run has scored."""
    return jobs.join(seen_keys(runs), ["company_slug", "title"], "left_anti")


def first_job_per_title(jobs: DataFrame, id_col: str = "job_id") -> DataFrame:
    """Lookup of one job per (company_slug, title): the smallest id."""
    return dedup_first(jobs, ["company_slug", "title"], [id_col])


def has_key(keys: list[str]) -> Column:
    """Row filter: all key columns present."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out
