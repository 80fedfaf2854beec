"""Readers and writers for the landing zone, run outputs and label logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia import schemas


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landing table of response bodies."""
    return spark.read.schema(schemas.PAYLOAD).parquet(path)


def read_payload_files(spark: SparkSession, root: str) -> DataFrame:
    """One response per file under ``root/<ats_type>/<slug>.<ext>``."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True)
        .select(F.col("value").alias("body"),
                F.element_at(parts, -2).alias("ats_type"),
                F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("slug"),
                F.col("_metadata.file_modification_time").alias("fetched_at"))
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a total order: file, then ``line_no``.

    ``line_no`` is the split's byte offset plus the row within the task. A line
    has at least one byte, and a task that reads several splits reads the ends
    of files only, so the numbers of a file rise over its splits and never meet.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("doc"),
        (F.col("_metadata.file_block_start") + row).alias("line_no"), F.col("value").alias("line"))


def append_history(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines history."""
    df.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """History rows; lines that do not parse are dropped."""
    full = f"{schema}, _bad string"
    return (
        spark.read.schema(full).option("columnNameOfCorruptRecord", "_bad").json(path)
        .filter("_bad is null").drop("_bad")
    )


def write_run(results: DataFrame, path: str, run_id: str) -> None:
    """Write one run; repeating a run replaces that run only."""
    results.drop("run_id").write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs; rows without a company or a title are skipped."""
    return (
        spark.read.schema(schemas.RESULT).option("basePath", path).parquet(path)
        .filter("nullif(company_slug, '') is not null and nullif(title, '') is not null")
    )


def put_label(labels: DataFrame, path: str) -> None:
    """Append label events; a null value is a deletion."""
    labels.write.mode("append").parquet(path)


def read_llm_labels(spark: SparkSession, path: str, labeler_id: str | None = None) -> DataFrame:
    df = read_history(spark, path, schemas.LLM_LABEL)
    return df if labeler_id is None else df.filter(F.col("labeler_id") == labeler_id)


def write_discovery_dump(companies: DataFrame, path: str) -> None:
    """One JSON row per unique company."""
    companies.select(F.col("ats_url").alias("url"), "slug", "ats_type",
                     F.col("source_detail").alias("source")).write.mode("overwrite").json(path)


def write_exposition(lines: DataFrame, path: str) -> None:
    """Write metric lines as text, in exposition order (a few hundred rows)."""
    lines.orderBy("seq").select("line").coalesce(1).write.mode("overwrite").text(path)
