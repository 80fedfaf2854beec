"""Session settings the operators rely on, and the shared checkpoint folder."""
from __future__ import annotations

import tempfile

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession

import vacancia

# Runtime settings only: cluster sizing (executors, memory, shuffle partitions)
# belongs to the job that owns the session.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Per-key limits up to this rank are applied before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator assumes (UTC, AQE, skew joins).

    The package's few Python functions travel by value, so executors need no
    installed copy of it.
    """
    register_pickle_by_value(vacancia)
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    A local folder is created only when the setting is absent and the session
    runs in local mode (tests); on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="vacancia-")


def reliable(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder so that two readers see the same rows.

    Used where one intermediate feeds two branches that must agree on its
    physical row placement, which recomputation after a lost executor would
    not guarantee.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """``reliable``, without the planner's estimate of the size.

    A checkpoint keeps the estimate of the plan that made it, and a join's is the
    product of its sides'. Where each checkpoint of a loop joins what the last one gave,
    the estimate is raised to a power at every turn, up to numbers of millions of
    digits that the driver multiplies and keeps. Here every turn starts from Spark's
    estimate for an unknown table; the sizes measured as the plan runs choose the joins.
    """
    spark, kept = df.sparkSession, reliable(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.toJavaRDD(), kept.schema()), spark)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a table that has fewer splits than the session has cores.

    A small single-row-group file would run a text-heavy plan on one core. A
    large table has more splits than cores and is returned as it is, so no
    shuffle is added at scale. ``scan`` must be a plain file scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
