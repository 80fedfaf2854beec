"""Exact running totals, ranks and order statistics without a one-task window.

A window over one key sorts that key's rows in a single task. Here the rows are
range-partitioned on (keys, order), so a hot key spans many partitions; each
partition contributes one small total per key, the totals are prefix-summed,
and the offset is added back inside each partition.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.session import reliable

CHUNK = "__chunk"


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` range-partitioned on keys and order, with its partition number.

    Checkpointed: both the totals and the rows must see one partitioning.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc() for c in keys + order])
    return reliable(ranged.withColumn(CHUNK, F.spark_partition_id()))


def running_totals(df: DataFrame, keys: list[str], order: list[str],
                   measures: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums of ``measures`` per key, in ``order``.

    ``order`` must make rows unique within a key. Per (key, partition) totals are
    at most one row per key plus one per partition a hot key spans.
    """
    chunked = ordered_chunks(
        df.select("*", *[m.cast("double" if _is_real(df, m) else "bigint").alias(f"__m_{n}")
                         for n, m in measures.items()]), keys, order)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        chunked.groupBy(*keys, CHUNK)
        .agg(*[F.sum(f"__m_{n}").alias(f"__t_{n}") for n in measures])
        .select(*keys, CHUNK, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0))
                                .alias(f"__o_{n}") for n in measures])
    )
    match = reduce(lambda a, b: a & b,
                   [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys + [CHUNK]])
    joined = chunked.alias("l").join(totals.alias("r"), match).select(
        "l.*", *[f"r.__o_{n}" for n in measures])
    inside = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    return joined.select(
        *df.columns,
        *[(F.sum(f"__m_{n}").over(inside) + F.col(f"__o_{n}")).alias(n) for n in measures])


def _is_real(df: DataFrame, measure: Column) -> bool:
    return df.select(measure.alias("m")).dtypes[0][1] in ("double", "float")


def global_rank(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """1-based position in a total order over all rows."""
    return running_totals(df, [], order, {name: F.lit(1)})


def order_statistics(df: DataFrame, keys: list[str], value: str,
                     picks: dict[str, tuple[str, float]], weight: str | None = None) -> DataFrame:
    """Exact percentiles per key under a named index rule.

    ``picks`` maps an output name to ``(rule, p)``: rule ``floor`` takes the
    0-based index floor(n*p), rule ``nearest`` takes max(0, ceil(n*p) - 1).
    Equal values are counted map-side first, so what is ordered is the number
    of distinct values, not of rows. ``weight`` names a column of row counts.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    ranked = running_totals(counts, keys, [value], {"__cum": F.col("__n")})
    sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("__size"))
    if keys:
        same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
        with_size = ranked.alias("a").join(sizes.alias("b"), same).select("a.*", "b.__size")
    else:
        with_size = ranked.withColumn("__size", sizes.select("__size").scalar())
    size = F.col("__size")
    aggs = []
    for name, (rule, p) in picks.items():
        need = (F.floor(size * F.lit(p)) + 1 if rule == "floor"
                else F.greatest(F.lit(1), F.ceil(size * F.lit(p))))
        aggs.append(F.min(F.when(F.col("__cum") >= need, F.col(value))).alias(name))
    return with_size.groupBy(*keys).agg(F.max("__size").alias("n"), *aggs)


def first_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                    rank: str = "rn") -> DataFrame:
    """The first ``k`` rows per key.

    The rows of a key are first cut within groups of tasks, as many as the
    session has shuffle partitions, so a hot key is ranked by all of them and
    the last step gets at most ``k`` rows of it from each. Where the session's
    window group limit allows it, the filter is also pushed below the shuffle.
    """
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = Window.partitionBy(*keys, "__group").orderBy(*order)
    cut = (
        df.withColumn("__group", F.pmod(F.spark_partition_id(), F.lit(groups)))
        .withColumn("__first", F.row_number().over(group)).filter(F.col("__first") <= k)
        .drop("__group", "__first")
    )
    w = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
