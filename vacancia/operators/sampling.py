"""Reproducible sampling: rank by a seeded hash of a key."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia import rules
from vacancia.operators.ordered import first_k_per_key, running_totals


def hash_rank(seed: int, *keys: str) -> Column:
    """Order-free random key that any engine can compute: the MD5 of seed and keys as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def uniform_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows; a top-n, so each task keeps at most ``n``."""
    return df.orderBy(hash_rank(seed, *keys), *keys).limit(n)


def _reached_model() -> Column:
    return (F.col("latency_ms") > 0) & (F.size("hard_failures") == 0)


def stratified_sample(results: DataFrame, n: int, seed: int, *keys: str,
                      labeled: DataFrame | None = None, filter_first: bool = True) -> DataFrame:
    """Push, digest and low results that reached the scorer: n/3, n/3 and the rest.

    Already labelled keys are removed before sampling; ``filter_first=False``
    removes them afterwards, which may return fewer than ``n``.
    """
    stratum = (F.when(F.col("score") >= rules.TIER_PUSH, "push")
               .when(F.col("score") >= rules.TIER_DIGEST, "digest").otherwise("low"))
    pool = results.filter(_reached_model()).withColumn("stratum", stratum)
    if labeled is not None and filter_first:
        pool = pool.join(labeled.select(*keys).distinct(), list(keys), "left_anti")
    third = n // 3
    quota = (F.when(F.col("stratum") == "low", n - 2 * third).otherwise(third))
    picked = first_k_per_key(pool, ["stratum"], [hash_rank(seed, *keys), *map(F.col, keys)],
                             n - 2 * third).filter(F.col("rn") <= quota).drop("rn")
    if labeled is not None and not filter_first:
        picked = picked.join(labeled.select(*keys).distinct(), list(keys), "left_anti")
    return picked


def allocate_quota(counts: DataFrame, n: int, minimum: int = 5) -> DataFrame:
    """Share ``n`` over strata by size, at least ``minimum``, capped by size and remainder.

    ``counts`` has (ats_type, ord, size): a few rows, so the running remainder is
    an ordered fold over them.
    """
    total = counts.agg(F.sum("size").alias("t")).scalar()
    listed = counts.withColumn("total", total).agg(F.array_sort(F.collect_list(
        F.struct("ord", "ats_type", "size", "total"))).alias("xs"))

    def step(acc: Column, x: Column) -> Column:
        want = F.greatest(F.lit(minimum), F.round(x["size"] * n / x["total"])).cast("bigint")
        got = F.least(want, x["size"], acc["left"])
        row = F.struct(x["ats_type"].alias("ats_type"), got.alias("quota"))
        return F.struct((acc["left"] - got).alias("left"),
                        F.concat(acc["rows"], F.array(row)).alias("rows"))

    zero = F.struct(F.lit(n).cast("bigint").alias("left"),
                    F.array().cast("array<struct<ats_type:string,quota:bigint>>").alias("rows"))
    return listed.select(F.inline(F.aggregate("xs", zero, step)["rows"]))


def proportional_sample(companies: DataFrame, n: int, seed: int,
                        vendors: tuple[str, ...] = ("greenhouse", "lever", "ashby"),
                        minimum: int = 5) -> DataFrame:
    """Companies allocated to vendors by size, then drawn by hash rank."""
    order = F.create_map(*[x for i, v in enumerate(vendors) for x in (F.lit(v), F.lit(i))])
    pool = companies.filter(F.col("ats_type").isin(*vendors))
    counts = pool.groupBy("ats_type").agg(F.count(F.lit(1)).alias("size")) \
        .withColumn("ord", F.element_at(order, F.col("ats_type")))
    quota = allocate_quota(counts, n, minimum)
    cut = first_k_per_key(pool, ["ats_type"], [hash_rank(seed, "company_id"), F.col("company_id")], n)
    return cut.join(quota, "ats_type").filter(F.col("rn") <= F.col("quota")).drop("rn", "quota")


def select_poll_batch(companies: DataFrame, jobs: DataFrame, n: int, seed: int) -> DataFrame:
    """Active companies without jobs first, filled up with others."""
    have = jobs.select("company_id").distinct().withColumn("polled", F.lit(1))
    ranked = companies.filter("active").join(have, "company_id", "left") \
        .withColumn("polled", F.coalesce("polled", F.lit(0)))
    return ranked.orderBy("polled", hash_rank(seed, "company_id"), "company_id").limit(n)


def stability_sample(results: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Results worth re-scoring: at least digest and not rejected."""
    pool = results.filter((F.col("score") >= rules.TIER_DIGEST) & (F.size("hard_failures") == 0))
    return uniform_sample(pool, n, seed, *keys)


def stratum_rank(df: DataFrame, stratum: str, seed: int, *keys: str) -> DataFrame:
    """Random position of every row within its stratum, however large the stratum."""
    keyed = df.withColumn("__h", hash_rank(seed, *keys))
    return running_totals(keyed, [stratum], ["__h", *keys], {"rn": F.lit(1)}).drop("__h")
