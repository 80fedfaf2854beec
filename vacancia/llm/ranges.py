"""Contiguous id ranges from quantiles, for orders that no single task may hold."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges at most: their bounds are literals of the plan.
MOST_RANGES = 4096


def id_bounds(df: DataFrame, key: str, ranges: int) -> list[int]:
    """Ascending upper bounds of about ``ranges`` ranges with like row counts.

    Every bound is a value that occurs and the last is the largest, so each
    range ends with its bound. Null keys belong to the first range. An empty
    table, or one without keys, has no bounds.
    """
    ranges = max(1, min(ranges, MOST_RANGES))
    cuts = [k / ranges for k in range(1, ranges)] or [1.0]
    row = df.agg(F.percentile_approx(key, cuts, max(10_000, 20 * ranges)).alias("q"), F.max(key).alias("top")).first()
    # Quantiles pass through doubles; the largest key of each stretch is exact.
    near = sorted({*(row["q"] or []), row["top"]} - {None})
    tops = df.filter(F.col(key).isNotNull()).groupBy(range_number(F.col(key), near).alias("n")).agg(F.max(key).alias("top"))
    return sorted(r["top"] for r in tops.collect())


def range_number(key: Column, bounds: list[int]) -> Column:
    """The range of ``key``: how many bounds are less. Null is in range 0.

    Searched in two levels, so that a row costs the square root of the bounds.
    """
    if len(bounds) < 2:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i: i + width] for i in range(0, len(bounds), width)]
    tops = F.array(*[F.lit(g[-1]).cast("long") for g in groups[:-1]]) if len(groups) > 1 else F.array().cast("array<bigint>")
    nested = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < key))
    group = below(tops)
    return F.when(key.isNull(), F.lit(0)).otherwise(group * width + below(F.get(nested, group)))
