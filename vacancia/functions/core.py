"""Helpers that keep an expensive expression from being evaluated twice.

The optimiser substitutes a projected expression into any filter placed on it,
and into every place that mentions it inside one expression. For cheap columns
that is a gain; for parsing a body or running a dozen regular expressions it
doubles the work.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_present(df: DataFrame, name: str, items: Column) -> DataFrame:
    """One row per element of ``items``; null and empty arrays give no row.

    The outer form is filtered afterwards on the generated column, which stays
    above the generator, so ``items`` is computed once per input row.
    """
    return df.select("*", F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def with_present(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` and keep the rows where it is not null, computing it once."""
    return explode_present(df, name, F.array(value))
