"""Column expressions over scores, labels and ranking formulas."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia import rules


def band(score: Column) -> Column:
    """Qualifier band (push from 65)."""
    return (F.when(score >= rules.BAND_PUSH, "push")
            .when(score >= rules.BAND_DIGEST, "digest").otherwise("skip"))


def tier(score: Column) -> Column:
    """Review tier (push from 70), used by everything after the qualifier."""
    return (F.when(score >= rules.TIER_PUSH, "push")
            .when(score >= rules.TIER_DIGEST, "digest").otherwise("skip"))


def relevance_grade(score: Column, rejected: Column) -> Column:
    """Graded relevance 0..3 for ranking metrics."""
    return (F.when(rejected, 0).when(score >= rules.BAND_PUSH, 3)
            .when(score >= rules.BAND_DIGEST, 2)
            .when(score >= rules.GRADE_MARGINAL, 1).otherwise(0))


def label_verdict(value: Column) -> Column:
    """User label as a verdict; an ambiguous label has none."""
    return (F.when(value.isin("applied", "interested"), "fit")
            .when(value == "false_positive", "unfit"))


def is_good(value: Column) -> Column:
    return value.isin("applied", "interested")


def dcg_gain(grade: Column, rank: Column) -> Column:
    """Gain of a 1-based rank."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + F.lit(1.0))


def idf(n_docs: Column, doc_freq: Column) -> Column:
    return F.log((n_docs - doc_freq + 0.5) / (doc_freq + 0.5) + 1)


def saturated_tf(tf: Column, length: Column, avg_length: Column,
                 k1: float = rules.BM25_K1, b: float = rules.BM25_B) -> Column:
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / avg_length))


def normalise_verdict(verdict: Column) -> Column:
    """Unknown verdicts count as borderline."""
    v = F.lower(verdict)
    return F.when(v.isin("fit", "unfit"), v).otherwise("borderline")


def escape_label(value: Column) -> Column:
    """Escape a label value for the text exposition format."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
