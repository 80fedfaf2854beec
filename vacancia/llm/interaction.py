"""How five quality filters overlap: steps of every order and Shapley values.

A document is reduced to the set of filters that it fails, a mask of five bits,
and the masks are counted per part. For a coalition S of filters, v(S) is the
number of documents that S removes. All figures follow from the 32 values of v:

* the step of filter i after the filters S removes v(S + i) - v(S);
* the Hart-Mas-Colell potential of the game is P({}) = 0 and
  P(S) = (v(S) + sum of P(S - i) over i in S) / |S|; the Shapley value of i is
  P(all) - P(all - i). With Q(S) = |S|! P(S) the recursion keeps to integers:
  Q(S) = (|S| - 1)! v(S) + sum of Q(S - i), and the sum of i's removals over all
  120 orders is Q(all) - 5 Q(all - i).

Texts are read once, in the tasks that scan them. What is shuffled is a row of
fixed size per document, to find equal texts and labels; after that, one row per
part and mask.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.texts import map_texts
from vacancia.session import reliable

FILTERS = "ABCDE"
#: Words that a document needs (A) and the share in per cent of distinct ones (B).
LEAST_WORDS, LEAST_DISTINCT = 200, 50
#: Per cent of characters that may be ASCII capitals (C), and the characters of D.
MOST_CAPITALS, SYMBOLS = 2, b"#$%&*|"
COALITIONS = 1 << len(FILTERS)
ALL = COALITIONS - 1
REPEATED = 1 << FILTERS.index("E")


def failures(text: str) -> int:
    """The filters A to D that a text fails, as bits from the lowest."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()                       # bytes split at ASCII blanks only
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(data) - len(data.translate(None, SYMBOLS))
    failed = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words),
              100 * capitals > MOST_CAPITALS * len(text), marks > 0)
    return sum(1 << i for i, f in enumerate(failed) if f)


def _read() -> Callable[[list[str | None]], list[tuple[bytes, int]]]:
    from hashlib import sha256

    def each(texts: list[str | None]) -> list[tuple[bytes, int]]:
        return [(sha256((t or "").encode("utf-8", "surrogatepass")).digest(), failures(t or "")) for t in texts]
    return each


def failure_masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """``doc_id, part, mask`` per row of ``docs``: the filters that it fails, E included.

    Equal texts are found by their sha256. The smallest id of each digest is an
    aggregate that is folded map-side. Rows are then matched with the first of their
    text on digest and id: what has no match is a copy, and the copies of a popular
    text are dealt out by their ids instead of being gathered in a task.
    """
    narrow = docs.select(docs[doc_id].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
                         docs[text].cast("string").alias("text"))
    keyed = reliable(map_texts(narrow, "text", _read, {"digest": "binary", "own": "bigint"}))
    first = keyed.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    again = F.col("id").isNotNull() & F.col("first").isNull()
    return keyed.join(first, ["digest", "id"], "left").select(
        F.col("id").alias("doc_id"), "part",
        (F.col("own") + F.when(again, REPEATED).otherwise(0)).cast("int").alias("mask"))


def _coalition_counts(counted: DataFrame, measures: list[str]) -> DataFrame:
    """``part`` and, per measure, the array of what each coalition removes; ``all`` documents."""
    cells = counted.groupBy("part").agg(
        F.collect_list(F.struct("mask", *measures)).alias("cells"), F.sum("n").alias("all"))

    def removed(measure: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda s: F.aggregate(
            "cells", F.lit(0).cast("long"),
            lambda total, c: total + F.when(c["mask"].bitwiseAND(s) != 0, c[measure]).otherwise(0)))
    return cells.select("part", "all", *[removed(m).alias(m) for m in measures])


def scaled_potentials(v: Column) -> Column:
    """Q(S) = |S|! P(S) for all coalitions S, in the order of their masks, from the array ``v``."""
    factorial = F.array(*[F.lit(math.factorial(max(k - 1, 0))).cast("long") for k in range(len(FILTERS) + 1)])

    def grown(q: Column, s: Column) -> Column:
        def without(i: int) -> Column:
            bit = F.lit(1 << i)
            return F.when(s.bitwiseAND(bit) != 0, F.get(q, s - bit)).otherwise(0)
        own = F.get(factorial, F.bit_count(s)) * F.get(v, s)
        return F.concat(q, F.array(sum((without(i) for i in range(len(FILTERS))), own)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), grown)


def interaction_report(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                       part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``; counts are long and those of the part. Null texts are
    empty; null parts are the empty string. A row without id is never a repeated
    text, makes no other one repeated and has no label; rows with one id and equal
    texts don't make each other repeated, and each counts. A document has a
    label if any of its label rows says so. An empty table gives no rows.
    """
    masks = failure_masks(docs, text, doc_id, part)
    said = labels.select(F.col("doc_id").alias("doc_id"), (F.col("quality") == 1).alias("good"),
                         (F.col("toxic") == 1).alias("toxic"))
    said = said.groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"),
                                      F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    joined = masks.join(said, "doc_id", "left")
    counted = joined.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"),
        F.count(F.when(F.col("toxic"), 1)).alias("toxic"))
    games = _coalition_counts(counted, ["n", "good", "toxic"])
    games = games.select("*", scaled_potentials(F.col("n")).alias("q"))

    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = games.select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    earlier = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    bit = sum((F.when(letter == x, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    before = sum((F.when(F.contains(earlier, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.select("*", bit.alias("bit"), before.alias("before"))

    def at(name: str, coalition: Column) -> Column:
        return F.get(F.col(name), coalition)
    after, rest = F.col("before") + F.col("bit"), F.lit(ALL) - F.col("bit")
    removed = at("n", after) - at("n", F.col("before"))
    return steps.select(
        "part", "filter_order", "step",
        (F.col("all") - at("n", after)).alias("kept"),
        removed.alias("removed"),
        (at("n", F.col("bit")) - removed).alias("redundant"),
        (at("n", F.lit(ALL)) - at("n", rest)).alias("unique_fails"),
        (at("good", after) - at("good", F.col("before"))).alias("good_lost"),
        (at("toxic", after) - at("toxic", F.col("before"))).alias("toxic_lost"),
        (at("q", F.lit(ALL)) - len(FILTERS) * at("q", rest)).alias("shapley"))
