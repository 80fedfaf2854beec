"""Threshold-scaled sketches of documents (FracMinHash).

A sketch keeps every five-word shingle hash below a fixed fraction of the hash
range, and the smallest hash whatever its value, so that no sketch is empty.
The fraction does not depend on the text: the sketch of a union of texts is the
union of their sketches (``merge_sketches``), and the containment of a short
document in a very long one is estimated as well as the resemblance of equals.

Built-in functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.functions.core import let
from vacancia.llm.ranges import id_bounds, range_number
from vacancia.llm.texts import whole, windows, words

WIDTH = 5
#: One hash of ``SCALE`` is kept.
SCALE = 8
#: Documents of one id range, about; the neighbour is looked up inside a range.
RANGE_ROWS = 1000


def _shingles(w: Column, width: int) -> Column:
    short = F.array(F.xxhash64(F.array_join(w, " ")))
    return F.when(F.size(w) < width, short).otherwise(windows(w, width, lambda x: F.xxhash64(*x)))


def _kept(hashes: Column, scale: int) -> Column:
    """The hashes below 1/scale of the unsigned range and the smallest, in order, each once."""
    half = F.lit((1 << 63) // scale)
    low = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 1) < half)
    least = F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(-(1 << 63)))))
    return F.sort_array(F.array_distinct(F.concat(low, F.array(least.bitwiseXOR(F.lit(-(1 << 63)))))))


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """``array<bigint>`` of the retained hashes. A text of fewer words is one shingle, a wordless one too."""
    return let(words(text), lambda w: let(_shingles(w, width), lambda h: _kept(h, scale)))


def merge_sketches(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two shingle sets."""
    return let(F.concat(a, b), lambda h: _kept(h, scale))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def fingerprint_string(s: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash, in order."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scale: int = SCALE) -> DataFrame:
    """``doc_id, t, s, next_t, next_s``: each text and sketch and those of the next document.

    Next is by descending id (nulls last, equal ids by text); after the last
    comes the first. Documents are dealt by id range, and the largest id of a
    range is also sent to the range above, whose last row it follows, so the
    order is found without bringing all rows to one task.
    """
    ids = docs.select(docs[doc_id].alias("doc_id"))
    bounds = id_bounds(ids, "doc_id", ids.count() // RANGE_ROWS)
    top = bounds[-1] if bounds else None
    rows = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("t"))
    rows = rows.select("*", sketch(F.col("t"), scale=scale).alias("s"))
    at = range_number(F.col("doc_id"), bounds)

    def place(number: Column, ghost: bool, wrapped: bool) -> Column:
        return F.struct(number.cast("int").alias("number"), F.lit(ghost).alias("ghost"), F.lit(wrapped).alias("wrapped"))
    first = F.col("doc_id").eqNullSafe(F.lit(top))
    bound = F.col("doc_id").isin(bounds[:-1]) if len(bounds) > 1 else F.lit(False)
    places = let(at, lambda n: F.array(
        place(n, False, False), F.when(bound, place(n + 1, True, False)), F.when(first, place(F.lit(0), True, True))))
    dealt = rows.select("*", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p"))
    order = Window.partitionBy("p.number").orderBy(
        F.col("p.wrapped"), F.col("doc_id").desc_nulls_last(), F.col("t"))
    led = dealt.select("*", F.lead(F.struct("t", "s")).over(order).alias("next"))
    return led.filter(~F.col("p.ghost")).select(
        "doc_id", "t", "s", F.col("next.t").alias("next_t"), F.col("next.s").alias("next_s"))


def fingerprint_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scale: int = SCALE) -> DataFrame:
    """Per document its fingerprint and that of its edited text, with their likeness.

    The edited text has its last half (rounded down) replaced by as many first
    characters of the next document, or all of it. Null texts are empty; a
    single document is its own next; repeated rows are repeated; an empty table
    gives an empty result.
    """
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - half), F.substring("next_t", F.lit(1), half))
    rows = with_next(docs, text, doc_id, scale).select("doc_id", "s", "next_s", n.cast("long").alias("n_chars"), edited.alias("e"))
    rows = rows.select("*", sketch(F.col("e"), scale=scale).alias("es"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_string(F.col("s")).alias("fingerprint"), fingerprint_string(F.col("es")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("es")).alias("near_edited"),
        resemblance(F.col("s"), F.col("next_s")).alias("near_next"),
        containment(F.col("s"), F.col("es")).alias("contained_in_edited"))
