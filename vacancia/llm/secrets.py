"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

The fixed kinds (assignments, access keys, hex runs) are always reported. The
battery looks at every run of 20 or more characters of the usual encodings. It
infers the encoding (hex, base32, base64), maps the characters to numbers and
asks, each as a test of uniform randomness: chi-squared uniformity over the
alphabet, the number of runs above and below the middle, and the lag-one serial
correlation. A run that fails one of them after Bonferroni correction is no
secret. Parts of a run between its joining signs, and hex in dashed groups without the
dashes, are candidates of their own.

Passing is weak evidence for a short run, so discoveries are controlled against
the other side: how likely would ordinary words, constants or numbers make this
run? The likelihood ratio of the random model over a mixture of three ordinary
models is an e-value, which grows with the length of the run. The e-BH rule
(Wang and Ramdas, 2022) over all candidates of all documents keeps the expected
share of false discoveries below ``FDR`` whatever their dependence. Its
threshold comes from a histogram of whole bits of evidence over the whole table.

Built-in functions only. Defined results: a null text is an empty one and has
no span; null ids, repeated rows and further columns are carried along; an
empty table gives an empty result.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.core import let
from vacancia.llm.texts import own_columns, whole

#: The kinds in listed order, their patterns, the group that is measured and its least length.
KINDS = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
               r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
RANDOM = "random"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Parts of such runs between their joining signs (a key in a path, behind words), and runs that may be hex in dashed groups.
PART = r"(?<=[/_=-])[A-Za-z0-9+]{20,}+|(?<![A-Za-z0-9+])[A-Za-z0-9+]{20,}+(?=[/_-])"
DASHED = r"[A-Za-z0-9-]{20,}"
LEAST_DIGITS = 20
HEX, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Size of the combined randomness test, and the false-discovery rate.
ALPHA, FDR = 0.001, 0.01
#: Ordinary runs: shares of the leading letter case, the other case, digits and signs.
LEADING, OTHER, DIGITS, SIGNS = 0.84, 0.06, 0.06, 0.04
MOST_BITS, CHUNK = 1024, 256
MASK = "[SECRET]"


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def _starts(gaps: Column, lengths: Column) -> Column:
    """Where each match starts, from the lengths of the texts before and of the matches.

    Prefix sums in two levels, so that a text with very many matches stays far
    from quadratic work.
    """
    def placed(steps: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / CHUNK).cast("int")),
                             lambda b: _sum(F.slice(steps, b * CHUNK + 1, F.lit(CHUNK))))
        return let(chunks, lambda c: F.transform(lengths, lambda n, i: (
            _sum(F.slice(c, F.lit(1), F.floor(i / CHUNK).cast("int")))
            + _sum(F.slice(steps, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK)) + F.get(gaps, i))))
    return let(F.transform(lengths, lambda n, i: n + F.get(gaps, i)), placed)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start, end, part>>``: the leftmost non-overlapping matches, in code points.

    ``part`` is what ``group`` matched. Texts without a match stop after one search.
    """
    def found(whole_matches: Column) -> Column:
        lengths = F.transform(whole_matches, F.length)
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        parts = whole_matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return let(gaps, lambda g: let(lengths, lambda n: let(parts, lambda p: F.transform(
            _starts(g, n), lambda s, i: F.struct(s.alias("start"), (s + F.get(n, i)).alias("end"),
                                                 F.get(p, i).alias("part"))))))
    none = F.array().cast("array<struct<start:int,end:int,part:string>>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(none)


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"], F.lit(kind).alias("kind"), x["end"]))


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, end>>`` of the fixed kinds, by start, then kind as listed."""
    every = []
    for rank, (_, pattern, group, least) in enumerate(KINDS):
        # A run of one character class is maximal, so asking for its least length gives the same runs.
        fast = pattern[:-1] + "{%d,}" % least if rank == 2 else pattern
        kept = F.filter(matches(text, fast, group), lambda x: F.length(x["part"]) >= least)
        every.append(_of_kind(kept, rank))
    return F.sort_array(F.concat(*every))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution by a logistic approximation (Page, 1977)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _battery(values: Column, k: Column, n: Column) -> Column:
    """Smallest of three p-values of uniform randomness, times three."""
    counts = F.transform(F.sequence(F.lit(0), k - 1), lambda v: F.size(F.filter(values, lambda x: x == v)))
    chi2 = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * k / n - n
    uneven = _tail((chi2 - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
    changes = F.size(F.filter(values, lambda x, i: (i > 0) & ((x * 2 >= k) != (F.get(values, i - 1) * 2 >= k))))
    runs = 2 * _tail(F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4))
    middle, spread = (k - 1) / 2, (k * k - 1) / 12
    products = F.transform(values, lambda x, i: F.when(
        i > 0, (x - middle) * (F.get(values, i - 1) - middle)).otherwise(F.lit(0.0)))
    serial = 2 * _tail(F.abs(F.aggregate(products, F.lit(0.0), lambda a, x: a + x)) / (spread * F.sqrt(n - 1)))
    return F.least(F.lit(1.0), 3 * F.least(uneven, runs, serial))


def _bits(body: Column, k: Column, n: Column) -> Column:
    """Whole bits of evidence for the random model over ordinary runs."""
    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace(body, pattern, ""))
    lower, upper, digits = kept("[^a-z]"), kept("[^A-Z]"), kept("[^0-9]")
    signs = n - lower - upper - digits
    shared = digits * math.log(DIGITS / 10) + signs * math.log(SIGNS / 5)
    first, second = math.log(LEADING / 26), math.log(OTHER / 26)
    random = -n * F.log(k)
    models = (lower * first + upper * second + shared - random, upper * first + lower * second + shared - random,
              F.when(digits == n, n * math.log(0.1)).otherwise(F.lit(-1e9)) - random)
    # Each model with weight 1/3, and the encoding was one choice of three.
    top = F.greatest(*models)
    mixed = top + F.log(sum(F.exp(m - top) for m in models) / 3)
    return F.least(F.lit(MOST_BITS), F.greatest(
        F.lit(-MOST_BITS), F.floor((-mixed - math.log(3)) / math.log(2)))).cast("int")


def _judged(found: Column, body: Column) -> Column:
    """``struct<start, end, bits, random>`` of a match, whose characters are read as ``body``."""
    def by_code(b: Column) -> Column:
        code = (F.when(b.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.struct(F.lit(HEX).alias("a"), F.lower(b).alias("b")))
                .when(b.rlike("^[A-Z2-7]+$"), F.struct(F.lit(BASE32).alias("a"), b.alias("b")))
                .otherwise(F.struct(F.lit(BASE64).alias("a"), F.replace(b, F.lit("="), F.lit("")).alias("b"))))
        return let(code, lambda c: let(F.transform(
            F.array_remove(F.split(c["b"], ""), ""), lambda ch: F.instr(c["a"], ch) - 1), lambda v: F.struct(
                found["start"], found["end"], _bits(b, F.length(c["a"]), F.length(b)).alias("bits"),
                (_battery(v, F.length(c["a"]), F.size(v)) > ALPHA).alias("random"))))
    return let(body, by_code)


def candidates(text: Column) -> tuple[Column, Column]:
    """Two ``array<struct<start, end, bits, random>>``: whole runs, and other readings of what they hold.

    The other readings are the parts of a run between its joining signs, and hex in dashed groups without
    the dashes. All of them are tested together.
    """
    # A run of padding alone has nothing to test.
    runs = F.filter(matches(text, CANDIDATE), lambda x: F.length(F.replace(x["part"], F.lit("="), F.lit(""))) >= 2)
    wholes = F.transform(runs, lambda x: _judged(x, F.rtrim(F.translate(x["part"], "-_", "+/"), F.lit("="))))
    parts = F.transform(matches(text, PART), lambda x: _judged(x, x["part"]))
    grouped = F.filter(matches(text, DASHED), lambda x: x["part"].rlike("^[0-9a-f]+-[0-9a-f-]*[0-9a-f]$|^[0-9A-F]+-[0-9A-F-]*[0-9A-F]$")
                       & (F.length(F.replace(x["part"], F.lit("-"), F.lit(""))) >= LEAST_DIGITS))
    dashed = F.transform(grouped, lambda x: _judged(x, F.replace(x["part"], F.lit("-"), F.lit(""))))
    return wholes, F.concat(parts, dashed)


def evidence_threshold(docs: DataFrame, text: str = "text", fdr: float = FDR) -> int:
    """The least bits of evidence that e-BH accepts over all candidates of ``docs``.

    The histogram has at most ``2 * MOST_BITS + 1`` rows, whatever the table.
    """
    found = docs.select(F.explode(F.concat(*candidates(whole(docs[text])))).alias("c"))
    counts = {b: n for b, n in found.groupBy("c.bits").count().collect()}
    tested, reached = sum(counts.values()), 0
    threshold = MOST_BITS + 1
    for bits in sorted(counts, reverse=True):
        reached += counts[bits]
        if bits >= math.log2(tested / (fdr * reached)):
            threshold = bits
    return threshold


def all_spans(text: Column, threshold: int) -> Column:
    """The fixed kinds and the accepted random runs that lie in none of them; parts of accepted runs are left out."""
    def holds(outer: Column, x: Column) -> Column:
        return (outer["start"] <= x["start"]) & (outer["end"] >= x["end"])

    def passed(x: Column) -> Column:
        return (x["bits"] >= threshold) & x["random"]

    def added(s: Column) -> Column:
        free = lambda x: ~F.exists(s["base"], lambda b: holds(b, x))
        wholes = F.filter(s["wholes"], lambda x: passed(x) & free(x))
        parts = F.filter(s["parts"], lambda x: passed(x) & free(x) & ~F.exists(
            s["wholes"], lambda w: passed(w) & holds(w, x)))
        return F.array_distinct(F.sort_array(F.concat(s["base"], _of_kind(wholes, len(KINDS)), _of_kind(parts, len(KINDS)))))
    wholes, parts = candidates(text)
    return let(F.struct(base_spans(text).alias("base"), wholes.alias("wholes"), parts.alias("parts")), added)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fdr: float = FDR) -> DataFrame:
    """Per document: counts of the fixed kinds, a digest of their spans, and all spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind.
    """
    threshold = evidence_threshold(docs, text, fdr)
    spans = docs.select(docs[doc_id].alias("doc_id"), all_spans(whole(docs[text]), threshold).alias("s"))

    def number(rank: int) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == rank)).cast("long")
    base = F.filter("s", lambda x: x["kind"] < len(KINDS))
    return spans.select("doc_id", *[number(r).alias(f"n_{k[0]}") for r, k in enumerate(KINDS)],
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans"),
                        number(len(KINDS)).alias("n_random"))


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with the union of the spans (sorted by start) replaced, one mask for each stretch."""
    def joined(s: Column) -> Column:
        ends = F.transform(s, lambda x: x["end"])
        reach = let(ends, lambda e: F.transform(e, lambda _, i: F.coalesce(F.array_max(F.slice(e, F.lit(1), i)), F.lit(0))))
        head = let(reach, lambda r: F.transform(s, lambda x, i: F.when(
            x["start"] >= F.get(r, i),
            F.concat(F.substring(text, F.get(r, i) + 1, x["start"] - F.get(r, i)), F.lit(mask))).otherwise(F.lit(""))))
        return F.concat(F.array_join(head, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(let(spans, joined))


def mask_secrets(docs: DataFrame, text: str = "text", fdr: float = FDR, mask: str = MASK) -> DataFrame:
    """All documents, with every secret in ``text`` replaced; null texts stay null."""
    threshold = evidence_threshold(docs, text, fdr)
    own, = own_columns(docs, "spans")
    # A column of its own: the spans are used several times, and worked out once.
    found = docs.withColumn(own, F.when(docs[text].isNotNull(), all_spans(whole(docs[text]), threshold)))
    clean = F.when(found[own].isNotNull(), masked(found[text].cast("string"), found[own]))
    return found.withColumn(text, clean).drop(own)
