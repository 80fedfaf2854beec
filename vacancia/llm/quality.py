"""Quality rules run as a short-circuit cascade.

Every rule is a cheap column expression that says whether a document is to be
rejected. Before the run each rule is measured alone on a bounded sample: the
share that it rejects, and the seconds it takes. The cascade then tests the
rules in falling order of rejections per second, and ``CASE WHEN`` leaves a
document at its first rejection. The order decides what is computed, never the
verdict, which is the conjunction of all rules.

Defined results: a null text is an empty one and has no words, so it fails
``few_words``; repeated rows each get the same verdict; null ids and further
columns are carried along; an empty table gives an empty result.
"""
from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.core import let
from vacancia.llm.texts import whole, windows, words
from vacancia.session import reliable

#: Rows that the costs and selectivities are estimated on.
SAMPLE_ROWS = 1000

SYMBOLS = "[#*$%&|<>]+"
A_WORD = r"[^\x20\x09-\x0D]"


def count_chars(text: Column, pattern: str) -> Column:
    """How many code points of ``text`` lie in matches of ``pattern``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def n_words(text: Column, w: Column) -> Column:
    return F.size(w).cast("long")


def word_chars(text: Column, w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column, w: Column) -> Column:
    return count_chars(text, SYMBOLS)


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(A_WORD))


def n_dup_lines(text: Column, w: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, w: Column) -> Column:
    """Words that lie in a window of three found twice or more in the text.

    A window is represented by the 64-bit hash of its words. Texts whose windows
    are all different stop after one hash pass. Otherwise the windows are sorted
    with their positions, equal neighbours mark the repeated ones, and the union
    of the marked windows is measured from the gaps between their sorted starts.
    """
    grams = windows(w, 3, lambda x: F.xxhash64(*x))

    def starts(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return let(placed, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"])),
            lambda x: x["i"])))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def counted(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(starts(g), covered))

    return let(grams, counted).cast("long")


STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the statistics by name (computed where it asks for them) and the text."""
    name: str
    rejects: Callable[[Callable[[str], Column], Column], Column]


BASE_RULES = (
    Rule("few_words", lambda s, t: s("n_words") < 50),
    Rule("repeated_words", lambda s, t: s("n_repeat_words") * 100 > s("n_words") * 50),
)
#: The thresholds are common web-corpus heuristics; all are inclusive on the keeping side.
RULES = BASE_RULES + (
    Rule("word_length", lambda s, t: (s("word_chars") < s("n_words") * 3) | (s("word_chars") > s("n_words") * 10)),
    Rule("symbols", lambda s, t: s("n_symbols") * 10 > s("n_words")),
    Rule("few_letters", lambda s, t: count_chars(t, r"\p{L}+") * 2 < s("word_chars")),
    Rule("upper_case", lambda s, t: count_chars(t, r"\p{Lu}+") * 2 > count_chars(t, r"\p{L}+")),
    Rule("exclamations", lambda s, t: count_chars(t, "!+") * 10 > s("n_words") * 3),
    Rule("repeated_lines", lambda s, t: s("n_dup_lines") * 2 > F.size(worded_lines(t))),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def _looked_up(text: Column, w: Column, ready: set[str]) -> Callable[[str], Column]:
    return lambda name: F.col(name) if name in ready else STATISTICS[name](text, w)


def measure(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
            sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[Measured]:
    """Each rule's rejected share and seconds on the sample, best order first.

    The sample is a Bernoulli draw of about ``sample_rows`` rows of the whole
    table, kept in the shared folder while the rules are timed.
    """
    rows = docs.count()
    sample = docs.select(whole(docs[text]).alias("t"))
    if rows > sample_rows:
        sample = sample.sample(fraction=sample_rows / rows, seed=seed)
    sample = reliable(sample.select("t", words(F.col("t")).alias("w")))

    def timed(rejects: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(rejects.cast("double"))).first()[0]
        return share or 0.0, time.perf_counter() - began

    lookup = _looked_up(F.col("t"), F.col("w"), set())
    timed(F.length("t") < 0)
    _, idle = timed(F.length("t") < 0)
    found = []
    for rule in rules:
        share, seconds = timed(rule.rejects(lookup, F.col("t")))
        found.append(Measured(rule, share, max(seconds - idle, 1e-3)))
    return sorted(found, key=lambda m: (-m.gain, m.rule.name))


def cascade(order: list[Rule], text: Column, w: Column, ready: set[str] = frozenset()) -> Column:
    """True where no rule rejects; the rules after the first rejection are not evaluated.

    ``ready`` names statistics that are already columns.
    """
    verdict = F.when(F.lit(False), F.lit(False))
    for rule in order:
        verdict = verdict.when(rule.rejects(_looked_up(text, w, ready), text), F.lit(False))
    return verdict.otherwise(F.lit(True))


def filter_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns unchanged."""
    order = [m.rule for m in measure(docs, text, rules)]
    t = whole(docs[text])
    # ``let`` keeps the words from being split again for every reference once the filter is pushed down.
    return docs.filter(let(words(docs[text]), lambda w: cascade(order, t, w)))


def quality_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: the statistics, ``base_failed`` and the cascade's verdict ``kept``."""
    order = [m.rule for m in measure(docs, text, rules)]
    base = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("t")).withColumn("w", words(F.col("t")))
    stats = base.select("doc_id", "t", "w", *[f(F.col("t"), F.col("w")).alias(n) for n, f in STATISTICS.items()])
    lookup = _looked_up(F.col("t"), F.col("w"), set(STATISTICS))
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rule.rejects(lookup, F.col("t"))
    return stats.select("doc_id", *STATISTICS, failed.alias("base_failed"),
                        cascade(order, F.col("t"), F.col("w"), set(STATISTICS)).alias("kept"))
