"""Deterministic posting filters: hard constraints and title relevance.

Built-in expressions only, so the filter runs inside the scan stage, ahead of
tokenising and scoring.
"""
from __future__ import annotations

from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia import rules
from vacancia.candidate import Profile
from vacancia.functions.core import let, with_present
from vacancia.functions.text import strip_tags


def title_relevant(title: Column) -> Column:
    """Reject list first, then the accept list."""
    return ~title.rlike(rules.IRRELEVANT_TITLE) & title.rlike(
        rules.ascii_words(rules.RELEVANT_TITLE))


def software_title_like(title: Column) -> Column:
    """Case-insensitive LIKE over the fixed title patterns."""
    return reduce(lambda a, b: a | b, [title.ilike(p) for p in rules.SOFTWARE_TITLE_LIKE])


def _no_failures() -> Column:
    return F.array().cast("array<string>")


def _only_if(test: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(test, F.array(text)).otherwise(_no_failures())


def _number(digits: Column) -> Column:
    """Digit run as a number; runs too long for a bigint count as very large."""
    return F.coalesce(digits.try_cast("bigint"), F.lit(2**63 - 1))


def _range_bounds(clean: Column) -> Column:
    """``array<struct(lo, hi)>`` of the "N-M years" requirements."""
    pair = r"^(\d+)\s*[-–]\s*(\d+)"
    return F.transform(
        F.regexp_extract_all(clean, F.lit(rules.YEARS_RANGE), F.lit(0)),
        lambda m: F.struct(_number(F.regexp_extract(m, pair, 1)).alias("lo"),
                           F.regexp_extract(m, pair, 2).alias("hi")))


def _single_years(clean: Column) -> Column:
    """Years of the non-range requirement forms, in form order."""
    forms = (rules.YEARS_ANCHORED, rules.YEARS_MINIMUM, rules.YEARS_PLUS)
    tight = F.regexp_replace(clean, rules.RANGE_GAP, "$1-")
    found = let(tight, lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in forms]))
    return F.transform(found, _number)


def _message(form: str, **values: Column) -> Column:
    """A message with column values in its places."""
    parts = [F.concat(F.lit(text), values[name]) if name else F.lit(text) for text, name, _, _ in Formatter().parse(form)]
    return F.concat(*parts)


def years_failures(clean: Column, limit: int) -> Column:
    """Messages for requirements of ``limit`` years or more.

    Two substring tests keep the four regular expressions off texts that never
    mention years.
    """
    most = F.lit(str(limit - 1))
    ranges = F.transform(
        F.filter(_range_bounds(clean), lambda r: r["lo"] >= limit),
        lambda r: _message(rules.FAILED_YEARS_RANGE, low=r["lo"].cast("string"), high=r["hi"], most=most))
    singles = F.transform(
        F.filter(_single_years(clean), lambda y: y >= limit),
        lambda y: _message(rules.FAILED_YEARS, low=y.cast("string"), most=most))
    mentions = clean.contains("year") | clean.contains("yr")
    return F.when(mentions, F.concat(ranges, singles)).otherwise(_no_failures())


def required_years(clean: Column) -> Column:
    """Largest number of years any requirement form asks for, null when none."""
    values = F.concat(F.transform(_range_bounds(clean), lambda r: r["lo"]), _single_years(clean))
    return F.array_max(values)


def excluded_terms(title_lower: Column, value: str) -> Column:
    """Messages for the ``|``-separated title terms that occur as substrings."""
    terms = [t.strip().lower() for t in value.split("|")]
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(title_lower, t))
    return F.transform(hits, lambda t: _message(rules.FAILED_TITLE_TERM, term=t))


def clearance_required(clean: Column) -> Column:
    # The pattern must end in one of two words; most texts have neither.
    return (clean.contains("clearance") | clean.contains("security")) & clean.rlike(rules.CLEARANCE)


def outside_us(title: Column, text: Column, strict: bool = False) -> Column:
    """A non-US term and no US term in the location field, title or text."""
    edge = r"\b" if strict else ""
    def any_of(terms: str) -> str:
        return "(?i)" + rules.ascii_words(rf"\b(?:{terms}){edge}")
    # Only a JSON object can carry a location field; plain text skips the parser.
    place = F.when(F.ltrim(text).startswith("{"), F.coalesce(
        *[F.nullif(F.get_json_object(text, path), F.lit(""))
          for path in ("$.location.name", "$.locationName", "$.city")]))
    where = F.concat_ws(" ", F.coalesce(place, F.lit("")), title, text)
    return let(where, lambda w: w.rlike(any_of(rules.NON_US_TERMS))
               & ~w.rlike(any_of(rules.US_TERMS)))


def primary_languages(clean: Column, known: tuple[str, ...]) -> Column:
    """Messages for languages outside ``known`` named in a requirement sentence.

    One pattern over the whole text decides whether sentences are looked at.
    """
    marked = F.array_join(
        F.filter(F.split(clean, r"[.;!\n]"), lambda s: s.rlike(rules.ascii_words(rules.PRIMARY_INDICATORS))), "\n")
    lowered = {s.lower() for s in known}
    wanted = [(n, p) for n, p in rules.PRIMARY_LANGUAGES if n not in lowered]
    if not wanted:
        return _no_failures()
    mentioned = clean.rlike(rules.LANGUAGE_MENTION)
    named = let(marked, lambda m: F.array_compact(F.array(*[
        F.when(m.rlike(rules.ascii_words(p)), F.lit(rules.FAILED_LANGUAGE.format(language=n)))
        for n, p in wanted])))
    return F.when(mentioned, named).otherwise(_no_failures())


def security_operations(clean: Column, title_lower: Column) -> Column:
    possible = reduce(lambda a, b: a | b,
                      [clean.contains(w) for w in rules.SECURITY_OPERATIONS_WORDS])
    return (~title_lower.contains("software") & possible
            & clean.rlike(rules.ascii_words(rules.SECURITY_OPERATIONS)))


def security_title(title: Column, title_lower: Column) -> Column:
    return title.rlike(rules.ascii_words(rules.SECURITY_TITLE)) & ~title_lower.contains("software")


def clean_text(title: Column, text: Column) -> Column:
    """Lower-cased title and text without tags."""
    return strip_tags(F.concat_ws(" ", F.lower(title), F.lower(F.coalesce(text, F.lit("")))))


def hard_constraint_failures(profile: Profile, title: Column, title_lower: Column, text: Column,
                             clean: Column, strict: bool = False) -> Column:
    """Distinct failure messages in rule order."""
    parts: list[Column] = []
    for kind, value in profile.hard_constraints:
        if kind == "min_years":
            parts.append(years_failures(clean, int(value)))
        elif kind == "exclude_pattern":
            parts.append(excluded_terms(title_lower, value))
        elif kind == "clearance" and value == "none":
            parts.append(_only_if(clearance_required(clean), rules.FAILED_CLEARANCE))
    if "true" in profile.constraints("location_us_only"):
        parts.append(_only_if(outside_us(title, text, strict), rules.FAILED_LOCATION))
    parts.append(primary_languages(clean, profile.skills))
    parts.append(_only_if(security_operations(clean, title_lower), rules.FAILED_SECURITY_OPERATIONS))
    parts.append(_only_if(security_title(title, title_lower), _message(rules.FAILED_SECURITY_TITLE, title=title)))
    return F.array_distinct(F.concat(*parts))


def _failures_of(profile: Profile, title: str, text: str, strict: bool) -> Column:
    return let(
        F.struct(F.col(title).alias("title"), F.lower(title).alias("lower"),
                 F.coalesce(F.col(text), F.lit("")).alias("text"),
                 clean_text(F.col(title), F.col(text)).alias("clean")),
        lambda r: hard_constraint_failures(profile, r["title"], r["lower"], r["text"], r["clean"],
                                           strict))


def check_hard_constraints(jobs: DataFrame, profile: Profile, title: str = "title",
                           text: str = "raw_json", strict: bool = False) -> DataFrame:
    """Add ``passed`` and ``failures`` (distinct messages in rule order).

    Constraint kinds without a rule (visa, graduation) never reject. Filters on
    the added columns stay above the rules, which run once per row.
    """
    failures = _failures_of(profile, title, text, strict)
    return with_present(jobs, "failures", failures).withColumn("passed", F.size("failures") == 0)


def eligible(jobs: DataFrame, profile: Profile, title: str = "title", text: str = "raw_json",
             strict: bool = False) -> DataFrame:
    """The rows that no hard constraint rejects."""
    return check_hard_constraints(jobs, profile, title, text, strict).filter("passed") \
        .drop("passed", "failures")


def failure_counts(checked: DataFrame) -> DataFrame:
    """How often each failure message occurs."""
    return checked.select(F.explode("failures").alias("failure")).groupBy("failure").agg(
        F.count(F.lit(1)).alias("n"))


def enforcement(checked: DataFrame, expected: str = "should_pass") -> DataFrame:
    """Share of must-reject rows rejected, and of must-pass rows rejected."""
    want = F.col(expected)
    return checked.agg(
        F.coalesce(F.avg(F.when(~want, (~F.col("passed")).cast("int"))), F.lit(1.0))
        .alias("enforcement"),
        F.coalesce(F.avg(F.when(want, (~F.col("passed")).cast("int"))), F.lit(0.0))
        .alias("false_positive_rate"))
