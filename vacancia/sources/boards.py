"""Vendor payloads to canonical postings.

A payload row holds one response body. Validation is per response: one bad
element makes the whole response non-conformant, and such responses are data
(quarantine rows), never a failed job.

Arrays are split as raw JSON text first and each element is read as VARIANT,
so unknown fields survive in ``raw_json`` and no size limit applies to a board
as a whole.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.core import explode_present, let
from vacancia.functions.text import iso_millis, parse_vendor_time
from vacancia.functions.urls import (board_fetch_body, board_fetch_method, board_fetch_url,
                                     fix_placeholder_url)

_BAD = "_bad"


def _elements(schema: str, field: str) -> Column:
    """Raw JSON texts of the posting array, null when absent or malformed."""
    parsed = F.from_json(F.col("body"), f"{schema}, {_BAD} string",
                         {"columnNameOfCorruptRecord": _BAD})
    return let(parsed, lambda p: F.when(p[_BAD].isNull(), p[field]))


def _kind(v: Column, path: str) -> Column:
    """Type name of the value at ``path``: 'NULL' when absent, 'VOID' when JSON null."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("NULL"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is_text(v: Column, path: str) -> Column:
    return _kind(v, path) == "STRING"


def _is_number(v: Column, path: str) -> Column:
    return _kind(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL)")


def _optional_text(v: Column, path: str, nullable: bool = False) -> Column:
    return _kind(v, path).isin(*(["STRING", "NULL"] + (["VOID"] if nullable else [])))


def _greenhouse_ok(v: Column) -> Column:
    names = F.coalesce(F.try_variant_get(v, "$.departments", "array<variant>"),
                       F.expr("cast(array() as array<variant>)"))
    return (_is_number(v, "$.id") & _is_text(v, "$.title") & _is_text(v, "$.absolute_url")
            & _is_text(v, "$.updated_at")
            & (_kind(v, "$.location").isin("NULL", "VOID") | _is_text(v, "$.location.name"))
            & _kind(v, "$.departments").rlike("^(NULL|ARRAY)")
            & F.forall(names, lambda d: _is_text(d, "$.name")))


def _lever_ok(v: Column) -> Column:
    return (_is_text(v, "$.id") & _is_text(v, "$.text") & _is_text(v, "$.hostedUrl")
            & _is_number(v, "$.createdAt") & _kind(v, "$.categories").rlike("^(NULL|OBJECT)")
            & _optional_text(v, "$.categories.location")
            & _optional_text(v, "$.categories.department"))


def _ashby_ok(v: Column) -> Column:
    return (_is_text(v, "$.id") & _is_text(v, "$.title") & _is_text(v, "$.locationName")
            & _optional_text(v, "$.employmentType")
            & _optional_text(v, "$.compensationTierSummary", nullable=True))


def _workable_ok(v: Column) -> Column:
    required = _is_text(v, "$.shortcode") & _is_text(v, "$.title") & _is_text(v, "$.url")
    return reduce(lambda a, p: a & _optional_text(v, p, nullable=True),
                  ("$.city", "$.department", "$.published", "$.shortlink"), required)


def _greenhouse_row(v: Column) -> dict[str, Column]:
    posted = F.coalesce(_text(v, "$.first_published"), _text(v, "$.updated_at"))
    return {"external_id": _text(v, "$.id"), "title": _text(v, "$.title"),
            "url": _text(v, "$.absolute_url"), "location": _text(v, "$.location.name"),
            "department": _text(v, "$.departments[0].name"), "posted_raw": posted}


def _lever_row(v: Column) -> dict[str, Column]:
    created = F.try_variant_get(v, "$.createdAt", "bigint")
    return {"external_id": _text(v, "$.id"), "title": _text(v, "$.text"),
            "url": _text(v, "$.hostedUrl"), "location": _text(v, "$.categories.location"),
            "department": _text(v, "$.categories.department"), "posted_raw": iso_millis(created)}


def _ashby_row(v: Column) -> dict[str, Column]:
    link = F.concat(F.lit("https://jobs.ashbyhq.com/unknown/"), _text(v, "$.id"))
    none = F.lit(None).cast("string")
    return {"external_id": _text(v, "$.id"), "title": _text(v, "$.title"), "url": link,
            "location": _text(v, "$.locationName"), "department": none, "posted_raw": none}


def _workable_row(v: Column) -> dict[str, Column]:
    return {"external_id": _text(v, "$.shortcode"), "title": _text(v, "$.title"),
            "url": _text(v, "$.url"), "location": _text(v, "$.city"),
            "department": _text(v, "$.department"), "posted_raw": _text(v, "$.published")}


def _list_of(field: str) -> Callable[[], Column]:
    return lambda: _elements(f"{field} array<string>", field)


def _top_level() -> Column:
    # A top-level array cannot carry a corrupt-record field; malformed text gives null.
    return F.from_json(F.col("body"), "array<string>")


def _ashby_list() -> Column:
    # A null board is a valid answer with no postings; a missing one is not.
    parsed = F.from_json(F.col("body"), f"data string, {_BAD} string",
                         {"columnNameOfCorruptRecord": _BAD})
    def postings(data: Column) -> Column:
        board = F.from_json(data, "jobBoard string")["jobBoard"]
        listed = F.from_json(board, "jobPostings array<string>")["jobPostings"]
        empty = board.isNull() & F.array_contains(F.json_object_keys(data), "jobBoard")
        return F.when(empty, F.array().cast("array<string>")).otherwise(listed)
    return let(let(parsed, lambda p: F.when(p[_BAD].isNull(), p["data"])), postings)


# Registry: how to split a body, what an element must satisfy, how it is named.
ADAPTERS: dict[str, tuple[Callable, Callable, Callable]] = {
    "greenhouse": (_list_of("jobs"), _greenhouse_ok, _greenhouse_row),
    "lever": (_top_level, _lever_ok, _lever_row),
    "ashby": (_ashby_list, _ashby_ok, _ashby_row),
    "workable": (_list_of("jobs"), _workable_ok, _workable_row),
}


def _items(ats: str) -> Column:
    """Elements of a body as ``array<struct(raw, v)>``, null when unreadable."""
    return F.transform(ADAPTERS[ats][0](), lambda r: F.struct(
        r.alias("raw"), F.try_parse_json(r).alias("v")))


def _all_ok(ats: str, items: Column) -> Column:
    ok = ADAPTERS[ats][1]
    return F.coalesce(F.forall(items, lambda e: F.coalesce(ok(e["v"]), F.lit(False))), F.lit(False))


#: Text fields of a canonical posting, as every vendor's row function names them.
FIELDS = ("external_id", "title", "url", "location", "department", "posted_raw")


def _parsed(ats: str) -> Column:
    """Verdict and, if it is good, postings of a body, which is split and validated once."""
    def posting(e: Column) -> Column:
        named = ADAPTERS[ats][2](e["v"])
        return F.struct(*[named[f].alias(f) for f in FIELDS], e["raw"].alias("raw_json"))
    return let(_items(ats), lambda xs: let(_all_ok(ats, xs), lambda ok: F.struct(
        xs.isNotNull().alias("readable"), ok.alias("ok"), F.size(xs).alias("n"),
        F.when(ok, F.transform(xs, posting)).alias("postings"))))


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Every payload with ``conformant``, ``reason``, ``n_postings`` and ``postings``, without its body.

    One scan whatever the vendors: each body goes to its vendor's arm and is parsed once, for the verdict and the postings.
    """
    parsed = reduce(lambda acc, a: acc.when(F.col("ats_type") == a, _parsed(a)), ADAPTERS, F)
    keep = [c for c in payloads.columns if c != "body"]
    # The outer explode keeps the optimiser from repeating the parse in every column taken from it.
    v = F.col("__v")
    return payloads.select(*keep, F.explode_outer(F.array(parsed)).alias("__v")).select(
        *keep, v["ok"].alias("conformant"),
        F.when(~v["readable"], "unreadable body or missing list")
        .when(~v["ok"], "element fails validation").alias("reason"),
        F.when(v["ok"], v["n"]).cast("bigint").alias("n_postings"), v["postings"].alias("postings"))


def payload_conformance(payloads: DataFrame) -> DataFrame:
    """Every payload with ``conformant``, ``reason`` and ``n_postings``."""
    return parse_payloads(payloads).drop("postings")


def _canonical(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Postings (struct column __e) as canonical rows."""
    out = rows.select(*keep, *[F.col(f"__e.{f}").alias(f) for f in (*FIELDS, "raw_json")])
    return (out.withColumn("url", fix_placeholder_url(F.col("url"), F.col("slug")))
            .withColumn("posted_at", parse_vendor_time(F.col("posted_raw"))))


def parsed_postings(parsed: DataFrame) -> DataFrame:
    """Canonical postings of parsed payloads; non-conformant responses yield none."""
    keep = [c for c in parsed.columns if c not in ("conformant", "reason", "n_postings", "postings")]
    return _canonical(explode_present(parsed, "__e", F.col("postings")), keep)


def normalize_vendor(payloads: DataFrame, ats: str) -> DataFrame:
    """Canonical postings of one vendor; non-conformant responses yield none.

    A body is split, validated and exploded in one evaluation.
    """
    keep = [c for c in payloads.columns if c != "body"]
    of_vendor = payloads.filter(F.col("ats_type") == ats)
    return _canonical(explode_present(of_vendor, "__e", let(_parsed(ats), lambda p: p["postings"])), keep)


def normalize_postings(payloads: DataFrame) -> DataFrame:
    """Dispatch by vendor to one canonical output, in one scan."""
    return parsed_postings(parse_payloads(payloads))


def board_request(companies: DataFrame) -> DataFrame:
    """Request table for an external fetcher."""
    ats, slug = F.col("ats_type"), F.col("slug")
    return companies.select(
        *[c for c in companies.columns if c in ("company_id", "ats_type", "slug")],
        board_fetch_url(ats, slug).alias("url"), board_fetch_method(ats).alias("method"),
        board_fetch_body(ats, slug).alias("body"))


def parsed_outcomes(parsed: DataFrame) -> DataFrame:
    """Poll-log rows of parsed payloads: timeout, error or success."""
    ok = F.col("status_code").between(200, 299) & F.col("conformant")
    status = F.when(F.col("aborted"), "timeout").when(ok, "success").otherwise("error")
    message = (F.when(F.col("aborted"), "aborted")
               .when(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)),
                     F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
               .when(~F.col("conformant"), F.col("reason")))
    return parsed.select(
        "company_id", "ats_type", F.col("fetched_at").alias("attempted_at"),
        status.alias("status"), F.when(~F.col("aborted"), F.col("status_code")).alias("status_code"),
        "latency_ms", F.when(status == "success", F.col("n_postings")).alias("jobs_found"),
        message.alias("error_message"))


def poll_outcomes(payloads: DataFrame) -> DataFrame:
    """Poll-log rows of landed responses."""
    return parsed_outcomes(parse_payloads(payloads))


def throttle_signal(headers: Column) -> Column:
    """True when response headers announce throttling (names in lower case)."""
    return (F.coalesce(F.map_contains_key(headers, "retry-after"), F.lit(False))
            | F.coalesce(F.try_element_at(headers, F.lit("x-ratelimit-remaining")) == "0",
                         F.lit(False)))
