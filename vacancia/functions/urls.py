"""Column expressions over URLs: vendor detection, request building, extraction."""
from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancia import rules
from vacancia.functions.core import let


def board_api_url(ats: Column, slug: Column) -> Column:
    """Listing endpoint stored for a discovered company."""
    return (
        F.when(ats == "greenhouse", F.concat(F.lit(rules.GREENHOUSE_API), slug, F.lit("/jobs")))
        .when(ats == "lever", F.concat(F.lit(rules.LEVER_API), slug))
        .when(ats == "ashby", F.lit(rules.ASHBY_API))
        .when(ats == "workable", F.concat(F.lit(rules.WORKABLE_API), slug))
    )


def parse_board_url(url: Column) -> Column:
    """``struct(ats_type, slug, ats_url)`` of the first matching pattern, else null.

    A pattern runs only on text that contains its literal, so the many URLs that
    are no board cost a few substring searches.
    """
    return let(F.lower(url), _first_board)


def mentions_board(text: Column) -> Column:
    """Cheap test: some vendor host occurs in the text, which is evaluated once."""
    return let(F.lower(text), lambda lowered: reduce(
        lambda a, b: a | b, [lowered.contains(h) for h in rules.BOARD_HOSTS]))


def _first_board(lowered: Column) -> Column:
    def named(ats: str, slug: Column) -> Column:
        return F.when(slug != "", F.struct(F.lit(ats).alias("ats_type"), slug.alias("slug"),
                                           board_api_url(F.lit(ats), slug).alias("ats_url")))
    # Tried in order; what comes after the first match is not evaluated.
    return F.coalesce(*[
        F.when(lowered.contains(literal), let(F.regexp_extract(lowered, pattern, 1), partial(named, ats)))
        for ats, literal, pattern in rules.BOARD_URL_PATTERNS
    ])


def _component(slug: Column) -> Column:
    # URL path components encode a space as %20, form encoding as "+".
    return F.replace(F.url_encode(slug), F.lit("+"), F.lit("%20"))


def board_fetch_url(ats: Column, slug: Column) -> Column:
    """URL an external fetcher requests for a board."""
    enc = _component(slug)
    return (
        F.when(ats == "greenhouse",
               F.concat(F.lit(rules.GREENHOUSE_API), enc, F.lit("/jobs?content=true")))
        .when(ats == "lever", F.concat(F.lit(rules.LEVER_API), enc))
        .when(ats == "ashby", F.lit(rules.ASHBY_API))
        .when(ats == "workable", F.concat(F.lit(rules.WORKABLE_API), enc))
    )


def board_fetch_method(ats: Column) -> Column:
    return F.when(ats == "ashby", "POST").otherwise("GET")


def board_fetch_body(ats: Column, slug: Column) -> Column:
    """JSON request body; only the GraphQL vendor has one."""
    body = F.to_json(F.struct(
        F.lit(rules.ASHBY_OPERATION).alias("operationName"),
        F.struct(slug.alias("organizationHostedJobsPageName")).alias("variables"),
        F.lit(rules.ASHBY_QUERY).alias("query"),
    ))
    return F.when(ats == "ashby", body)


def fix_placeholder_url(url: Column, slug: Column) -> Column:
    """Put the company slug where a vendor's listing left a placeholder."""
    return F.replace(url, F.lit("/unknown/"), F.concat(F.lit("/"), slug, F.lit("/")))


def extract_urls(text: Column, variant: str) -> Column:
    """All URLs in ``text``, in order; free-text variants drop a trailing ``.`` or ``)``."""
    urls = F.regexp_extract_all(text, F.lit(rules.URL_PATTERNS[variant]), F.lit(0))
    if variant in ("markdown", "list"):
        return urls
    # ``$`` also matches before a final line end; the other URLs have nothing to drop.
    return F.transform(urls, lambda u: F.when(
        F.substring(u, -1, 1).isin(".", ")", "\u0085", "\u2028", "\u2029"),
        F.regexp_replace(u, r"[.)]+$", "")).otherwise(u))


def crawl_pattern(url: Column) -> Column:
    """Name of the first crawl wildcard pattern the URL falls under, else null."""
    # Crawled hosts may hold characters the URL parser rejects (underscores).
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    out = None
    for name, suffix, prefix in rules.CRAWL_PATTERNS:
        host_ok = host.endswith(suffix) if suffix.startswith(".") else host == suffix
        test = host_ok & path.startswith(prefix)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def surt_vendor(surt: Column) -> Column:
    """Vendor whose SURT prefix the key starts with, else null."""
    out = None
    for prefix, ats in rules.SURT_PREFIXES:
        out = (F if out is None else out).when(surt.startswith(prefix), ats)
    return out


def surt_prefix(surt: Column) -> Column:
    out = None
    for prefix, _ in rules.SURT_PREFIXES:
        out = (F if out is None else out).when(surt.startswith(prefix), prefix)
    return out
