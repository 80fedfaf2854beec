"""Discovery extractors: text, JSON and index lines to company discoveries.

Each extractor returns the columns of ``schemas.DISCOVERY``. ``doc``,
``line_no`` and ``pos`` carry the reading order that first-wins deduplication
needs; nothing here shuffles.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia import rules
from vacancia.functions.core import explode_present, let, with_present
from vacancia.functions.text import slugify, strip_tags
from vacancia.functions.urls import (board_api_url, crawl_pattern, extract_urls, mentions_board,
                                     parse_board_url, surt_prefix, surt_vendor)
from vacancia.sources.blocks import read_blocks


def split_lines(docs: DataFrame) -> DataFrame:
    """``docs(doc, text)`` to ``(doc, line_no, line)``."""
    return docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
                       ).withColumn("line_no", F.col("line_no").cast("bigint"))


def _parsed_urls(text: Column, variant: str) -> Column:
    """Board URLs in ``text`` as ``array<struct(pos, board)>``; null if no vendor host occurs in it.

    The test is part of the expression: a filter would be pushed below the projection
    that makes the text, and the text would be made again for every place that mentions it.
    """
    hits = F.transform(extract_urls(text, variant),
                       lambda u, i: F.struct(i.cast("bigint").alias("pos"),
                                             parse_board_url(u).alias("board")))
    return F.when(mentions_board(text), F.filter(hits, lambda h: h["board"].isNotNull()))


def _output(df: DataFrame, name: Column, source_type: Column | str, detail: Column,
            board: str = "board", ats_url: Column | None = None) -> DataFrame:
    kind = F.lit(source_type) if isinstance(source_type, str) else source_type
    return df.select(
        F.col(f"{board}.ats_type").alias("ats_type"), F.col(f"{board}.slug").alias("slug"),
        name.alias("name"),
        (F.col(f"{board}.ats_url") if ats_url is None else ats_url).alias("ats_url"),
        kind.alias("source_type"), detail.alias("source_detail"),
        F.col("doc"), F.col("line_no"), F.col("pos"))


def _exploded(df: DataFrame, text: Column, variant: str) -> DataFrame:
    """One row per board URL found in ``text``."""
    return (
        explode_present(df, "__hit", _parsed_urls(text, variant))
        .withColumn("pos", F.col("__hit.pos")).withColumn("board", F.col("__hit.board"))
        .drop("__hit")
    )


def from_markdown(lines: DataFrame) -> DataFrame:
    """Table rows of a markdown list: the first board URL of each line."""
    cell = F.regexp_extract("line", r"\|\s*\[([^\]]+)\]", 1)
    found = (
        with_present(lines, "__hit", F.when(F.col("line").contains("|"),
                                            F.get(_parsed_urls(F.col("line"), "markdown"), F.lit(0))))
        .withColumn("pos", F.lit(0).cast("bigint")).withColumn("board", F.col("__hit.board"))
    )
    return _output(found, F.coalesce(F.nullif(cell, F.lit("")), F.col("board.slug")),
                   "oss_list", F.col("doc"))


def from_readme(lines: DataFrame) -> DataFrame:
    """Every board URL of a README, named after the first table cell of its line."""
    cell = F.trim(F.regexp_extract(
        "line", r"\|\s*(?:\*\*)?(?:<img[^>]*>)?\s*\[?([^\]|*<\n]+)", 1))
    found = _exploded(lines, F.col("line"), "text")
    return _output(found, F.coalesce(F.nullif(cell, F.lit("")), F.col("board.slug")),
                   "oss_list", F.col("doc"))


def from_url_list(lines: DataFrame) -> DataFrame:
    """URLs anywhere in plain text."""
    found = _exploded(lines, F.col("line"), "list")
    return _output(found, F.col("board.slug"), "oss_list", F.col("doc"))


def from_company_json(docs: DataFrame) -> DataFrame:
    """A JSON array of companies per document; incomplete or unknown rows are skipped."""
    rows = F.from_json("text", "array<struct<name:string,slug:string,ats_type:string,"
                               "ats_url:string>>")
    item = docs.select("doc", F.posexplode(rows).alias("pos", "board"))
    def filled(c):
        return F.coalesce(F.col(f"board.{c}") != "", F.lit(False))
    ok = (filled("slug") & filled("ats_type") & filled("ats_url")
          & F.col("board.ats_type").isin(*rules.VENDORS))
    named = F.coalesce(F.nullif(F.col("board.name"), F.lit("")), F.col("board.slug"))
    out = (item.filter(ok).withColumn("line_no", F.lit(0).cast("bigint"))
           .withColumn("pos", F.col("pos").cast("bigint")))
    return _output(out, named, "oss_list", F.col("doc"))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _crawl_entry(e: Column) -> Column:
    """Board, source and detail of one parsed crawl-index line."""
    link = F.coalesce(_filled(e["ats_url"]), _filled(e["url"]))
    explicit = _filled(e["slug"]).isNotNull() & _filled(e["ats_type"]).isNotNull() & link.isNotNull()
    kind = (F.when(e["source"].startswith("github:"), "github")
            .when(e["source"] == "common_crawl", "common_crawl").otherwise("oss_list"))
    listed = F.struct(
        F.struct(e["ats_type"].alias("ats_type"), e["slug"].alias("slug"), link.alias("ats_url"))
        .alias("board"),
        kind.alias("kind"), F.coalesce(_filled(e["source"]), F.lit("discovery")).alias("detail"))
    plain = let(parse_board_url(e["url"]), lambda b: F.when(b.isNotNull(), F.struct(
        b.alias("board"), F.lit("common_crawl").alias("kind"),
        F.coalesce(_filled(e["collection"]), F.lit("CC-MAIN")).alias("detail"))))
    return F.when(explicit, listed).otherwise(plain)


def from_crawl_jsonl(lines: DataFrame) -> DataFrame:
    """Crawl-index lines, either explicit company rows or plain ``{url}`` rows."""
    parsed = F.from_json(F.trim("line"), "slug string, ats_type string, ats_url string, "
                                         "url string, source string, collection string")
    found = (
        with_present(lines, "__hit", let(parsed, _crawl_entry))
        .withColumn("board", F.col("__hit.board")).withColumn("pos", F.lit(0).cast("bigint"))
    )
    return _output(found, F.col("board.slug"), F.col("__hit.kind"), F.col("__hit.detail"))


def from_cdx(lines: DataFrame) -> DataFrame:
    """CDX lines: the JSON tail carries the URL."""
    tail = F.substr("line", F.instr("line", "{").cast("int"))
    hit = F.when(F.col("line").contains("{"), let(F.from_json(tail, "url string")["url"], lambda u: let(
        parse_board_url(u), lambda b: F.when(b.isNotNull(), F.struct(u.alias("url"),
                                                                     b.alias("board"))))))
    found = (
        with_present(lines, "__hit", hit)
        .withColumn("board", F.col("__hit.board")).withColumn("pos", F.lit(0).cast("bigint"))
    )
    return _output(found, F.col("board.slug"), "common_crawl", F.lit("cc-direct-cdx"),
                   ats_url=F.col("__hit.url"))


def cluster_blocks(lines: DataFrame, include_preceding: bool = False) -> DataFrame:
    """Index blocks whose first key starts with a vendor prefix.

    ``include_preceding`` also keeps, per vendor, the last block that starts
    before the prefix and so may run into it.
    """
    parts = F.split("line", "\t")
    blocks = lines.filter(F.size(parts) >= 4).select(
        "doc", parts[0].alias("surt"), parts[1].alias("shard"),
        parts[2].try_cast("bigint").alias("offset"), parts[3].try_cast("bigint").alias("length"))
    direct = (
        blocks.withColumn("surt_prefix", surt_prefix(F.col("surt")))
        .withColumn("ats_type", surt_vendor(F.col("surt")))
        .filter("surt_prefix is not null")
    )
    if not include_preceding:
        return direct
    before = None
    for prefix, ats in rules.SURT_PREFIXES:
        # max_by keeps one candidate per task before the shuffle.
        one = (
            blocks.filter(F.col("surt") < prefix).groupBy("doc")
            .agg(F.max_by(F.struct("surt", "shard", "offset", "length"),
                          F.struct("surt", "shard", "offset")).alias("b"))
            .select("doc", "b.*", F.lit(prefix).alias("surt_prefix"), F.lit(ats).alias("ats_type"))
        )
        before = one if before is None else before.unionByName(one)
    return direct.unionByName(before)


def from_index(spark: SparkSession, index: DataFrame, shards: str, on_error: str = "raise") -> DataFrame:
    """Boards from a crawl index: blocks are picked by their keys, and only those are read.

    ``index`` has the lines of the cluster index, ``shards`` is the folder of the gzip files.
    The block before a vendor's first may run into the vendor's keys and is read as
    well; lines of other keys are left out before they are parsed.
    """
    blocks = cluster_blocks(index, include_preceding=True)
    lines = read_blocks(spark, blocks, shards, on_error)
    return from_cdx(lines.filter(surt_prefix(F.col("line")).isNotNull()))


def hiring_threads(threads: DataFrame, now: Column, months: int = 12) -> DataFrame:
    """Threads that ask who is hiring, created within ``months`` of 30 days."""
    title = F.lower("title")
    cutoff = now - F.make_dt_interval(days=F.lit(months * 30))
    return threads.filter(title.contains("who is hiring") & ~title.contains("who wants")
                          & (F.col("created_at") > cutoff))


def from_threads(threads: DataFrame, comments: DataFrame, now: Column,
                 months: int = 12) -> DataFrame:
    """Board URLs in the comments of hiring threads.

    Thread ids are a small dimension; the semi join is sized by the optimiser.
    """
    kept = comments.join(hiring_threads(threads, now, months).select("thread_id"),
                         "thread_id", "left_semi")
    lines = kept.select(F.col("thread_id").cast("string").alias("doc"),
                        F.col("comment_no").cast("bigint").alias("line_no"),
                        strip_tags(F.col("comment_html")).alias("line"))
    found = _exploded(lines, F.col("line"), "thread")
    return _output(found, F.col("board.slug"), "hn",
                   F.concat(F.lit("whos-hiring:"), F.col("doc")))


def from_directory(directory: DataFrame) -> DataFrame:
    """Board URLs in a company directory's free-text fields."""
    text = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit(""))
                              for c in ("website", "long_description", "one_liner")])
    rows = directory.select("name", "batch", F.lit("directory").alias("doc"),
                            F.col("record_no").cast("bigint").alias("line_no"), text.alias("line"))
    found = _exploded(rows, F.col("line"), "text")
    batch = F.coalesce(F.nullif("batch", F.lit("")), F.lit("unknown"))
    return _output(found, F.col("name"), "yc", F.concat(F.lit("yc:"), batch))


def probe_candidates(directory: DataFrame, known: DataFrame) -> DataFrame:
    """Directory companies whose slug is not yet known under a probed vendor."""
    slugs = known.filter(F.col("ats_type").isin("greenhouse", "ashby", "lever")).select("slug")
    return (
        directory.withColumn("slug", slugify(F.col("slug")))
        .filter(F.col("slug") != "").join(slugs, "slug", "left_anti")
    )


def accept_probes(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """Accepted probe answers: the list vendor first, then the array vendor."""
    ok = F.col("status_code").between(200, 299)
    jobs = F.get_json_object("body", "$.jobs")
    hit = (F.when((F.col("ats_type") == "greenhouse") & ok & jobs.isNotNull(), 1)
           .when((F.col("ats_type") == "lever") & ok
                 & F.from_json("body", "array<string>").isNotNull()
                 & F.ltrim("body").startswith("["), 2))
    best = (
        probes.withColumn("rank", hit).filter("rank is not null")
        .groupBy("slug").agg(F.min_by("ats_type", "rank").alias("ats_type"))
    )
    return candidates.join(best, "slug").select(
        "ats_type", "slug", "name", board_api_url(F.col("ats_type"), F.col("slug")).alias("ats_url"),
        F.lit("yc").alias("source_type"),
        F.concat(F.lit("yc-probe:"), F.coalesce(F.nullif("batch", F.lit("")), F.lit("unknown"))
                 ).alias("source_detail"),
        F.lit("probe").alias("doc"), F.col("record_no").cast("bigint").alias("line_no"),
        F.lit(0).cast("bigint").alias("pos"))


def from_fragments(fragments: DataFrame) -> DataFrame:
    """Code-search fragments; the detail is the query's first word."""
    lines = fragments.select(F.split("query", " ")[0].alias("doc"),
                             F.col("fragment_no").cast("bigint").alias("line_no"),
                             F.col("text").alias("line"))
    found = _exploded(lines, F.col("line"), "text")
    return _output(found, F.col("board.slug"), "github",
                   F.concat(F.lit("code-search:"), F.col("doc")))


def crawl_lines(lines: DataFrame) -> DataFrame:
    """Crawl lines with their URL, wildcard pattern and parsed board."""
    url = F.from_json("line", "url string")["url"]
    return lines.withColumn("url", url).withColumn("pattern", crawl_pattern(F.col("url"))) \
        .withColumn("board", parse_board_url(F.col("url")))


# Registry with one output schema.
@dataclass(frozen=True)
class DiscoverySource:
    """A way to find companies: the tables that it reads, by name, and the extractor over them.

    Every extractor returns the columns of ``schemas.DISCOVERY`` with the reading order.
    """

    inputs: tuple[str, ...]
    extract: Callable[..., DataFrame]

    def discover(self, tables: Callable[[str], DataFrame], **options) -> DataFrame:
        """The discoveries in the tables that ``tables`` gives by name."""
        return self.extract(*[tables(n) for n in self.inputs], **options)


def _accepted(directory: DataFrame, known: DataFrame, answers: DataFrame) -> DataFrame:
    return accept_probes(probe_candidates(directory, known), answers)


#: All sources, by name; ``threads`` takes the time up to which it looks (``now``).
SOURCES: dict[str, DiscoverySource] = {
    "markdown": DiscoverySource(("list_lines",), from_markdown),
    "readme": DiscoverySource(("list_lines",), from_readme),
    "url_list": DiscoverySource(("list_lines",), from_url_list),
    "company_json": DiscoverySource(("json_docs",), from_company_json),
    "crawl_jsonl": DiscoverySource(("crawl_jsonl",), from_crawl_jsonl),
    "cdx": DiscoverySource(("cdx_lines",), from_cdx),
    "directory": DiscoverySource(("directory",), from_directory),
    "probes": DiscoverySource(("directory", "companies", "probe_answers"), _accepted),
    "threads": DiscoverySource(("threads", "comments"), from_threads),
    "fragments": DiscoverySource(("fragments",), from_fragments),
}


def discover_all(tables: Callable[[str], DataFrame], options: dict[str, dict] | None = None,
                 names: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of all sources (or those of ``names``), with ``extractor``, in one schema."""
    parts = [SOURCES[n].discover(tables, **(options or {}).get(n, {})).withColumn("extractor", F.lit(n))
             for n in (names or SOURCES)]
    return reduce(DataFrame.unionByName, parts)
