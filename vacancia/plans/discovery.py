"""Discovery queries: URL parsing, extractors, merging and source metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.functions import urls
from vacancia.functions.core import with_present
from vacancia.operators import dedup, monitoring
from vacancia.plans.domain import ctes, view
from vacancia.plans.registry import Registry, scratch
from vacancia.sources import discovery as src
from vacancia.sources.blocks import index_lines, write_blocks

discovery = Registry()

_SUB = r"regexp_extract({u}, '(?i)(?:^|[^a-z0-9_-])([a-z0-9_-]+)\.workable\.com', 1)"
_HOSTS = [("greenhouse", r"boards\.greenhouse\.io"), ("lever", r"jobs\.lever\.co"),
          ("ashby", r"jobs\.ashbyhq\.com"), ("workable", r"apply\.workable\.com")]


def ats_sql(u: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({u}, '(?i){h}/[a-z0-9_-]') THEN '{a}'" for a, h in _HOSTS)
    sub = _SUB.replace("{u}", u)
    return f"CASE {arms} WHEN {sub} NOT IN ('', 'apply', 'www') THEN 'workable' END"


def slug_sql(u: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({u}, '(?i){h}/[a-z0-9_-]') "
                    f"THEN regexp_extract({u}, '(?i){h}/([a-z0-9_-]+)', 1)" for _, h in _HOSTS)
    return f"lower(CASE {arms} ELSE {_SUB.replace('{u}', u)} END)"


_API = """CASE ats_type WHEN 'greenhouse' THEN
 concat('https://boards-api.greenhouse.io/v1/boards/', slug, '/jobs')
 WHEN 'lever' THEN concat('https://api.lever.co/v0/postings/', slug)
 WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/api/non-user-graphql'
 ELSE concat('https://apply.workable.com/api/v1/widget/accounts/', slug) END"""

_CLASS = {"markdown": r"[^\s)>\]]+", "list": r"""[^\s)>\]"'']+""", "text": r"""[^\s)>\]"''`,]+""",
          "thread": r"""[^\s<)>\]"''`,]+"""}


def hits_sql(source: str, text: str, variant: str) -> str:
    """Board URLs of ``source`` with (u, pos, ats_type, slug)."""
    strip = "u0" if variant in ("markdown", "list") else r"regexp_replace(u0, '[.)]+$', '')"
    return f"""(SELECT * FROM (SELECT *, {ats_sql('u')} AS ats_type, {slug_sql('u')} AS slug
 FROM (SELECT *, {strip} AS u FROM (SELECT *, unnest(us) AS u0,
   CAST(generate_subscripts(us, 1) - 1 AS BIGINT) AS pos
   FROM (SELECT *, regexp_extract_all({text}, 'https?://{_CLASS[variant]}') AS us
         FROM {source})))) WHERE ats_type IS NOT NULL)"""


def first_sql(rows: str, order: str, cols: str) -> str:
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY ats_type, slug "
            f"ORDER BY {order}) AS rn FROM ({rows})) WHERE rn = 1")


COLS = "ats_type, slug, name, ats_url, source_type, source_detail"
ORDER = "doc, line_no, pos"


def _first(df):
    return dedup.dedup_first(df).select(*COLS.split(", "))


@discovery.add("p1_parse_board_url", ctes("links") + f"""
SELECT n, ats_type, slug, CASE WHEN ats_type IS NOT NULL THEN {_API} END AS ats_url
FROM (SELECT n, {ats_sql('link')} AS ats_type, CASE WHEN {ats_sql('link')} IS NOT NULL THEN
      {slug_sql('link')} END AS slug FROM links)""")
def _(spark, sf):
    return view(spark, sf, "links").select("n", urls.parse_board_url(F.col("link")).alias("b")) \
        .select("n", "b.ats_type", "b.slug", "b.ats_url")


@discovery.add("p23_crawl_pattern", ctes("links") + r"""
SELECT n, CASE WHEN host = 'boards.greenhouse.io' THEN 'boards.greenhouse.io/*'
  WHEN host = 'boards-api.greenhouse.io' THEN 'boards-api.greenhouse.io/*'
  WHEN host = 'jobs.lever.co' AND path <> '' THEN 'jobs.lever.co/*'
  WHEN host = 'jobs.ashbyhq.com' THEN 'jobs.ashbyhq.com/*'
  WHEN host LIKE '%.workable.com' AND path LIKE '/j/%' THEN '*.workable.com/j/*'
  WHEN host LIKE '%.workable.com' AND path LIKE '/jobs/%' THEN '*.workable.com/jobs/*' END AS pattern
FROM (SELECT n, lower(regexp_extract(link, '//([^/?#]+)', 1)) AS host,
             regexp_extract(link, '//[^/?#]+([^?#]*)', 1) AS path FROM links)""")
def _(spark, sf):
    return view(spark, sf, "links").select("n", urls.crawl_pattern(F.col("link")).alias("pattern"))


def _urls_sql(variant: str, chars: str) -> str:
    url = "u0" if variant in ("markdown", "list") else "regexp_replace(u0, '[.)]+$', '')"
    return f"""SELECT '{variant}' AS variant, line_no, pos, {url} AS url FROM (SELECT *,
 unnest(us) AS u0, CAST(generate_subscripts(us, 1) - 1 AS BIGINT) AS pos FROM (SELECT *,
 regexp_extract_all(line, 'https?://{chars}') AS us FROM list_lines))"""


@discovery.add("f4_extract_urls", ctes("list_lines") + " UNION ALL ".join(
    _urls_sql(v, c) for v, c in _CLASS.items()))
def _(spark, sf):
    lines, out = view(spark, sf, "list_lines"), None
    for variant in _CLASS:
        part = lines.select(F.lit(variant).alias("variant"), "line_no", F.posexplode(
            urls.extract_urls(F.col("line"), variant)).alias("pos", "url"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("pos", F.col("pos").cast("bigint"))


_MD = (f"SELECT ats_type, slug, coalesce(nullif(regexp_extract(line, '\\|\\s*\\[([^\\]]+)\\]', 1), ''), "
       f"slug) AS name, {_API} AS ats_url, 'oss_list' AS source_type, doc AS source_detail, doc, "
       f"line_no, 0 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY doc, line_no ORDER BY pos) "
       f"AS k FROM {hits_sql('list_lines', 'line', 'markdown')} WHERE contains(line, '|')) WHERE k = 1")


@discovery.add("s9_markdown_companies", ctes("list_lines") + first_sql(_MD, ORDER, COLS))
def _(spark, sf):
    return _first(src.from_markdown(view(spark, sf, "list_lines")))


_README = (f"SELECT ats_type, slug, coalesce(nullif(trim(regexp_extract(line, "
           f"'\\|\\s*(?:\\*\\*)?(?:<img[^>]*>)?\\s*\\[?([^\\]|*<\\n]+)', 1)), ''), slug) AS name, "
           f"{_API} AS ats_url, 'oss_list' AS source_type, doc AS source_detail, doc, line_no, pos "
           f"FROM {hits_sql('list_lines', 'line', 'text')}")


@discovery.add("s12_readme_companies", ctes("list_lines") + first_sql(_README, ORDER, COLS))
def _(spark, sf):
    return _first(src.from_readme(view(spark, sf, "list_lines")))


_LIST = (f"SELECT ats_type, slug, slug AS name, {_API} AS ats_url, 'oss_list' AS source_type, "
         f"doc AS source_detail, doc, line_no, pos FROM {hits_sql('list_lines', 'line', 'list')}")


@discovery.add("s11_url_list", ctes("list_lines") + first_sql(_LIST, ORDER, COLS))
def _(spark, sf):
    return _first(src.from_url_list(view(spark, sf, "list_lines")))


_JSON = """SELECT x->>'$.ats_type' AS ats_type, x->>'$.slug' AS slug,
 coalesce(nullif(x->>'$.name', ''), x->>'$.slug') AS name, x->>'$.ats_url' AS ats_url,
 'oss_list' AS source_type, doc AS source_detail, doc, 0 AS line_no, pos
FROM (SELECT doc, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM
 (SELECT doc, CASE WHEN json_type(TRY_CAST(text AS JSON)) = 'ARRAY'
              THEN CAST(TRY_CAST(text AS JSON) AS JSON[]) END AS xs FROM json_docs))
WHERE nullif(x->>'$.slug', '') IS NOT NULL AND nullif(x->>'$.ats_url', '') IS NOT NULL
  AND x->>'$.ats_type' IN ('greenhouse', 'lever', 'ashby', 'workable')"""


@discovery.add("s10_company_json", ctes("json_docs") + first_sql(_JSON, ORDER, COLS))
def _(spark, sf):
    return _first(src.from_company_json(view(spark, sf, "json_docs")))


_CRAWL = f"""SELECT ats_type, slug, slug AS name, CASE WHEN explicit THEN link ELSE {_API} END AS ats_url,
 CASE WHEN NOT explicit THEN 'common_crawl' WHEN source LIKE 'github:%' THEN 'github'
      WHEN source = 'common_crawl' THEN 'common_crawl' ELSE 'oss_list' END AS source_type,
 CASE WHEN explicit THEN coalesce(nullif(source, ''), 'discovery')
      ELSE coalesce(nullif(collection, ''), 'CC-MAIN') END AS source_detail, doc, line_no, 0 AS pos
FROM (SELECT *, CASE WHEN explicit THEN j->>'$.ats_type' ELSE {ats_sql('url')} END AS ats_type,
        CASE WHEN explicit THEN j->>'$.slug' ELSE {slug_sql('url')} END AS slug
 FROM (SELECT *, j->>'$.source' AS source, j->>'$.collection' AS collection, j->>'$.url' AS url,
   coalesce(nullif(j->>'$.ats_url', ''), nullif(j->>'$.url', '')) AS link,
   coalesce(nullif(j->>'$.slug', ''), '') <> '' AND coalesce(nullif(j->>'$.ats_type', ''), '') <> ''
     AND coalesce(nullif(j->>'$.ats_url', ''), nullif(j->>'$.url', '')) IS NOT NULL AS explicit
  FROM (SELECT *, TRY_CAST(trim(line) AS JSON) AS j FROM crawl_jsonl))) WHERE ats_type IS NOT NULL"""


@discovery.add("s13_crawl_jsonl", ctes("crawl_jsonl") + first_sql(_CRAWL, ORDER, COLS))
def _(spark, sf):
    return _first(src.from_crawl_jsonl(view(spark, sf, "crawl_jsonl")))


_CDX = f"""SELECT *, slug AS name, url AS ats_url, 'common_crawl' AS source_type,
 'cc-direct-cdx' AS source_detail, 0 AS pos FROM (SELECT doc, line_no, url, {ats_sql('url')} AS ats_type,
 {slug_sql('url')} AS slug FROM (SELECT *, TRY_CAST(substr(line, strpos(line, '{{')) AS JSON)->>'$.url'
 AS url FROM cdx_lines WHERE contains(line, '{{'))) WHERE ats_type IS NOT NULL"""


@discovery.add("s14_cdx_lines", ctes("cdx_lines") + first_sql(_CDX, ORDER, COLS))
def _(spark, sf):
    return _first(src.from_cdx(view(spark, sf, "cdx_lines")))


_PREFIX = """CASE WHEN starts_with(surt, 'io,greenhouse,boards)') THEN 'io,greenhouse,boards)'
 WHEN starts_with(surt, 'com,ashbyhq,jobs)') THEN 'com,ashbyhq,jobs)'
 WHEN starts_with(surt, 'com,workable,apply)') THEN 'com,workable,apply)'
 WHEN starts_with(surt, 'co,lever,jobs)') THEN 'co,lever,jobs)' END"""
_BLOCKS = f""", blocks AS (SELECT doc, p[1] AS surt, p[2] AS shard, CAST(p[3] AS BIGINT) AS "offset",
 CAST(p[4] AS BIGINT) AS length FROM (SELECT doc, string_split(line, chr(9)) AS p FROM index_lines)
 WHERE len(p) >= 4), direct AS (SELECT *, {_PREFIX} AS surt_prefix FROM blocks
 WHERE {_PREFIX} IS NOT NULL)"""


@discovery.add("s15_cluster_blocks", ctes("index_lines") + _BLOCKS + """
SELECT surt_prefix, count(*) AS blocks, CAST(sum(length) AS BIGINT) AS bytes, CAST(sum("offset") AS BIGINT) AS offsets
FROM direct GROUP BY surt_prefix""")
def _(spark, sf):
    return src.cluster_blocks(view(spark, sf, "index_lines")).groupBy("surt_prefix").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("length").alias("bytes"),
        F.sum("offset").alias("offsets"))


@discovery.add("s15_cluster_blocks_preceding", ctes("index_lines") + _BLOCKS + """
SELECT doc, surt_prefix, surt, shard, "offset", length FROM direct UNION ALL
SELECT doc, prefix, surt, shard, "offset", length FROM (SELECT b.*, prefix, row_number() OVER
 (PARTITION BY doc, prefix ORDER BY surt DESC, shard DESC, "offset" DESC) AS rn FROM blocks b
 JOIN (VALUES ('io,greenhouse,boards)'), ('com,ashbyhq,jobs)'), ('com,workable,apply)'),
 ('co,lever,jobs)')) AS t(prefix) ON b.surt < t.prefix) WHERE rn = 1""")
def _(spark, sf):
    return src.cluster_blocks(view(spark, sf, "index_lines"), include_preceding=True).select(
        "doc", "surt_prefix", "surt", "shard", "offset", "length")


_PREFIXES = "('io,greenhouse,boards)'), ('com,ashbyhq,jobs)'), ('com,workable,apply)'), ('co,lever,jobs)')"
_INDEXED = f"""SELECT *, slug AS name, url AS ats_url, 'common_crawl' AS source_type, 'cc-direct-cdx' AS source_detail,
 '' AS doc, row_number() OVER (ORDER BY surt, line) AS line_no, 0 AS pos
FROM (SELECT surt, line, url, {ats_sql('url')} AS ats_type, {slug_sql('url')} AS slug
 FROM (SELECT surt, line, CAST(substr(line, strpos(line, '{{')) AS JSON)->>'$.url' AS url FROM crawl_lines
  WHERE EXISTS (SELECT 1 FROM (VALUES {_PREFIXES}) AS t(prefix) WHERE starts_with(surt, prefix))))
WHERE ats_type IS NOT NULL"""


@discovery.add("s14_indexed_blocks", ctes("crawl_lines") + first_sql(_INDEXED, ORDER, COLS))
def _(spark, sf):
    """Shards and an index written from the crawl lines; only the blocks that hold a vendor's keys are read."""
    folder = scratch(spark, "shards")
    index = write_blocks(view(spark, sf, "crawl_lines").select("surt", "line"), folder, lines_per_block=25)
    return _first(src.from_index(spark, index_lines(index), folder))


_NOW = "TIMESTAMP '2024-06-01 00:00:00'"
_THREAD = (f"SELECT ats_type, slug, slug AS name, {_API} AS ats_url, 'hn' AS source_type, "
           f"concat('whos-hiring:', thread_id) AS source_detail, CAST(thread_id AS VARCHAR) AS doc, "
           f"comment_no AS line_no, pos FROM "
           + hits_sql("(SELECT c.*, regexp_replace(comment_html, '<[^>]+>', ' ', 'g') AS line FROM "
                      "comments c WHERE thread_id IN (SELECT thread_id FROM threads WHERE "
                      "contains(lower(title), 'who is hiring') AND NOT contains(lower(title), "
                      f"'who wants') AND created_at > {_NOW} - INTERVAL 360 DAY))", "line", "thread"))


@discovery.add("s16_hiring_threads", ctes("threads", "comments") + first_sql(_THREAD, ORDER, COLS))
def _(spark, sf):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return _first(src.from_threads(view(spark, sf, "threads"), view(spark, sf, "comments"), now))


_DIR = (f"SELECT ats_type, slug, name, {_API} AS ats_url, 'yc' AS source_type, concat('yc:', "
        f"coalesce(nullif(batch, ''), 'unknown')) AS source_detail, 'directory' AS doc, record_no AS "
        f"line_no, pos FROM " + hits_sql(
            "(SELECT name, batch, record_no, concat_ws(' ', nullif(website, ''), "
            "nullif(long_description, ''), nullif(one_liner, '')) AS line FROM directory)",
            "line", "text"))


@discovery.add("s17_directory_records", ctes("directory") + first_sql(_DIR, ORDER, COLS))
def _(spark, sf):
    return _first(src.from_directory(view(spark, sf, "directory")))


_CAND = """, cand AS (SELECT record_no, name, batch, s AS slug FROM (SELECT *,
 regexp_replace(lower(slug), '[^a-z0-9-]', '', 'g') AS s FROM directory) WHERE s <> '' AND s NOT IN
 (SELECT slug FROM companies WHERE ats_type IN ('greenhouse', 'ashby', 'lever')))"""


@discovery.add("s18_probe_candidates", ctes("directory", "companies") + _CAND +
               "SELECT record_no, name, slug FROM cand")
def _(spark, sf):
    return src.probe_candidates(view(spark, sf, "directory"), view(spark, sf, "companies")).select(
        "record_no", "name", "slug")


@discovery.add("s18_accept_probes", ctes("directory", "companies", "probe_answers") + _CAND + f""",
 hit AS (SELECT slug, min(CASE WHEN ats_type = 'greenhouse' THEN 1 ELSE 2 END) AS rk
  FROM probe_answers WHERE status_code BETWEEN 200 AND 299 AND CASE ats_type WHEN 'greenhouse'
   THEN json_type(TRY_CAST(body AS JSON), '$.jobs') IS NOT NULL
   ELSE json_type(TRY_CAST(body AS JSON)) = 'ARRAY' END GROUP BY slug)
SELECT ats_type, slug, name, {_API} AS ats_url, concat('yc-probe:', coalesce(batch, 'unknown'))
 AS source_detail FROM (SELECT c.*, CASE rk WHEN 1 THEN 'greenhouse' ELSE 'lever' END AS ats_type
 FROM cand c JOIN hit USING (slug))""")
def _(spark, sf):
    cand = src.probe_candidates(view(spark, sf, "directory"), view(spark, sf, "companies"))
    return src.accept_probes(cand, view(spark, sf, "probe_answers")).select(
        "ats_type", "slug", "name", "ats_url", "source_detail")


_FRAG = (f"SELECT ats_type, slug, slug AS name, {_API} AS ats_url, 'github' AS source_type, "
         f"concat('code-search:', q) AS source_detail, q AS doc, fragment_no AS line_no, pos FROM "
         + hits_sql("(SELECT *, string_split(query, ' ')[1] AS q, text AS line FROM fragments)",
                    "line", "text"))


@discovery.add("s19_code_fragments", ctes("fragments") + first_sql(_FRAG, ORDER, COLS))
def _(spark, sf):
    return _first(src.from_fragments(view(spark, sf, "fragments")))


def _all_sources(spark, sf):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return [src.from_markdown(view(spark, sf, "list_lines")),
            src.from_fragments(view(spark, sf, "fragments")),
            src.from_directory(view(spark, sf, "directory")),
            src.from_threads(view(spark, sf, "threads"), view(spark, sf, "comments"), now),
            src.from_cdx(view(spark, sf, "cdx_lines"))]


_SOURCES = ctes("list_lines", "fragments", "directory", "threads", "comments", "cdx_lines") \
    + ", found AS (" + " UNION ALL ".join(
        f"SELECT {i} AS precedence, {COLS}, doc, line_no, pos FROM ({q})"
        for i, q in enumerate((_MD, _FRAG, _DIR, _THREAD, _CDX))) + ")"


@discovery.add("u5_dedup_first", ctes("list_lines") + first_sql(_LIST, ORDER,
                                                               "ats_type, slug, doc, line_no, pos"))
def _(spark, sf):
    return dedup.dedup_first(src.from_url_list(view(spark, sf, "list_lines"))).select(
        "ats_type", "slug", "doc", "line_no", "pos")


@discovery.add("u6_merge_sources", _SOURCES + first_sql("SELECT * FROM found",
                                                        "precedence, " + ORDER, COLS))
def _(spark, sf):
    return dedup.merge_sources(_all_sources(spark, sf)).select(*COLS.split(", "))


@discovery.add("u6_new_per_source", _SOURCES + """
SELECT source_type, count(*) AS found, count(*) FILTER (WHERE p = best) AS new FROM
 (SELECT *, min(p) OVER (PARTITION BY ats_type, slug) AS best FROM (SELECT ats_type, slug,
  source_type, min(precedence) AS p FROM found GROUP BY ALL)) GROUP BY source_type""")
def _(spark, sf):
    return dedup.new_per_source(_all_sources(spark, sf))


@discovery.add("o1_union_sources", _SOURCES + """
SELECT precedence, source_type, count(*) AS n FROM found GROUP BY ALL""")
def _(spark, sf):
    return dedup.union_sources(_all_sources(spark, sf)).groupBy("precedence", "source_type").agg(
        F.count(F.lit(1)).alias("n"))


_PROBED = f"""SELECT ats_type, slug, name, {_API} AS ats_url, 'yc' AS source_type,
 concat('yc-probe:', coalesce(nullif(batch, ''), 'unknown')) AS source_detail, 'probe' AS doc, record_no AS line_no, 0 AS pos
FROM (SELECT c.*, CASE rk WHEN 1 THEN 'greenhouse' ELSE 'lever' END AS ats_type FROM cand c JOIN
 (SELECT slug, min(CASE WHEN ats_type = 'greenhouse' THEN 1 ELSE 2 END) AS rk
  FROM probe_answers WHERE status_code BETWEEN 200 AND 299 AND CASE ats_type WHEN 'greenhouse'
   THEN json_type(TRY_CAST(body AS JSON), '$.jobs') IS NOT NULL
   ELSE json_type(TRY_CAST(body AS JSON)) = 'ARRAY' END GROUP BY slug) USING (slug))"""
_ROWS = {"markdown": _MD, "readme": _README, "url_list": _LIST, "company_json": _JSON, "crawl_jsonl": _CRAWL, "cdx": _CDX,
         "directory": _DIR, "probes": _PROBED, "threads": _THREAD, "fragments": _FRAG}


@discovery.add("x2_extractor_registry", ctes(
    "list_lines", "json_docs", "crawl_jsonl", "cdx_lines", "directory", "companies", "probe_answers", "threads", "comments",
    "fragments").rstrip() + _CAND + " UNION ALL ".join(
    f"SELECT '{n}' AS extractor, {COLS}, doc, CAST(line_no AS BIGINT) AS line_no, CAST(pos AS BIGINT) AS pos FROM ({q})"
    for n, q in _ROWS.items()))
def _(spark, sf):
    """The rows of every registered source over its own tables, in the registry's one schema."""
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return src.discover_all(lambda n: view(spark, sf, n), {"threads": {"now": now}}).select(
        "extractor", *COLS.split(", "), "doc", "line_no", "pos")


@discovery.add("a16_crawl_report", ctes("cdx_lines") + f""", l AS (SELECT line, u,
   page, pattern, CASE WHEN {ats_sql('u')} IS NOT NULL THEN {ats_sql('u')} END AS ats_type,
   {slug_sql('u')} AS slug, CASE pattern WHEN 'boards.greenhouse.io/*' THEN 0 WHEN 'jobs.lever.co/*'
   THEN 1 WHEN 'jobs.ashbyhq.com/*' THEN 2 ELSE 3 END AS pn FROM (SELECT line, u, page, CASE
   WHEN regexp_matches(u, '(?i)^https?://boards\\.greenhouse\\.io/') THEN 'boards.greenhouse.io/*'
   WHEN regexp_matches(u, '^https?://jobs\\.lever\\.co/') THEN 'jobs.lever.co/*'
   WHEN regexp_matches(u, '^https?://jobs\\.ashbyhq\\.com/') THEN 'jobs.ashbyhq.com/*'
   WHEN regexp_matches(u, '^https?://boards-api') THEN 'boards-api.greenhouse.io/*'
   WHEN regexp_matches(u, '(?i)^https?://[a-z0-9_.-]+\\.workable\\.com/j/') THEN '*.workable.com/j/*'
   WHEN regexp_matches(u, '(?i)^https?://[a-z0-9_.-]+\\.workable\\.com/jobs/')
     THEN '*.workable.com/jobs/*' END AS pattern
   FROM (SELECT line, j->>'$.url' AS u, CAST(j->>'$.page' AS BIGINT) AS page FROM
     (SELECT line, TRY_CAST(substr(line, strpos(line, '{{')) AS JSON) AS j FROM cdx_lines
      WHERE contains(line, '{{')))) WHERE pattern IS NOT NULL),
 f AS (SELECT pattern, count(*) AS new_slugs FROM (SELECT pattern, row_number() OVER (PARTITION BY
   ats_type, slug ORDER BY pn, pattern) AS rn FROM l WHERE ats_type IS NOT NULL) WHERE rn = 1
   GROUP BY pattern),
 r AS (SELECT pattern, count(DISTINCT page) AS pages, count(*) AS lines, sum(length(line)) AS bytes
   FROM l GROUP BY pattern),
 t AS (SELECT r.*, coalesce(new_slugs, 0) AS new_slugs FROM r LEFT JOIN f USING (pattern))
SELECT pattern, pages, lines, CAST(bytes AS BIGINT) AS bytes, new_slugs FROM t UNION ALL SELECT 'TOTAL',
 CAST(sum(pages) AS BIGINT), CAST(sum(lines) AS BIGINT), CAST(sum(bytes) AS BIGINT),
 CAST(sum(new_slugs) AS BIGINT) FROM t""")
def _(spark, sf):
    lines = view(spark, sf, "cdx_lines").filter(F.col("line").contains("{"))
    tail = F.substr("line", F.instr("line", "{").cast("int"))
    rows = with_present(lines, "e", F.from_json(tail, "url string, page bigint"))
    rows = with_present(rows, "pattern", urls.crawl_pattern(F.col("e.url")))
    number = (F.when(F.col("pattern") == "boards.greenhouse.io/*", 0)
              .when(F.col("pattern") == "jobs.lever.co/*", 1)
              .when(F.col("pattern") == "jobs.ashbyhq.com/*", 2).otherwise(3))
    b = urls.parse_board_url(F.col("e.url"))
    rows = rows.withColumn("b", b).select(
        "line", "pattern", "e.page", "b.ats_type", "b.slug",
        F.struct(number.alias("n"), "pattern").alias("pattern_no"))
    return monitoring.crawl_report(rows)


# --- source metrics over the company/source bridge ---

@discovery.add("a3_source_types", ctes("company_sources") +
               "SELECT DISTINCT source_type FROM company_sources")
def _(spark, sf):
    return monitoring.source_types(view(spark, sf, "company_sources"))


@discovery.add("o3_distinct_sources", ctes("company_sources") +
               "SELECT DISTINCT source_type, source_detail FROM company_sources")
def _(spark, sf):
    return view(spark, sf, "company_sources").select("source_type", "source_detail").distinct()


@discovery.add("a4_discovery_yield", ctes("company_sources") + """
SELECT source_type, count(DISTINCT company_id) AS "yield" FROM company_sources GROUP BY source_type""")
def _(spark, sf):
    return monitoring.source_metrics(view(spark, sf, "company_sources")).select("source_type", "yield")


@discovery.add("j7_unique_contribution", ctes("company_sources") + """
SELECT source_type, count(DISTINCT company_id) AS unique_contribution FROM company_sources a
WHERE NOT EXISTS (SELECT 1 FROM company_sources b WHERE b.company_id = a.company_id
                  AND b.source_type <> a.source_type) GROUP BY source_type""")
def _(spark, sf):
    return monitoring.source_metrics(view(spark, sf, "company_sources")).select(
        "source_type", "unique_contribution")


@discovery.add("j8_first_discovery_by", ctes("company_sources") + """
SELECT source_type, count(DISTINCT a.company_id) AS first_discovery FROM company_sources a
JOIN (SELECT company_id, min(discovered_at) AS m FROM company_sources GROUP BY company_id) b
  ON a.company_id = b.company_id AND a.discovered_at = b.m GROUP BY source_type""")
def _(spark, sf):
    return monitoring.source_metrics(view(spark, sf, "company_sources")).select(
        "source_type", "first_discovery")


@discovery.add("a5_source_metrics", ctes("company_sources") + """
, p AS (SELECT company_id, source_type, min(discovered_at) AS f FROM company_sources GROUP BY ALL),
 w AS (SELECT *, count(*) OVER (PARTITION BY company_id) AS k, min(f) OVER (PARTITION BY company_id)
       AS m FROM p)
SELECT source_type, count(*) AS "yield", count(*) FILTER (WHERE k = 1) AS unique_contribution,
       count(*) FILTER (WHERE f = m) AS first_discovery FROM w GROUP BY source_type""")
def _(spark, sf):
    return monitoring.source_metrics(view(spark, sf, "company_sources"))


@discovery.add("o4_source_overlap", ctes("company_sources") + """
, p AS (SELECT DISTINCT company_id, source_type FROM company_sources)
SELECT a.source_type AS source_a, b.source_type AS source_b, count(*) AS shared
FROM p a JOIN p b ON a.company_id = b.company_id AND a.source_type < b.source_type GROUP BY ALL""")
def _(spark, sf):
    return monitoring.source_overlap(view(spark, sf, "company_sources"))


@discovery.add("f5_slugify", """
SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9-]', '', 'g') AS slug FROM customer""")
def _(spark, sf):
    from vacancia.functions.text import slugify
    return view(spark, sf, "customer").select("c_custkey", slugify(F.col("c_name")).alias("slug"))
