"""Feed queries: payload normalisation, upserts, logs, sinks and data quality."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia import schemas
from vacancia.functions.urls import fix_placeholder_url
from vacancia.operators import dedup, upsert
from vacancia.plans.domain import ctes, results, table, view
from vacancia.plans.registry import Registry, ms, scratch
from vacancia.sources import boards, landing

feed = Registry()

NUMBER = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"


def _text(path: str) -> str:
    return f"json_type(x, '{path}') = 'VARCHAR'"


def _optional(path: str, nullable: bool = False) -> str:
    extra = ", 'NULL'" if nullable else ""
    return f"(json_type(x, '{path}') IS NULL OR json_type(x, '{path}') IN ('VARCHAR'{extra}))"


def _get(path: str) -> str:
    return f"json_extract_string(x, '{path}')"


# Oracle-side description of each vendor: array location, element test, fields.
VENDOR_SQL = {
    "greenhouse": dict(
        xs="CASE WHEN json_type(j, '$.jobs') = 'ARRAY' THEN CAST(j->'$.jobs' AS JSON[]) END",
        ok=f"json_type(x, '$.id') IN {NUMBER} AND {_text('$.title')} AND {_text('$.absolute_url')}"
           f" AND {_text('$.updated_at')} AND (json_type(x, '$.location') IS NULL OR "
           f"json_type(x, '$.location') = 'NULL' OR {_text('$.location.name')})",
        ext=_get("$.id"), title=_get("$.title"), url=_get("$.absolute_url"),
        location=_get("$.location.name"), department=_get("$.departments[0].name"),
        posted=f"coalesce({_get('$.first_published')}, {_get('$.updated_at')})",
        extra="$.content"),
    "lever": dict(
        xs="CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) END",
        ok=f"{_text('$.id')} AND {_text('$.text')} AND {_text('$.hostedUrl')} AND "
           f"json_type(x, '$.createdAt') IN {NUMBER} AND {_optional('$.categories.location')}",
        ext=_get("$.id"), title=_get("$.text"), url=_get("$.hostedUrl"),
        location=_get("$.categories.location"), department=_get("$.categories.department"),
        posted="strftime(make_timestamp_ms(CAST(json_extract_string(x, '$.createdAt') AS BIGINT)),"
               " '%Y-%m-%dT%H:%M:%S.%gZ')",
        extra="$.categories.team"),
    "ashby": dict(
        xs="CASE WHEN json_type(j, '$.data.jobBoard') = 'NULL' THEN CAST('[]' AS JSON[]) "
           "WHEN json_type(j, '$.data.jobBoard.jobPostings') = 'ARRAY' "
           "THEN CAST(j->'$.data.jobBoard.jobPostings' AS JSON[]) END",
        ok=f"{_text('$.id')} AND {_text('$.title')} AND {_text('$.locationName')} AND "
           f"{_optional('$.employmentType')} AND "
           f"{_optional('$.compensationTierSummary', True)}",
        ext=_get("$.id"), title=_get("$.title"),
        url=f"concat('https://jobs.ashbyhq.com/', slug, '/', {_get('$.id')})",
        location=_get("$.locationName"), department="CAST(NULL AS VARCHAR)",
        posted="CAST(NULL AS VARCHAR)", extra="$.extra.a[1]"),
    "workable": dict(
        xs="CASE WHEN json_type(j, '$.jobs') = 'ARRAY' THEN CAST(j->'$.jobs' AS JSON[]) END",
        ok=f"{_text('$.shortcode')} AND {_text('$.title')} AND {_text('$.url')} AND "
           f"{_optional('$.city', True)} AND {_optional('$.department', True)} AND "
           f"{_optional('$.published', True)}",
        ext=_get("$.shortcode"), title=_get("$.title"), url=_get("$.url"), location=_get("$.city"),
        department=_get("$.department"), posted=_get("$.published"), extra="$.published"),
}


def _checked_sql(ats: str) -> str:
    v = VENDOR_SQL[ats]
    return (f"SELECT *, xs IS NOT NULL AND len(list_filter(xs, lambda x: "
            f"NOT coalesce({v['ok']}, false))) = 0 AS conformant FROM (SELECT *, {v['xs']} AS xs "
            f"FROM (SELECT *, TRY_CAST(body AS JSON) AS j FROM payloads "
            f"WHERE ats_type = '{ats}'))")


def _normal_sql(ats: str) -> str:
    v = VENDOR_SQL[ats]
    return f"""SELECT fetch_id, ats_type, {v['ext']} AS external_id, {v['title']} AS title,
 {v['url']} AS url, {v['location']} AS location, {v['department']} AS department,
 {v['posted']} AS posted_raw, epoch_ms(CAST({v["posted"]} AS TIMESTAMPTZ)) AS posted_at_ms,
 json_extract_string(x, '{v['extra']}') AS raw_extra
FROM (SELECT *, unnest(xs) AS x FROM ({_checked_sql(ats)}) WHERE conformant)"""


def _normal_columns(df: DataFrame) -> DataFrame:
    extra = reduce(lambda acc, kv: acc.when(F.col("ats_type") == kv[0],
                                            F.get_json_object("raw_json", kv[1]["extra"])),
                   VENDOR_SQL.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    return df.select("fetch_id", "ats_type", "external_id", "title", "url", "location",
                     "department", "posted_raw", ms("posted_at"), extra.alias("raw_extra"))


def _register_vendor(number: int, ats: str) -> None:
    @feed.add(f"s{number}_normalize_{ats}", ctes("payloads") + _normal_sql(ats))
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return _normal_columns(boards.normalize_vendor(view(spark, sf, "payloads"), ats))


for _n, _ats in enumerate(VENDOR_SQL, start=2):
    _register_vendor(_n, _ats)


@feed.add("s7_normalize_postings",
          ctes("payloads") + " UNION ALL ".join(f"({_normal_sql(a)})" for a in VENDOR_SQL))
def _(spark, sf):
    return _normal_columns(boards.normalize_postings(view(spark, sf, "payloads")))


@feed.add("s1_landing_payloads", ctes("payloads") + """
SELECT ats_type, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars,
       count(*) FILTER (WHERE status_code = 200) AS ok FROM payloads GROUP BY ats_type""")
def _(spark, sf):
    path = scratch(spark, "landing")
    none = F.lit(None).cast("map<string,string>")
    view(spark, sf, "payloads").withColumn("headers", none).select(
        *[c.split()[0] for c in schemas.PAYLOAD.replace("map<string,string>", "m").split(", ")]
    ).write.partitionBy("ats_type").parquet(path)
    return landing.read_payloads(spark, path).groupBy("ats_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"),
        F.count_if(F.col("status_code") == 200).alias("ok"))


@feed.add("s6_placeholder_url", ctes("companies", "jobs") + """
SELECT j.job_id, concat('https://jobs.ashbyhq.com/', c.slug, '/', j.external_id) AS url
FROM jobs j JOIN companies c USING (company_id)""")
def _(spark, sf):
    jobs = view(spark, sf, "jobs").withColumn(
        "raw", F.concat(F.lit("https://jobs.ashbyhq.com/unknown/"), "external_id"))
    return jobs.join(view(spark, sf, "companies").select("company_id", "slug"), "company_id").select(
        "job_id", fix_placeholder_url(F.col("raw"), F.col("slug")).alias("url"))


@feed.add("s8_board_request", ctes("companies") + """
SELECT company_id,
  CASE ats_type WHEN 'greenhouse'
       THEN concat('https://boards-api.greenhouse.io/v1/boards/', slug, '/jobs?content=true')
  WHEN 'lever' THEN concat('https://api.lever.co/v0/postings/', slug)
  WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/api/non-user-graphql'
  ELSE concat('https://apply.workable.com/api/v1/widget/accounts/', slug) END AS url,
  CASE WHEN ats_type = 'ashby' THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN ats_type = 'ashby' THEN slug END AS page_name FROM companies""")
def _(spark, sf):
    return boards.board_request(view(spark, sf, "companies")).select(
        "company_id", "url", "method", F.get_json_object(
            "body", "$.variables.organizationHostedJobsPageName").alias("page_name"))


_CONFORM = " UNION ALL ".join(
    f"SELECT ats_type, company_id, fetch_id, status_code, aborted, xs, conformant "
    f"FROM ({_checked_sql(a)})" for a in VENDOR_SQL)


@feed.add("a17_schema_conformance", ctes("payloads") + f"""
SELECT ats_type, round(avg(CAST(conformant AS INT)), 6) AS conformance,
       count(*) FILTER (WHERE NOT conformant) AS quarantined FROM ({_CONFORM}) GROUP BY ats_type""")
def _(spark, sf):
    return boards.payload_conformance(view(spark, sf, "payloads")).groupBy("ats_type").agg(
        F.round(F.avg(F.col("conformant").cast("int")), 6).alias("conformance"),
        F.count_if(~F.col("conformant")).alias("quarantined"))


@feed.add("p22_poll_status", ctes("payloads") + f"""
SELECT fetch_id, CASE WHEN aborted THEN 'timeout'
    WHEN status_code BETWEEN 200 AND 299 AND conformant THEN 'success' ELSE 'error' END AS status,
  CASE WHEN NOT aborted AND status_code BETWEEN 200 AND 299 AND conformant THEN len(xs) END
    AS jobs_found FROM ({_CONFORM})""")
def _(spark, sf):
    p = view(spark, sf, "payloads").withColumn("company_id", F.col("fetch_id"))
    return boards.poll_outcomes(p).select(F.col("company_id").alias("fetch_id"), "status", "jobs_found")


@feed.add("p14_throttle_signal", """
SELECT event_id, event_id % 5 = 0 OR event_id % 7 = 0 AS throttled FROM events""")
def _(spark, sf):
    empty = F.create_map().cast("map<string,string>")
    headers = (F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("retry-after"), F.lit("3")))
               .when(F.col("event_id") % 7 == 0,
                     F.create_map(F.lit("x-ratelimit-remaining"), F.lit("0")))
               .when(F.col("event_id") % 2 == 0,
                     F.create_map(F.lit("x-ratelimit-remaining"), F.lit("9"))).otherwise(empty))
    return table(spark, sf, "events").select(
        "event_id", boards.throttle_signal(headers).alias("throttled"))


@feed.add("x1_adapter_registry", ctes("payloads") + f"""
SELECT ats_type, count(*) AS postings FROM ({' UNION ALL '.join(
    f"SELECT ats_type, unnest(xs) AS x FROM ({_checked_sql(a)}) WHERE conformant"
    for a in VENDOR_SQL)}) GROUP BY ats_type""")
def _(spark, sf):
    return boards.normalize_postings(view(spark, sf, "payloads")).groupBy("ats_type").agg(
        F.count(F.lit(1)).alias("postings"))


# --- upserts ---

JOB_COLUMNS = ["company_id", "external_id", "title", "url", "location", "department",
               "ats_posted_at", "first_seen_at", "updated_at"]


def _snapshots(spark, sf):
    old = view(spark, sf, "jobs").select(*JOB_COLUMNS)
    new = view(spark, sf, "refetches").select(*JOB_COLUMNS, "seq")
    return old, new


_ALL_JOBS = """, u AS (
 SELECT company_id, external_id, title, url, location, department, ats_posted_at, first_seen_at,
        updated_at, -1 AS seq, 1 AS old FROM jobs
 UNION ALL SELECT company_id, external_id, title, url, location, department, ats_posted_at,
        first_seen_at, updated_at, seq, 0 FROM refetches),
 last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, external_id
        ORDER BY updated_at DESC, old ASC, seq DESC) AS rn FROM u) WHERE rn = 1),
 firsts AS (SELECT company_id, external_id, max(old) AS had,
        coalesce(min(CASE WHEN old = 1 THEN first_seen_at END), min(first_seen_at)) AS seen
        FROM u GROUP BY ALL)
"""


@feed.add("u2_upsert_jobs", ctes("jobs", "refetches") + _ALL_JOBS + """
SELECT company_id, external_id, title, url, location, department,
       epoch_ms(updated_at) AS updated_at_ms, epoch_ms(seen) AS first_seen_at_ms, had = 0 AS is_new
FROM last JOIN firsts USING (company_id, external_id)""")
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    return upsert.upsert_jobs(old, new).select(
        "company_id", "external_id", "title", "url", "location", "department", ms("updated_at"),
        ms("first_seen_at"), "is_new")


@feed.add("u2_upsert_jobs_delta", feed.oracles["u2_upsert_jobs"])
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    return upsert.upsert_jobs_delta(old, new).select(
        "company_id", "external_id", "title", "url", "location", "department", ms("updated_at"),
        ms("first_seen_at"), "is_new")


@feed.add("u9_repost_separation", ctes("jobs") + """
SELECT company_id, title, count(DISTINCT external_id) AS postings FROM jobs
GROUP BY company_id, title HAVING count(DISTINCT external_id) > 1""")
def _(spark, sf):
    old, _new = _snapshots(spark, sf)
    return upsert.upsert_jobs(None, old).groupBy("company_id", "title").agg(
        F.count(F.lit(1)).alias("postings")).filter("postings > 1")


@feed.add("a19_dedup_rate", ctes("refetches") + """
SELECT (SELECT count(*) FROM (SELECT DISTINCT company_id, external_id FROM
          (SELECT * FROM refetches UNION ALL SELECT * FROM refetches)))
     - (SELECT count(*) FROM (SELECT DISTINCT company_id, external_id FROM refetches))
       AS dedup_rate""")
def _(spark, sf):
    _old, new = _snapshots(spark, sf)
    once = upsert.upsert_jobs(None, new).drop("is_new")
    return upsert.rows_added(once, upsert.upsert_jobs(once, new))


@feed.add("a20_first_seen_immutability", ctes("jobs", "refetches") + _ALL_JOBS + """
SELECT count(*) FILTER (WHERE j.first_seen_at <> f.seen) AS violations
FROM jobs j JOIN firsts f USING (company_id, external_id)""")
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    return upsert.first_seen_violations(old, upsert.upsert_jobs(old, new))


@feed.add("a18_field_population", ctes("jobs") + """, s AS (
SELECT avg(CAST(coalesce(title <> '', false) AS INT)) AS title,
       avg(CAST(coalesce(url <> '', false) AS INT)) AS url,
       avg(CAST(coalesce(external_id <> '', false) AS INT)) AS external_id,
       avg(CAST(ats_posted_at IS NOT NULL AS INT)) AS ats_posted_at FROM jobs)
SELECT field, round(ratio, 6) AS ratio FROM s
UNPIVOT (ratio FOR field IN (title, url, external_id, ats_posted_at))""")
def _(spark, sf):
    return upsert.field_population(
        view(spark, sf, "jobs"), ["title", "url", "external_id"], ["ats_posted_at"]
    ).select("field", F.round("ratio", 6).alias("ratio"))


_SIGHTINGS = """, found AS (
 SELECT c.ats_type, c.slug, j.title AS name, j.url AS ats_url, j.first_seen_at AS seen_at,
        j.job_id AS seq, coalesce(j.department, 'none') AS source_type,
        coalesce(j.location, 'none') AS source_detail
 FROM jobs j JOIN companies c USING (company_id))
"""


def _sightings(spark, sf):
    jobs, comp = view(spark, sf, "jobs"), view(spark, sf, "companies")
    none = F.lit("none")
    return jobs.join(comp.select("company_id", "ats_type", "slug"), "company_id").select(
        "ats_type", "slug", F.col("title").alias("name"), F.col("url").alias("ats_url"),
        F.col("first_seen_at").alias("seen_at"), F.col("job_id").alias("seq"),
        F.coalesce("department", none).alias("source_type"),
        F.coalesce("location", none).alias("source_detail"))


_DISCOVERED = _SIGHTINGS + """, u AS (
 SELECT ats_type, slug, name, ats_url, discovered_at AS seen, -1 AS seq, 0 AS fresh,
        consecutive_failures AS cf FROM companies
 UNION ALL SELECT ats_type, slug, name, ats_url, seen_at, seq, 1, 0 FROM found),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ats_type, slug
       ORDER BY fresh, seen, seq) AS rn FROM u) WHERE rn = 1),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ats_type, slug
       ORDER BY fresh DESC, seen DESC, seq DESC) AS rn FROM u) WHERE rn = 1)
"""


@feed.add("u1_discover_companies", ctes("jobs", "companies") + _DISCOVERED + """
SELECT a.ats_type, a.slug, a.name, b.ats_url, epoch_ms(a.seen) AS discovered_at_ms,
       a.cf AS consecutive_failures, a.fresh = 1 AS is_new
FROM a JOIN b USING (ats_type, slug)""")
def _(spark, sf):
    existing = view(spark, sf, "companies")
    return upsert.discover_companies(existing, _sightings(spark, sf)).select(
        "ats_type", "slug", "name", "ats_url", ms("discovered_at"), "consecutive_failures", "is_new")


@feed.add("u1_company_sources", ctes("jobs", "companies") + _SIGHTINGS + """
SELECT ats_type, slug, source_type, source_detail, epoch_ms(min(seen_at)) AS discovered_at_ms
FROM found GROUP BY ALL""")
def _(spark, sf):
    found = _sightings(spark, sf)
    ids = found.select("ats_type", "slug").distinct().withColumn(
        "company_id", upsert.company_id(F.col("ats_type"), F.col("slug")))
    return upsert.discover_sources(None, found).join(ids, "company_id").select(
        "ats_type", "slug", "source_type", "source_detail", ms("discovered_at"))


@feed.add("a29_universe_growth", ctes("jobs", "companies") + _DISCOVERED + """
SELECT count(*) AS companies, count(*) FILTER (WHERE fresh = 1) AS added FROM a""")
def _(spark, sf):
    existing = view(spark, sf, "companies")
    return upsert.discover_companies(existing, _sightings(spark, sf)).agg(
        F.count(F.lit(1)).alias("companies"), F.count_if("is_new").alias("added"))


@feed.add("u3_append_poll_log", ctes("polls") + """
SELECT status, 2 * count(*) AS n, CAST(2 * sum(latency_ms) AS BIGINT) AS latency FROM polls GROUP BY status""")
def _(spark, sf):
    path, polls = scratch(spark, "polls"), view(spark, sf, "polls")
    for _ in range(2):
        polls.write.mode("append").parquet(path)
    return spark.read.schema(polls.schema).parquet(path).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency"))


# --- run outputs and logs ---

@feed.add("s20_history_latest", ctes("llm_log") + """
SELECT labeler_id, key, verdict FROM (SELECT *, row_number() OVER (PARTITION BY labeler_id, key
  ORDER BY labeled_at DESC) AS rn FROM llm_log) WHERE rn = 1""")
def _(spark, sf):
    path = scratch(spark, "history")
    landing.append_history(view(spark, sf, "llm_log"), path)
    back = landing.read_history(spark, path, schemas.LLM_LABEL)
    return dedup.latest(back, ["labeler_id", "key"], ["labeled_at"]).select(
        "labeler_id", "key", "verdict")


_LATEST = """, latest AS (SELECT * FROM (SELECT *, concat(company_slug, '/', title) AS key,
  row_number() OVER (PARTITION BY company_slug, title ORDER BY run_ts DESC, run_id DESC, pos DESC)
  AS rn FROM results) WHERE rn = 1)
"""


@feed.add("s21_runs_write_reload", ctes("results") + _LATEST + """
SELECT key, run_id, score, epoch_ms(run_ts) AS added_at_ms FROM latest""")
def _(spark, sf):
    path, rows = scratch(spark, "runs"), results(spark, sf)
    nothing = F.lit(None)
    full = rows.withColumn("qualified", F.col("score") >= 65).withColumn(
        "band", nothing.cast("string")).withColumn("features", nothing.cast(
            "struct<bm25_score:double,skill_overlap:double,level_match:double,"
            "location_match:double,title_relevance:double,has_description:double,combined:double>"))
    full.drop("key", "rejected", "n_posting", "n_profile").write.partitionBy("run_id").parquet(path)
    latest = dedup.latest_results(landing.read_runs(spark, path))
    return latest.select(F.concat_ws("/", "company_slug", "title").alias("key"), "run_id", "score",
                         ms("added_at"))


@feed.add("s22_label_store", ctes("label_log") + """
SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY labeled_at DESC)
  AS rn FROM label_log) WHERE rn = 1 AND value IS NOT NULL""")
def _(spark, sf):
    path = scratch(spark, "labels")
    landing.put_label(view(spark, sf, "label_log"), path)
    log = spark.read.schema(schemas.USER_LABEL).parquet(path)
    return dedup.latest_labels(log).select("key", "value")


@feed.add("s23_llm_labels", ctes("llm_log") + """
SELECT key, verdict, rationale FROM (SELECT *, row_number() OVER (PARTITION BY key
  ORDER BY labeled_at DESC) AS rn FROM llm_log WHERE labeler_id = 'model-v1') WHERE rn = 1""")
def _(spark, sf):
    path = scratch(spark, "llm-labels")
    landing.append_history(view(spark, sf, "llm_log"), path)
    return dedup.latest(landing.read_llm_labels(spark, path, "model-v1"), ["key"], ["labeled_at"]
                        ).select("key", "verdict", "rationale")


@feed.add("u7_latest_results", ctes("results") + _LATEST + """
SELECT company_slug, title, run_id, pos, score FROM latest""")
def _(spark, sf):
    return dedup.latest_results(results(spark, sf)).select(
        "company_slug", "title", "run_id", "pos", "score")


@feed.add("u7_latest_labels", ctes("label_log") + """
SELECT key, value, epoch_ms(labeled_at) AS labeled_at_ms FROM (SELECT *, row_number() OVER
 (PARTITION BY key ORDER BY labeled_at DESC) AS rn FROM label_log)
WHERE rn = 1 AND value IS NOT NULL""")
def _(spark, sf):
    return dedup.latest_labels(view(spark, sf, "label_log")).select("key", "value", ms("labeled_at"))


@feed.add("u8_seen_keys", ctes("results") + "SELECT DISTINCT company_slug, title FROM results")
def _(spark, sf):
    return dedup.seen_keys(results(spark, sf))


@feed.add("s25_discovery_dump", ctes("jobs", "companies") + _SIGHTINGS + """
SELECT slug, ats_type, ats_url AS url, source_detail AS source FROM (SELECT *, row_number() OVER
 (PARTITION BY ats_type, slug ORDER BY seen_at, seq) AS rn FROM found) WHERE rn = 1""")
def _(spark, sf):
    path = scratch(spark, "dump")
    unique = dedup.dedup_first(_sightings(spark, sf), dedup.BOARD_KEY, ["seen_at", "seq"])
    landing.write_discovery_dump(unique, path)
    return spark.read.schema("url string, slug string, ats_type string, source string").json(path)
