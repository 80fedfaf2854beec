"""The engine's tables derived from the driver's tables.

The driver data holds no job boards, so companies, postings, polls, payloads
and results are derived from it, row by row, in the SQL subset that Spark and
the oracle engine share. Both engines evaluate the same text here; what they
compute *from* these tables is written independently.
"""
from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.session import configure, spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


# Derived tables whose rows are long texts to be parsed.
TEXT_HEAVY = ("links", "payloads")


def _case(selector: str, values: list[str | None]) -> str:
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr_sql(v)}"
                    for i, v in enumerate(values))
    return f"CASE {selector} {arms} END"


def repr_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LEVELS = ["Senior ", "Staff ", "Junior ", "Associate ", "Principal ", "Lead ", "", "", "", ""]
ROLES = ["Software Engineer", "Backend Developer", "Data Analyst", "Sales Manager",
         "Application Security Engineer", "Platform Engineer", "Machine Learning Engineer",
         "Marketing Coordinator", "Security Operations Analyst", "Full Stack Developer",
         "Product Designer", "Frontend Engineer", "DevOps Engineer", "Software Engineer II"]
PLACES = ["New York, NY", "Remote (US)", "London, UK", "Berlin, Germany", "San Francisco, CA",
          None, "Toronto, Canada", "United States", "Austin, TX"]
_GAP = " " * 12
# One phrase per form of the rules, with numbers around the limits and each separator.
PHRASES = [
    "Bring 4+ years of platform engineering.", "Bring 3+ years of platform engineering.",
    "Range: 1-4 years professional.", f"Range: 2{_GAP}–{_GAP}6 yrs of mixed software.", "Range: 5 - 9 years industry.",
    "We require 4 years.", "We require 3 yrs, with aws and terraform.", "Founded 80 years ago, python shop.",
    "Write golang every day, golang in all services.", "Proficient in rust; develop rust and scala.",
    "Holds an active secret clearance.", "Daily soc triage and vulnerability management.",
    "Kubernetes, docker and typescript with 6 years coding.",
]


def _title(key: str, other: str) -> str:
    return (f"concat({_case(f'{key} % 10', LEVELS)}, "
            f"{_case(f'({key} * 7 + {other}) % 14', ROLES)})")


_COMPANY_SLUG = "lower(replace(c_name, '#', '-'))"

_BODY = {
    # Two postings per response; o_orderkey % 7 picks the shape, some of them broken.
    "greenhouse": """CASE o_orderkey % 7
  WHEN 0 THEN concat('{"jobs":[{"id":', k, ',"title":"Engineer ', k, '","absolute_url":"https://g.example.com/', k, '","updated_at":"2024-02-03T04:05:06-04:00","location":{"name":"', p, '"},"departments":[{"id":1,"name":"Core"},{"id":2,"name":"Other"}],"content":"<p>text</p>"},{"id":', k2, ',"title":"Clerk","absolute_url":"https://g.example.com/', k2, '","updated_at":"2024-02-03T04:05:06Z","location":{"name":"Oslo"},"departments":[]}],"meta":{"total":2}}')
  WHEN 1 THEN concat('{"jobs":[{"id":', k, ',"title":"Engineer","absolute_url":"https://g.example.com/', k, '","updated_at":"2024-02-03T04:05:06-04:00","first_published":"2023-11-12T00:00:00+02:00","location":{"name":"', p, '"},"departments":[{"id":1,"name":"Core"}]}]}')
  WHEN 2 THEN concat('{"jobs":[{"id":', k, ',"title":"Analyst","absolute_url":"https://g.example.com/', k, '","updated_at":"2024-02-03T04:05:06Z","location":null,"departments":[]}]}')
  WHEN 3 THEN concat('{"jobs":[{"id":', k, ',"title":"Cook","absolute_url":"https://g.example.com/', k, '","updated_at":"2024-02-03T04:05:06Z"}]}')
  WHEN 4 THEN concat('{"jobs":[{"id":', k, ',"title":"Cut off')
  WHEN 5 THEN concat('{"data":[{"id":', k, '}],"meta":{}}')
  ELSE concat('{"jobs":[{"id":', k, ',"title":"Fine","absolute_url":"https://g.example.com/', k, '","updated_at":"2024-02-03T04:05:06Z"},{"id":"', k2, '","title":"Text id","absolute_url":"https://g.example.com/', k2, '","updated_at":"2024-02-03T04:05:06Z"}]}') END""",
    "lever": """CASE o_orderkey % 7
  WHEN 0 THEN concat('[{"id":"L', k, '","text":"Engineer ', k, '","hostedUrl":"https://l.example.com/', k, '","createdAt":1706918706', k3, ',"categories":{"location":"', p, '","department":"Core"}},{"id":"L', k2, '","text":"Clerk","hostedUrl":"https://l.example.com/', k2, '","createdAt":1700000000000,"categories":{"location":"Oslo"}}]')
  WHEN 1 THEN concat('[{"id":"L', k, '","text":"Driver","hostedUrl":"https://l.example.com/', k, '","createdAt":1706918706', k3, ',"categories":{"location":"', p, '","department":"Fleet","team":"x"}}]')
  WHEN 2 THEN concat('[{"id":"L', k, '","text":"Nurse","hostedUrl":"https://l.example.com/', k, '","createdAt":1706918706000,"categories":{"location":"', p, '"}}]')
  WHEN 3 THEN concat('[{"id":"L', k, '","text":"Cook","hostedUrl":"https://l.example.com/', k, '","createdAt":1706918706000}]')
  WHEN 4 THEN concat('[{"id":"L', k, '","text":"Cut off')
  WHEN 5 THEN concat('{"ok":false,"error":"no board ', k, '"}')
  ELSE concat('[{"id":"L', k, '","text":"Cook","hostedUrl":"https://l.example.com/', k, '","createdAt":"yesterday"}]') END""",
    "ashby": """CASE o_orderkey % 7
  WHEN 0 THEN concat('{"data":{"jobBoard":{"jobPostings":[{"id":"A', k, '","title":"Engineer ', k, '","locationName":"', p, '","employmentType":"FullTime","compensationTierSummary":"100"},{"id":"A', k2, '","title":"Clerk","locationName":"Oslo"}]}}}')
  WHEN 1 THEN concat('{"data":{"jobBoard":{"jobPostings":[{"id":"A', k, '","title":"Driver","locationName":"', p, '","extra":{"a":[1,2]}}]}}}')
  WHEN 2 THEN concat('{"data":{"jobBoard":{"jobPostings":[{"id":"A', k, '","title":"Nurse","locationName":"', p, '","compensationTierSummary":null}]}}}')
  WHEN 3 THEN '{"data":{"jobBoard":null}}'
  WHEN 4 THEN concat('{"data":{"jobBoard":{"jobPostings":[{"id":"A', k)
  WHEN 5 THEN '{"errors":[{"message":"rate limited"}]}'
  ELSE concat('{"data":{"jobBoard":{"jobPostings":[{"id":"A', k, '","title":"No place"}]}}}') END""",
    "workable": """CASE o_orderkey % 7
  WHEN 0 THEN concat('{"name":"Co","jobs":[{"shortcode":"W', k, '","title":"Engineer ', k, '","url":"https://w.example.com/', k, '","city":"', p, '","department":"Core","published":"2024-02-03"},{"shortcode":"W', k2, '","title":"Clerk","url":"https://w.example.com/', k2, '"}]}')
  WHEN 1 THEN concat('{"jobs":[{"shortcode":"W', k, '","title":"Driver","url":"https://w.example.com/', k, '","city":"', p, '","published":null}]}')
  WHEN 2 THEN concat('{"name":"Co","jobs":[{"shortcode":"W', k, '","title":"Nurse","url":"https://w.example.com/', k, '","city":null,"department":"Ward","published":"2023-12-31"}]}')
  WHEN 3 THEN '{"name":"Co","jobs":[]}'
  WHEN 4 THEN concat('{"name":"Co","jobs":[{"shortcode":"W', k)
  WHEN 5 THEN '{"name":"Co"}'
  ELSE concat('{"name":"Co","jobs":[{"shortcode":"W', k, '","title":7,"url":"https://w.example.com/', k, '"}]}') END""",
}

DOMAIN: dict[str, str] = {
    "companies": f"""
SELECT c_custkey AS company_id, c_name AS name, {_COMPANY_SLUG} AS slug,
       CASE c_nationkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby'
            ELSE 'workable' END AS ats_type,
       concat('https://boards.example.com/', {_COMPANY_SLUG}) AS ats_url,
       TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 30) * INTERVAL '1' DAY AS discovered_at,
       c_acctbal >= 0 AS active,
       CASE WHEN c_custkey % 5 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-15 00:00:00' + (c_custkey % 96 - 48) * INTERVAL '1' HOUR
       END AS next_poll_at,
       CAST(900000 AS BIGINT) AS poll_interval_ms,
       CASE WHEN c_acctbal < 0 THEN 5 + c_custkey % 4 ELSE c_custkey % 5 END
           AS consecutive_failures,
       CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-01 00:00:00'
            + (c_custkey * 7919 % 1500000) * INTERVAL '1' SECOND END AS disabled_at
FROM {{customer}}""",
    "jobs": f"""
SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 11 = 5 THEN o_custkey - 1 ELSE o_custkey END AS company_id, CAST(o_orderkey AS STRING) AS external_id,
       {_title('o_orderkey', 'o_custkey')} AS title,
       concat('https://jobs.example.com/', CAST(o_orderkey AS STRING)) AS url,
       {_case('(o_orderkey + o_custkey) % 9', PLACES)} AS location,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS department,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS ats_posted_at,
       CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 72) * INTERVAL '1' HOUR AS first_seen_at,
       CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 96) * INTERVAL '1' HOUR AS updated_at,
       concat('<p>', {_case('o_orderkey % 13', PHRASES)}, '</p> ',
              {_case('(o_orderkey + o_custkey) % 13', PHRASES)}) AS description
FROM {{orders}}""",
    # Runs of earlier ticks: the postings of one department were scored.
    "stored_runs": """
SELECT company_slug, title, url FROM {postings} WHERE department = 'fr'""",
    "raw_jobs": """
SELECT *, CASE job_id % 5
       WHEN 0 THEN concat('{"id":', external_id, ',"content":"', description, '"}')
       WHEN 1 THEN concat('{"content":"","description":"', description,
                          '","location":{"name":"', coalesce(location, ''), '"}}')
       WHEN 2 THEN concat('{"descriptionHtml":"<b>html</b>","content":"', description,
                          '","locationName":"', coalesce(location, ''), '"}')
       WHEN 3 THEN '{"title":"bare"}'
       ELSE concat('{"descriptionPlain":"', description, '","description":"other","city":"',
                   coalesce(location, ''), '"}') END AS raw_json
FROM {jobs}""",
    "postings": f"""
SELECT doc_id, source AS company_slug, {_title('doc_id', 'n_chars')} AS title,
       concat('https://docs.example.com/', CAST(doc_id AS STRING)) AS url,
       {_case('(doc_id + n_chars) % 9', PLACES)} AS location,
       CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS department,
       concat('<p>', {_case('doc_id % 13', PHRASES)}, '</p> ', text) AS description
FROM {{documents}}""",
    "labelled_jobs": f"""
SELECT job_id, title, concat('{{"location":{{"name":"', coalesce(location, ''), '"}},"content":"',
         {_case('job_id % 13', PHRASES)}, '"}}') AS raw_json,
       (job_id % 13 IN (1, 2, 3, 6, 7) OR (job_id % 13 = 11 AND contains(title, 'Software')))
       AND NOT contains(title, 'Lead') AND NOT contains(title, 'Principal') AND NOT contains(title, 'Associate')
       AND NOT contains(title, 'Manager') AND NOT contains(title, 'Security')
       AND coalesce(location, '') NOT IN ('London, UK', 'Berlin, Germany', 'Toronto, Canada')
           AS should_pass
FROM {{jobs}}""",
    "polls": """
SELECT event_id AS poll_id, user_id AS company_id,
       CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS attempted_at,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'timeout' ELSE 'success' END
           AS status,
       CASE WHEN event_type = 'signup' THEN NULL WHEN event_type <> 'error' THEN 200
            WHEN event_id % 3 = 0 THEN 429 WHEN event_id % 3 = 1 THEN 500 END AS status_code,
       CAST(floor(value) AS BIGINT) AS latency_ms,
       CASE WHEN event_type NOT IN ('error', 'signup') THEN event_id % 4 END AS jobs_found,
       event_id % 23 = 0 AS throttled
FROM {events}""",
    "company_sources": """
SELECT l_orderkey AS company_id,
       CASE l_returnflag WHEN 'A' THEN 'github' WHEN 'N' THEN 'oss_list' ELSE 'hn' END
           AS source_type,
       l_linestatus AS source_detail, CAST(l_shipdate AS TIMESTAMP) AS discovered_at
FROM {lineitem}""",
    "payloads": f"""
SELECT ats_type, concat('co-', CAST(o_custkey AS STRING)) AS slug, o_custkey AS company_id,
       o_orderkey AS fetch_id,
       CASE WHEN o_orderkey % 19 = 0 THEN 503 ELSE 200 END AS status_code,
       o_orderkey % 29 = 0 AS aborted, CAST(o_orderdate AS TIMESTAMP) AS fetched_at,
       o_orderkey % 900 AS latency_ms,
       CASE ats_type WHEN 'greenhouse' THEN {_BODY['greenhouse']}
            WHEN 'lever' THEN {_BODY['lever']} WHEN 'ashby' THEN {_BODY['ashby']}
            ELSE {_BODY['workable']} END AS body
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever'
                WHEN 2 THEN 'ashby' ELSE 'workable' END AS ats_type,
             CAST(o_orderkey AS STRING) AS k, CAST(o_orderkey + 100000000 AS STRING) AS k2,
             CAST(100 + o_orderkey % 900 AS STRING) AS k3, o_orderpriority AS p
      FROM {{orders}}) AS o""",
    "refetches": """
SELECT o_custkey AS company_id,
       concat(CAST(l_orderkey AS STRING), CASE l_linestatus WHEN 'O' THEN '' ELSE '-b' END)
           AS external_id,
       concat('Line ', CAST(l_linenumber AS STRING), ' ', l_returnflag) AS title,
       concat('https://jobs.example.com/', CAST(l_orderkey AS STRING), '?v=',
              CAST(l_linenumber AS STRING)) AS url,
       CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN 'Remote' ELSE 'Oslo' END AS location,
       CAST(l_suppkey AS STRING) AS department, CAST(l_shipdate AS TIMESTAMP) AS ats_posted_at,
       CAST(l_shipdate AS TIMESTAMP) AS first_seen_at, CAST(l_shipdate AS TIMESTAMP) AS updated_at,
       CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS seq
FROM {lineitem} AS l JOIN {orders} AS o ON o.o_orderkey = l.l_orderkey""",
    "links": """
SELECT *, CASE n % 9
         WHEN 0 THEN concat('https://boards.greenhouse.io/', co, '/jobs/', k)
         WHEN 1 THEN concat('https://jobs.lever.co/', co, '/', k)
         WHEN 2 THEN concat('https://jobs.ashbyhq.com/', co)
         WHEN 3 THEN concat('https://apply.workable.com/', co, '/j/', k)
         WHEN 4 THEN concat('http://', co, '.workable.com/jobs/', k)
         WHEN 5 THEN 'https://www.workable.com'
         WHEN 6 THEN concat('https://careers.example.com/', co)
         WHEN 7 THEN concat('https://boards-api.greenhouse.io/v1/boards/', co, '/jobs')
         ELSE concat('https://BOARDS.greenhouse.io/', co, '?t=', k) END AS link,
       CASE n % 4 WHEN 0 THEN concat('https://jobs.lever.co/', co) WHEN 1 THEN
            concat('https://other.example.com/', k) WHEN 2 THEN
            concat('https://jobs.ashbyhq.com/', co, '/apply') ELSE
            concat('https://boards.greenhouse.io/', co) END AS link2
FROM (SELECT o_orderkey AS n, o_custkey AS company_id, concat('Co_', CAST(o_custkey AS STRING)) AS co,
             CAST(o_orderkey AS STRING) AS k, o_orderpriority AS doc,
             CAST(o_orderdate AS TIMESTAMP) AS ts FROM {orders}) AS o""",
    "list_lines": """
SELECT doc, n AS line_no, CASE n % 5
    WHEN 0 THEN concat('| [Firm ', k, '](', link, ') | Oslo | [Apply](', link2, ') |')
    WHEN 1 THEN concat('| **Firm ', k, '** | Remote | [Apply](', link, ') |')
    WHEN 2 THEN concat('| <img src=x> Firm ', k, ' | ', link, ' |')
    WHEN 3 THEN concat('plain text (', link, '). and "', link2, '", end')
    ELSE concat('no pipe ', link2) END AS line
FROM {links}""",
    "json_docs": """
SELECT k AS doc, CASE n % 6
    WHEN 4 THEN concat('{"not":"a list ', k, '"}')
    WHEN 5 THEN '[{"slug":'
    ELSE concat('[{"name":"Firm ', k, '","slug":"', co, '","ats_type":"', CASE n % 3 WHEN 0
        THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'taleo' END, '","ats_url":"', link,
        '"},{"slug":"x', co, '","ats_type":"greenhouse","ats_url":"', link2,
        '"},{"slug":"","ats_type":"lever","ats_url":"u"},{"slug":"y","ats_type":"lever"}]')
    END AS text
FROM {links}""",
    "crawl_jsonl": """
SELECT doc, n AS line_no, CASE n % 7
    WHEN 0 THEN concat('{"url":"', link, '","slug":"', co, '","ats_type":"lever","source":"github:list"}')
    WHEN 1 THEN concat('{"ats_url":"', link2, '","url":"', link, '","slug":"', co,
                       '","ats_type":"ashby","source":"common_crawl"}')
    WHEN 2 THEN concat('{"url":"', link, '","slug":"', co, '","ats_type":"workable"}')
    WHEN 3 THEN concat('  {"url":"', link, '","collection":"CC-X"} ')
    WHEN 4 THEN concat('{"url":"', link, '"}')
    WHEN 5 THEN concat('{"url":"', link)
    ELSE '' END AS line
FROM {links}""",
    "cdx_lines": """
SELECT doc, n AS line_no, CASE n % 5
    WHEN 0 THEN concat('io,greenhouse) 2024 no json ', k)
    WHEN 1 THEN concat('io,greenhouse) 2024 {"url": "', link)
    ELSE concat('key) 20240102 {"url": "', link, '", "status": "200", "page": ', CAST(n % 3 AS STRING), '}')
    END AS line
FROM {links}""",
    "index_lines": """
SELECT doc, n AS line_no, concat(CASE n % 7 WHEN 0 THEN 'io,greenhouse,boards)/' WHEN 1 THEN
    'com,ashbyhq,jobs)/' WHEN 2 THEN 'com,workable,apply)/' WHEN 3 THEN 'co,lever,jobs)/'
    WHEN 4 THEN 'com,example)/' WHEN 5 THEN 'aa,first)/' ELSE 'io,zzz)/' END, co, ' 2024',
    chr(9), 'cdx-', CAST(n % 20 AS STRING), '.gz', CASE WHEN n % 11 = 0 THEN '' ELSE
    concat(chr(9), CAST(n * 1000 AS STRING), chr(9), CAST(500 + n % 77 AS STRING), chr(9), '1') END)
    AS line
FROM {links}""",
    # A crawl index over the pages: every ninth page belongs to each of the four vendors.
    "crawl_lines": """
SELECT surt, concat(surt, ' 20240102030405 {"url": "', link, '", "status": "200"}') AS line
FROM (SELECT CASE page_id % 9
        WHEN 0 THEN concat('io,greenhouse,boards)/', co, '/jobs/', id)
        WHEN 2 THEN concat('com,ashbyhq,jobs)/', co, '/', id)
        WHEN 4 THEN concat('com,workable,apply)/', co, '/j/', id)
        WHEN 6 THEN concat('co,lever,jobs)/', co, '/', id)
        WHEN 8 THEN concat('io,greenhouse,boardsmore)/', co)
        ELSE concat('net,site', CAST(page_id % 23 AS STRING), ')/', id) END AS surt,
    CASE page_id % 9
        WHEN 0 THEN concat('https://boards.greenhouse.io/', co, '/jobs/', id)
        WHEN 2 THEN concat('https://jobs.ashbyhq.com/', co, '/', id)
        WHEN 4 THEN concat('https://apply.workable.com/', co, '/j/', id)
        WHEN 6 THEN concat('https://jobs.lever.co/', co, '/', id)
        ELSE url END AS link
  FROM (SELECT page_id, url, concat('co', CAST(page_id * 31 % 211 AS STRING)) AS co,
               CAST(page_id AS STRING) AS id FROM {pages}) AS p) AS q""",
    "threads": """
SELECT c_custkey AS thread_id, CASE c_custkey % 4 WHEN 0 THEN 'Ask: Who is HIRING? (May)'
    WHEN 1 THEN 'Ask: Who wants to be hired?' WHEN 2 THEN 'Who is hiring vs who wants work'
    ELSE 'Ask: who is hiring?' END AS title,
    TIMESTAMP '2024-06-01 00:00:00' - (c_custkey % 500) * INTERVAL '1' DAY AS created_at
FROM {customer}""",
    "comments": """
SELECT company_id AS thread_id, n AS comment_no, CASE n % 3
    WHEN 0 THEN concat('<p>We hire, see <a href="', link, '">', link, '</a>.')
    WHEN 1 THEN concat('Apply at ', link2, '). Or ', link, '`, thanks')
    ELSE '<i>nothing</i>' END AS comment_html
FROM {links}""",
    "directory": """
SELECT c_custkey AS record_no, c_name AS name,
       CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', '-') ELSE c_name END AS slug,
       CASE c_custkey % 3 WHEN 0 THEN concat('https://jobs.lever.co/', co) WHEN 1 THEN ''
            ELSE concat('https://', co, '.example.com') END AS website,
       CASE WHEN c_custkey % 4 = 0 THEN concat('See https://jobs.ashbyhq.com/', co, '.') END
           AS long_description,
       CASE WHEN c_custkey % 5 = 0 THEN concat('(https://boards.greenhouse.io/', co, ')') ELSE 'x'
           END AS one_liner,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS batch
FROM (SELECT *, concat('Co_', CAST(c_custkey AS STRING)) AS co FROM {customer}) AS c""",
    "probe_answers": """
SELECT lower(replace(replace(c_name, '#', ''), 'x', '')) AS slug, ats_type,
       CASE WHEN c_custkey % 7 = 0 THEN 404 ELSE 200 END AS status_code,
       CASE ats_type WHEN 'greenhouse' THEN CASE c_custkey % 3 WHEN 0 THEN '{"jobs":[]}'
                     WHEN 1 THEN '{"error":1}' ELSE 'oops' END
            ELSE CASE c_custkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{"id":"a"}]'
                 WHEN 2 THEN '{"ok":false}' ELSE '' END END AS body
FROM {customer} CROSS JOIN (SELECT 'greenhouse' AS ats_type UNION ALL SELECT 'lever') AS v""",
    "fragments": """
SELECT concat(CASE n % 3 WHEN 0 THEN 'boards.greenhouse.io' WHEN 1 THEN 'jobs.lever.co' ELSE
       'jobs.ashbyhq.com' END, ' in:file language:', doc) AS query, n AS fragment_no,
       concat('x = "', link, '", y: `', link2, '`') AS text
FROM {links}""",
    "results": """
SELECT concat('run-', CAST(doc_id % 3 AS STRING)) AS run_id,
       TIMESTAMP '2024-03-01 00:00:00' + (doc_id % 3) * INTERVAL '1' DAY AS run_ts,
       doc_id AS pos, source AS company_slug,
       concat('Role ', CAST(doc_id * 17 % 60 AS STRING)) AS title,
       concat('https://r.example.com/', CAST(doc_id AS STRING)) AS url, lang AS location,
       CAST(doc_id * 37 % 101 AS DOUBLE) AS score, doc_id % 11 = 0 AS rejected,
       CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 100 + doc_id * 131 % 4000 END AS DOUBLE)
           AS latency_ms,
       CASE WHEN doc_id % 13 = 0 THEN 'short' ELSE concat('Because ', text) END
           AS reasoning,
       doc_id % 3 AS n_posting, doc_id % 2 AS n_profile
FROM {documents}""",
    "label_log": """
SELECT concat(d.source, '/Role ', CAST(d.doc_id * 17 % 60 AS STRING)) AS key,
       CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN l.toxic = 1 THEN 'false_positive'
            WHEN l.quality = 0 THEN 'not_interested' WHEN d.doc_id % 2 = 0 THEN 'applied'
            ELSE 'interested' END AS value,
       TIMESTAMP '2024-03-04 00:00:00' + d.doc_id * INTERVAL '7' MINUTE AS labeled_at
FROM {labels} AS l JOIN {documents} AS d ON d.doc_id = l.doc_id""",
    "llm_log": """
SELECT concat(source, '/Role ', CAST(doc_id * 17 % 60 AS STRING)) AS key,
       CASE WHEN doc_id % 5 < 2 THEN 'fit' WHEN doc_id % 5 = 2 THEN 'borderline' ELSE 'unfit' END
           AS verdict,
       concat('rationale ', CAST(doc_id AS STRING)) AS rationale,
       CASE WHEN doc_id % 4 = 0 THEN 'model-v0' ELSE 'model-v1' END AS labeler_id,
       TIMESTAMP '2024-03-02 00:00:00' + doc_id * INTERVAL '13' MINUTE AS labeled_at
FROM {documents}""",
    # A calibration: sequential probes, then a concurrency ramp, then an interval ramp at each concurrency.
    "probes": """
SELECT CASE user_id % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS ats_type,
       CASE event_id % 10 WHEN 9 THEN 'baseline' WHEN 1 THEN 'interval' WHEN 3 THEN 'interval'
            WHEN 5 THEN 'interval' WHEN 7 THEN 'interval' ELSE 'concurrency' END AS ramp,
       1 + user_id % 5 AS rung_no,
       CASE WHEN event_id % 2 = 0 THEN 1 + user_id % 5
            ELSE CASE user_id % 5 WHEN 0 THEN 1000 WHEN 1 THEN 500 WHEN 2 THEN 250
                 WHEN 3 THEN 100 ELSE 50 END END AS level,
       CASE WHEN event_id % 2 = 0 THEN 1 + user_id % 5 WHEN event_id % 10 = 9 THEN 1
            ELSE 1 + event_id % 5 END AS concurrent,
       CASE WHEN event_id % 10 <> 9 AND user_id % 5 >= 3 AND event_id % 41 < 3 THEN 429
            WHEN event_id % 4001 = 7 THEN 500 ELSE 200 END AS status_code,
       CAST(floor(value) * CASE WHEN event_id % 10 = 9 THEN 1 + user_id % 3 ELSE 2 END AS BIGINT) AS latency_ms,
       event_id % 9973 = 9000 AS throttled
FROM {events}""",
}



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the text tables are single small files and are spread out."""
    configure(spark)
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in ("documents", "pages") else scan


def view(spark: SparkSession, sf_dir: str, name: str,
         given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derived table; ``given`` replaces named inputs (a stream for a table)."""
    if given and name in given:
        return given[name]
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = DOMAIN[name]
    deps = {n: view(spark, sf_dir, n, given) for n in _names(sql)}
    if name in TEXT_HEAVY and not given:
        deps = {n: spread(d) if n in TABLES else d for n, d in deps.items()}
    return spark.sql(_escape(sql, deps), **deps)


def _escape(sql: str, deps: dict) -> str:
    """Double every brace that is not a table reference (JSON text in literals)."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for n in deps:
        text = text.replace("{{" + n + "}}", "{" + n + "}")
    return text


def _names(sql: str) -> list[str]:
    return [n for n in list(DOMAIN) + TABLES if "{" + n + "}" in sql]


def ctes(*names: str) -> str:
    """``WITH`` prefix that defines the named derived tables in the oracle engine."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in TABLES or n in order:
            return
        for d in _names(DOMAIN[n]):
            add(d)
        order.append(n)

    for n in names:
        add(n)
    parts = []
    for n in order:
        sql = DOMAIN[n]
        for d in _names(sql):
            sql = sql.replace("{" + d + "}", d)
        parts.append(f"{n} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with their nested columns."""
    df = view(spark, sf_dir, "results")
    none = F.array().cast("array<string>")
    items = lambda n: F.when(F.col(n) > 0, F.array_repeat(F.lit("quote"), F.col(n).cast("int"))) \
        .otherwise(none)
    return (
        df.withColumn("hard_failures", F.when(F.col("rejected"), F.array(F.lit("rule")))
                      .otherwise(none))
        .withColumn("evidence", F.struct(items("n_posting").alias("from_posting"),
                                         items("n_profile").alias("from_profile")))
        .withColumn("key", F.concat_ws("/", "company_slug", "title"))
    )
