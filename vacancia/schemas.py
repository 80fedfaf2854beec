"""Explicit schemas of the tables, so that no reader infers one."""

COMPANY = (
    "company_id bigint, name string, slug string, ats_type string, ats_url string, "
    "discovered_at timestamp, active boolean, next_poll_at timestamp, "
    "poll_interval_ms bigint, consecutive_failures bigint, disabled_at timestamp"
)
COMPANY_SOURCE = (
    "company_id bigint, source_type string, source_detail string, discovered_at timestamp"
)
JOB = (
    "company_id bigint, external_id string, title string, url string, location string, "
    "department string, ats_posted_at timestamp, first_seen_at timestamp, "
    "updated_at timestamp, raw_json string"
)
POLL = (
    "poll_id bigint, company_id bigint, attempted_at timestamp, status string, "
    "status_code int, latency_ms bigint, jobs_found bigint, error_message string"
)
PAYLOAD = (
    "ats_type string, slug string, company_id bigint, body string, status_code int, "
    "headers map<string,string>, aborted boolean, fetched_at timestamp, latency_ms bigint"
)
DISCOVERY = (
    "ats_type string, slug string, name string, ats_url string, source_type string, "
    "source_detail string, doc string, line_no bigint, pos bigint"
)
RESULT = (
    "run_id string, run_ts timestamp, pos bigint, company_slug string, title string, "
    "url string, location string, qualified boolean, score double, band string, "
    "hard_failures array<string>, reasoning string, "
    "evidence struct<from_posting:array<string>,from_profile:array<string>>, "
    "latency_ms double, features struct<bm25_score:double,skill_overlap:double,"
    "level_match:double,location_match:double,title_relevance:double,"
    "has_description:double,combined:double>"
)
USER_LABEL = "key string, value string, labeled_at timestamp"
LLM_LABEL = (
    "key string, verdict string, rationale string, labeler_id string, labeled_at timestamp"
)
_RUNG = (
    "concurrent:int,interval_ms:int,duration_s:double,requests:bigint,p95_ms:double,"
    "errors_429:bigint,errors_5xx:bigint,errors_conn:bigint,"
    "rate_limit_headers:boolean,signal:boolean"
)
CALIBRATION = (
    "timestamp timestamp, ats_type string, source_ip string, sample_size int, "
    "baseline_p95_ms double, recommended_concurrent int, recommended_interval_ms int, "
    f"evidence struct<concurrency_ramp:array<struct<{_RUNG}>>,"
    f"interval_ramp:array<struct<{_RUNG}>>>"
)
