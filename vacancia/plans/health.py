"""Health and monitoring queries over companies, jobs and the poll log."""
from __future__ import annotations

from pyspark.sql import functions as F

from vacancia import rules
from vacancia.operators import health as ops
from vacancia.operators import monitoring as mon
from vacancia.operators import ordered, ratecontrol, sampling
from vacancia.plans.domain import ctes, results, view
from vacancia.plans.registry import Registry, ms, scratch
from vacancia.sources import landing

health = Registry()

NOW = "2024-01-15 12:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp")


@health.add("p11_due_companies", ctes("companies") + f"""
SELECT company_id, epoch_ms(next_poll_at) AS next_poll_at_ms FROM companies
WHERE active AND (next_poll_at IS NULL OR next_poll_at <= {NOW_SQL})
ORDER BY next_poll_at ASC NULLS FIRST, company_id LIMIT 300""")
def _(spark, sf):
    return ops.due_companies(view(spark, sf, "companies"), now(), 300).select(
        "company_id", ms("next_poll_at"))


@health.add("p12_disabled_companies", ctes("companies") + f"""
SELECT company_id, (epoch_ms({NOW_SQL}) - epoch_ms(disabled_at)) / 1000.0 AS seconds_disabled
FROM companies WHERE NOT active AND disabled_at IS NOT NULL""")
def _(spark, sf):
    return ops.disabled_companies(view(spark, sf, "companies"), now()).select(
        "company_id", "seconds_disabled")


@health.add("p13_recovery_due", ctes("companies") + f"""
, d AS (SELECT company_id, (epoch_ms({NOW_SQL}) - epoch_ms(disabled_at)) // 1000 AS s
  FROM companies WHERE NOT active AND disabled_at IS NOT NULL)
SELECT company_id, (s >= 600 AND s < 1200) OR (s >= 3600 AND s < 4200)
  OR (s >= 14400 AND s < 15000) OR (s >= 86400 AND (s - 86400) % 86400 < 600) AS due FROM d""")
def _(spark, sf):
    return ops.disabled_companies(view(spark, sf, "companies"), now()).select(
        "company_id", ops.recovery_due(F.col("seconds_disabled")).alias("due"))


_STREAK = """, last AS (SELECT company_id, max(attempted_at) FILTER (WHERE status = 'success') AS ok
  FROM polls GROUP BY company_id),
 since AS (SELECT p.company_id, p.attempted_at, row_number() OVER (PARTITION BY p.company_id
  ORDER BY attempted_at, poll_id) AS rn FROM polls p JOIN last l USING (company_id)
  WHERE status <> 'success' AND (ok IS NULL OR attempted_at > ok)),
 state AS (SELECT l.company_id, coalesce(max(rn), 0) AS consecutive_failures,
  coalesce(max(rn), 0) < 5 AS active, min(CASE WHEN rn = 5 THEN s.attempted_at END) AS disabled_at,
  min(ok) + INTERVAL 900 SECOND AS next_poll_at
  FROM last l LEFT JOIN since s USING (company_id) GROUP BY l.company_id)
"""


@health.add("u4_poll_health", ctes("polls") + _STREAK + """
SELECT company_id, consecutive_failures, active, epoch_ms(disabled_at) AS disabled_at_ms,
       epoch_ms(next_poll_at) AS next_poll_at_ms FROM state""")
def _(spark, sf):
    return ops.poll_health(view(spark, sf, "polls")).select(
        "company_id", "consecutive_failures", "active", ms("disabled_at"), ms("next_poll_at"))


_ISLANDS = """, n AS (SELECT *, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (
   PARTITION BY company_id ORDER BY attempted_at, poll_id ROWS UNBOUNDED PRECEDING) AS streak_no
   FROM polls),
 f AS (SELECT *, row_number() OVER (PARTITION BY company_id, streak_no ORDER BY attempted_at,
   poll_id) AS rn FROM n WHERE status <> 'success'),
 islands AS (SELECT company_id, streak_no, min(attempted_at) AS started_at, max(attempted_at)
   AS ended_at, count(*) AS failures, min(CASE WHEN rn = 5 THEN attempted_at END) AS disabled_at
   FROM f GROUP BY company_id, streak_no)
"""


@health.add("w1_failure_streaks", ctes("polls") + _ISLANDS + """
SELECT company_id, CAST(streak_no AS BIGINT) AS streak_no, epoch_ms(started_at) AS started_at_ms, epoch_ms(ended_at) AS
 ended_at_ms, failures, epoch_ms(disabled_at) AS disabled_at_ms FROM islands""")
def _(spark, sf):
    return ops.failure_streaks(view(spark, sf, "polls")).select(
        "company_id", "streak_no", ms("started_at"), ms("ended_at"), "failures", ms("disabled_at"))


@health.add("w7_next_poll_time", ctes("polls") + """
SELECT company_id, epoch_ms(max(attempted_at) FILTER (WHERE status = 'success')
  + INTERVAL 900 SECOND) AS next_poll_at_ms FROM polls GROUP BY company_id""")
def _(spark, sf):
    return ops.next_poll_times(view(spark, sf, "polls")).select("company_id", ms("next_poll_at"))


@health.add("a22_auto_disable", ctes("polls") + _STREAK.rstrip() + _ISLANDS + """
SELECT s.company_id, coalesce(max(failures) >= 5, false) AS was_disabled, any_value(active) AS active,
  (any_value(consecutive_failures) >= 5) = NOT any_value(active) AS consistent
FROM state s LEFT JOIN islands i USING (company_id) GROUP BY s.company_id""")
def _(spark, sf):
    return ops.auto_disable_correct(view(spark, sf, "polls"))


@health.add("a21_containment", ctes("companies", "polls") + """
SELECT round(avg(CASE WHEN company_id IN (SELECT company_id FROM polls WHERE status = 'success')
  THEN 1 ELSE 0 END), 6) AS containment FROM companies WHERE active""")
def _(spark, sf):
    good = view(spark, sf, "companies").filter("active")
    return ops.containment(view(spark, sf, "polls"), good).select(
        F.round("containment", 6).alias("containment"))


# --- rate control and calibration ---

@health.add("p15_calibration_signal", ctes("polls") + """
SELECT company_id, count(*) FILTER (WHERE status_code = 429) > 0
  OR count(*) FILTER (WHERE status_code >= 500) > 2
  OR count(*) FILTER (WHERE status_code IS NULL) > 0 OR bool_or(throttled)
  OR max(latency_ms) > 2 * min(latency_ms) AS signal FROM polls GROUP BY company_id""")
def _(spark, sf):
    g = view(spark, sf, "polls").groupBy("company_id").agg(
        F.count_if(F.col("status_code") == 429).alias("e429"),
        F.count_if(F.col("status_code") >= 500).alias("e5"),
        F.count_if(F.col("status_code").isNull()).alias("conn"), F.bool_or("throttled").alias("rl"),
        F.max("latency_ms").alias("hi"), F.min("latency_ms").alias("lo"))
    return g.select("company_id", ratecontrol.calibration_signal(
        F.col("hi"), F.col("lo"), F.col("e429"), F.col("e5"), F.col("conn"), F.col("rl"))
        .alias("signal"))


_STATS = """count(*) AS requests,
  quantile_disc(latency_ms, 0.95) AS p95_ms, count(*) FILTER (WHERE status_code = 429) AS errors_429,
  count(*) FILTER (WHERE status_code >= 500) AS errors_5xx,
  count(*) FILTER (WHERE status_code IS NULL) AS errors_conn, bool_or(throttled)
  AS rate_limit_headers"""
_RUNGS = f""", rungs AS (SELECT ats_type, ramp, rung_no, level, {_STATS} FROM probes GROUP BY ALL)
"""
_KEYS = ["ats_type", "ramp", "rung_no", "level"]


@health.add("a30_rung_stats", ctes("probes") + _RUNGS + "SELECT * FROM rungs")
def _(spark, sf):
    return ratecontrol.rung_stats(view(spark, sf, "probes"), _KEYS)


def _ramp(name: str, source: str) -> str:
    """Rungs, signals against the measured baseline, and the rung before the first signal."""
    return f""", {name}_rungs AS (SELECT ats_type, rung_no, level, {_STATS} FROM {source} GROUP BY ats_type, rung_no, level),
 {name}_sig AS (SELECT r.*, errors_429 > 0 OR errors_5xx > 2 OR errors_conn > 0 OR rate_limit_headers
   OR p95_ms > 2 * coalesce(b.p95, 0) AS signal FROM {name}_rungs r LEFT JOIN base b ON r.ats_type = b.ats_type),
 {name}_pick AS (SELECT ats_type, min(rung_no) FILTER (WHERE signal) AS stop, min(rung_no) AS lo, max(rung_no) AS hi
   FROM {name}_sig GROUP BY ats_type),
 {name}_rec AS (SELECT p.ats_type, '{name}' AS ramp, stop IS NOT NULL AS stopped, level AS recommended FROM {name}_pick p
   JOIN {name}_sig s ON s.ats_type = p.ats_type AND s.rung_no = CASE WHEN stop IS NULL THEN hi ELSE greatest(lo, stop - 1) END)
"""


_RECOMMEND = (""", base AS (SELECT ats_type, quantile_disc(latency_ms, 0.95) AS p95 FROM probes WHERE ramp = 'baseline'
   GROUP BY ats_type)
""" + _ramp("concurrency", "(SELECT * FROM probes WHERE ramp = 'concurrency')").rstrip()
    + _ramp("interval", """(SELECT p.* FROM probes p JOIN concurrency_rec c ON c.ats_type = p.ats_type
    AND c.recommended = p.concurrent WHERE p.ramp = 'interval')""").rstrip()
    + ", rec AS (SELECT * FROM concurrency_rec UNION ALL SELECT * FROM interval_rec)\n")


@health.add("w5_calibration_ramp", ctes("probes") + _RECOMMEND + """
SELECT r.ats_type, ramp, stopped, recommended, p95 AS baseline_p95_ms FROM rec r LEFT JOIN base b ON r.ats_type = b.ats_type""")
def _(spark, sf):
    return ratecontrol.calibrated(view(spark, sf, "probes"))


@health.add("w5_ramp_interval", ctes("probes") + _RECOMMEND + """
SELECT ats_type, p95 AS baseline_p95_ms, CAST(greatest(10, p95 // 4) AS BIGINT) AS ramp_interval_ms FROM base""")
def _(spark, sf):
    return ratecontrol.baselines(view(spark, sf, "probes"))


@health.add("p24_calibration_gate", ctes("companies", "probes") + _RECOMMEND + """
SELECT c.ats_type, companies, companies >= 5 AS calibrate, recommended AS recommended_concurrent,
  coalesce(recommended <= 1, false) AS warn_baseline_limited,
  coalesce(recommended >= 5, false) AS note_probe_limit
FROM (SELECT ats_type, count(*) AS companies FROM companies GROUP BY ats_type) c
LEFT JOIN (SELECT * FROM rec WHERE ramp = 'concurrency') r USING (ats_type)""")
def _(spark, sf):
    counts = mon.companies_by_ats(view(spark, sf, "companies")).select("ats_type", "companies")
    rec = ratecontrol.calibrated(view(spark, sf, "probes")).filter("ramp = 'concurrency'").select(
        "ats_type", F.col("recommended").alias("recommended_concurrent"))
    return ratecontrol.calibration_gate(counts, rec, max_concurrent=5)


@health.add("a33_latest_ceilings", ctes("probes") + """
, h AS (SELECT ats_type, latency_ms, rung_no, level, count(*) AS k FROM probes GROUP BY ALL)
SELECT ats_type, rung_no - 1 AS ceiling_concurrent, level AS ceiling_interval_ms FROM (SELECT *,
 row_number() OVER (PARTITION BY ats_type ORDER BY latency_ms DESC,
   rung_no * 1000000 + level * 100 + k DESC) AS rn FROM h WHERE rung_no > 1) WHERE rn = 1""")
def _(spark, sf):
    h = view(spark, sf, "probes").groupBy("ats_type", "latency_ms", "rung_no", "level").agg(
        F.count(F.lit(1)).alias("k"))
    history = h.select(
        "ats_type", F.col("latency_ms").alias("timestamp"),
        (F.col("rung_no") - 1).alias("recommended_concurrent"),
        F.col("level").alias("recommended_interval_ms"),
        (F.col("rung_no") * 1000000 + F.col("level") * 100 + F.col("k")).alias("seq"))
    return ratecontrol.latest_ceilings(history)


def _vendor_polls(spark, sf):
    return view(spark, sf, "polls").join(
        view(spark, sf, "companies").select("company_id", "ats_type"), "company_id")


_CEIL = "(VALUES " + ", ".join(f"('{a}', {c}, {i})" for a, (c, i) in rules.VENDOR_CEILINGS.items()) \
    + ") AS v(ats_type, cap, fl)"


@health.add("w6_aimd_replay", ctes("polls", "companies") + f"""
, e AS (SELECT ats_type, list({{'c': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT), 'w': CAST(0 AS BIGINT),
    'ok': status = 'success' AND NOT throttled}} ORDER BY attempted_at, poll_id) AS xs
  FROM polls JOIN companies USING (company_id) GROUP BY ats_type),
 s AS (SELECT ats_type, cap, fl, list_reduce(list_prepend({{'c': CAST(greatest(1, cap // 2) AS BIGINT),
   'i': CAST(2 * fl AS BIGINT), 'w': CAST(0 AS BIGINT), 'ok': true}}, xs), lambda a, x: CASE WHEN x.ok
   THEN CASE WHEN a.w + 1 >= 10 THEN {{'c': least(CAST(cap AS BIGINT), a.c + 1),
             'i': greatest(CAST(fl AS BIGINT), a.i - 50), 'w': CAST(0 AS BIGINT), 'ok': true}}
        ELSE {{'c': a.c, 'i': a.i, 'w': a.w + 1, 'ok': true}} END
   ELSE {{'c': greatest(CAST(1 AS BIGINT), a.c // 2), 'i': least(CAST(fl * 10 AS BIGINT), a.i * 2),
         'w': CAST(0 AS BIGINT), 'ok': true}} END) AS z FROM e JOIN {_CEIL} USING (ats_type))
SELECT ats_type, z.c AS current_concurrent, cap AS ceiling_concurrent, z.i AS current_interval_ms,
  fl AS ceiling_interval_ms, z.w AS clean_window FROM s""")
def _(spark, sf):
    return ratecontrol.aimd_replay(_vendor_polls(spark, sf))


# --- universe and polls ---

@health.add("a1_universe_counts", ctes("companies", "jobs") + """
SELECT count(*) AS companies, count(*) FILTER (WHERE active) AS active,
  count(*) FILTER (WHERE NOT active) AS disabled, (SELECT count(*) FROM jobs) AS jobs FROM companies""")
def _(spark, sf):
    return mon.universe_counts(view(spark, sf, "companies"), view(spark, sf, "jobs"))


@health.add("a2_companies_by_ats", ctes("companies") + """
SELECT ats_type, count(*) AS companies, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)
  AS percentage FROM companies GROUP BY ats_type""")
def _(spark, sf):
    return mon.companies_by_ats(view(spark, sf, "companies")).withColumn(
        "percentage", F.round("percentage", 6))


@health.add("a6_freshness_by_ats", ctes("companies", "jobs") + """
SELECT ats_type, count(*) AS total, count(ats_posted_at) AS with_posted_at,
  round(avg(epoch_ms(first_seen_at) - epoch_ms(ats_posted_at))) AS avg_lag_ms
FROM jobs JOIN companies USING (company_id) GROUP BY ats_type""")
def _(spark, sf):
    return mon.freshness_by_ats(view(spark, sf, "jobs"), view(spark, sf, "companies"))


@health.add("a7_poll_counts_by_ats", ctes("companies", "polls") + """
SELECT ats_type, count(*) FILTER (WHERE status = 'success') AS ok,
  count(*) FILTER (WHERE status <> 'success') AS fail
FROM polls JOIN companies USING (company_id) GROUP BY ats_type""")
def _(spark, sf):
    return mon.poll_counts_by_ats(view(spark, sf, "polls"), view(spark, sf, "companies"))


@health.add("a8_latency_by_ats", ctes("companies", "polls") + """
, l AS (SELECT ats_type, list(latency_ms ORDER BY latency_ms) AS xs FROM polls
  JOIN companies USING (company_id) WHERE status = 'success' GROUP BY ats_type)
SELECT ats_type, xs[CAST(floor(len(xs) * 0.5) AS INT) + 1] AS p50,
  xs[CAST(floor(len(xs) * 0.95) AS INT) + 1] AS p95 FROM l""")
def _(spark, sf):
    return mon.latency_by_ats(view(spark, sf, "polls"), view(spark, sf, "companies"))


@health.add("a9_nearest_rank", ctes("polls") + """
SELECT status, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50,
  quantile_disc(latency_ms, 0.95) AS p95 FROM polls GROUP BY status""")
def _(spark, sf):
    return ordered.order_statistics(view(spark, sf, "polls"), ["status"], "latency_ms", {
        "p50": ("nearest", 0.5), "p95": ("nearest", 0.95)})


@health.add("a10_jobs_by_ats", ctes("companies", "jobs") + """
SELECT ats_type, count(*) AS total, count(ats_posted_at) AS with_posted,
  CAST(round(count(ats_posted_at) * 100.0 / count(*)) AS BIGINT) AS posted_pct
FROM jobs JOIN companies USING (company_id) GROUP BY ats_type""")
def _(spark, sf):
    return mon.jobs_by_ats(view(spark, sf, "jobs"), view(spark, sf, "companies"))


@health.add("a11_error_summary", ctes("companies", "polls") + """
SELECT concat(ats_type, ':', status, ':', coalesce(CAST(status_code AS VARCHAR), 'null')) AS error_key,
  count(*) AS n FROM (SELECT * FROM polls WHERE status <> 'success' ORDER BY attempted_at DESC,
  poll_id DESC LIMIT 50) JOIN companies USING (company_id) GROUP BY 1""")
def _(spark, sf):
    return mon.error_summary(view(spark, sf, "polls"), view(spark, sf, "companies"))


@health.add("a12_missing_posted_by_ats", ctes("companies", "jobs") + """
SELECT ats_type, count(*) AS jobs FROM jobs JOIN companies USING (company_id)
WHERE ats_posted_at IS NULL GROUP BY ats_type""")
def _(spark, sf):
    return mon.missing_posted_by_ats(view(spark, sf, "jobs"), view(spark, sf, "companies"))


@health.add("a13_disabled_list", ctes("companies") + """
SELECT company_id, slug, consecutive_failures, epoch_ms(disabled_at) AS disabled_at_ms
FROM companies WHERE NOT active ORDER BY disabled_at DESC NULLS LAST, company_id""")
def _(spark, sf):
    return ops.disabled_list(view(spark, sf, "companies")).select(
        "company_id", "slug", "consecutive_failures", ms("disabled_at"))


@health.add("t3_disabled_latest_20", ctes("companies") + """
SELECT company_id, epoch_ms(disabled_at) AS disabled_at_ms FROM companies WHERE NOT active
ORDER BY disabled_at DESC NULLS LAST, company_id LIMIT 20""")
def _(spark, sf):
    return ops.disabled_list(view(spark, sf, "companies"), 20).select("company_id", ms("disabled_at"))


@health.add("t4_due_capacity", ctes("companies") + f"""
SELECT company_id FROM companies WHERE active AND (next_poll_at IS NULL OR next_poll_at <= {NOW_SQL})
ORDER BY next_poll_at ASC NULLS FIRST, company_id LIMIT {3 * 40}""")
def _(spark, sf):
    return ops.due_companies(view(spark, sf, "companies"), now(), 3 * 40).select("company_id")


@health.add("a14_recent_poll_errors", ctes("polls") + """
SELECT count(*) FILTER (WHERE status <> 'success') AS errors FROM (SELECT * FROM polls
ORDER BY attempted_at DESC, poll_id DESC LIMIT 20)""")
def _(spark, sf):
    return mon.recent_poll_errors(view(spark, sf, "polls"))


@health.add("a15_poll_report", ctes("companies", "polls") + """
SELECT ats_type, count(*) FILTER (WHERE status = 'success') AS ok,
  count(*) FILTER (WHERE status <> 'success') AS fail, CAST(coalesce(sum(jobs_found), 0) AS BIGINT) AS jobs
FROM polls JOIN companies USING (company_id) GROUP BY ats_type""")
def _(spark, sf):
    return mon.poll_report(view(spark, sf, "polls"), view(spark, sf, "companies"))


@health.add("a32_soak_totals", ctes("companies", "polls", "jobs") + """
SELECT count(*) AS companies, count(*) FILTER (WHERE active) AS active,
  count(*) FILTER (WHERE NOT active) AS disabled, (SELECT count(*) FROM jobs) AS jobs,
  (SELECT count(*) FROM polls) AS polls,
  (SELECT count(*) FROM polls WHERE status = 'success') AS polls_ok,
  (SELECT count(*) FROM polls WHERE status <> 'success') AS polls_failed FROM companies""")
def _(spark, sf):
    return mon.soak_totals(view(spark, sf, "companies"), view(spark, sf, "polls"),
                           view(spark, sf, "jobs"))


@health.add("j1_jobs_companies", ctes("companies", "jobs") + """
SELECT job_id, slug, ats_type FROM jobs JOIN companies USING (company_id)""")
def _(spark, sf):
    return mon.with_company(view(spark, sf, "jobs"), view(spark, sf, "companies")).select(
        "job_id", "slug", "ats_type")


@health.add("j2_latest_polls", ctes("companies", "polls") + """
SELECT poll_id, name, ats_type, status FROM (SELECT * FROM polls ORDER BY attempted_at DESC,
 poll_id DESC LIMIT 20) JOIN companies USING (company_id)""")
def _(spark, sf):
    return mon.latest_polls(view(spark, sf, "polls"), view(spark, sf, "companies")).select(
        "poll_id", "name", "ats_type", "status")


@health.add("j3_latest_failures", ctes("companies", "polls") + """
SELECT poll_id, slug, status, status_code FROM (SELECT * FROM polls WHERE status <> 'success'
 ORDER BY attempted_at DESC, poll_id DESC LIMIT 50) JOIN companies USING (company_id)""")
def _(spark, sf):
    return mon.latest_polls(view(spark, sf, "polls"), view(spark, sf, "companies"), 50, True).select(
        "poll_id", "slug", "status", "status_code")


@health.add("j5_unpolled_companies", ctes("companies", "jobs") + """
SELECT company_id FROM companies WHERE active AND company_id NOT IN
 (SELECT company_id FROM jobs)""")
def _(spark, sf):
    return mon.unpolled_companies(view(spark, sf, "companies"), view(spark, sf, "jobs")).select("company_id")


@health.add("j6_polled_companies", ctes("companies", "jobs") + """
SELECT company_id FROM companies WHERE active AND company_id IN
 (SELECT company_id FROM jobs)""")
def _(spark, sf):
    return mon.polled_companies(view(spark, sf, "companies"), view(spark, sf, "jobs")).select("company_id")


@health.add("j9_empty_boards", ctes("companies", "polls") + """
SELECT company_id, slug FROM companies WHERE company_id IN (SELECT company_id FROM polls
 WHERE status = 'success' AND jobs_found = 0)""")
def _(spark, sf):
    return mon.empty_boards(view(spark, sf, "polls"), view(spark, sf, "companies")).select(
        "company_id", "slug")


# --- sampling: rows are ranked by an MD5 of seed and key, so the oracle draws the same ones ---

_BY_ID = "md5(concat_ws(':', 7, company_id)), company_id"
_BY_RESULT = "md5(concat_ws(':', 7, company_slug, pos)), company_slug, pos"


@health.add("t5_uniform_sample", ctes("companies") + f"SELECT company_id FROM companies ORDER BY {_BY_ID} LIMIT 200")
def _(spark, sf):
    return sampling.uniform_sample(view(spark, sf, "companies"), 200, 7, "company_id").select("company_id")


@health.add("t6_stratified_sample", ctes("results") + f"""
, p AS (SELECT CASE WHEN score >= 70 THEN 'push' WHEN score >= 40 THEN 'digest' ELSE 'low' END
  AS stratum, company_slug, pos FROM results WHERE latency_ms > 0 AND NOT rejected)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {_BY_RESULT})
  <= CASE stratum WHEN 'low' THEN 62 - 2 * 20 ELSE 20 END""")
def _(spark, sf):
    s = sampling.stratified_sample(results(spark, sf), 62, 7, "company_slug", "pos")
    return s.select("stratum", "company_slug", "pos")


@health.add("t7_proportional_sample", ctes("companies") + f"""
, c AS (SELECT ats_type, count(*) AS size, CASE ats_type WHEN 'greenhouse' THEN 0 WHEN 'lever' THEN 1
  ELSE 2 END AS ord FROM companies WHERE ats_type <> 'workable' GROUP BY ats_type),
 w AS (SELECT *, least(size, greatest(5, round(size * 60.0 / sum(size) OVER ()))) AS want FROM c),
 n AS (SELECT ats_type, least(want, 60 - coalesce(sum(want) OVER (ORDER BY ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS n FROM w),
 r AS (SELECT ats_type, company_id, row_number() OVER (PARTITION BY ats_type ORDER BY {_BY_ID}) AS rn FROM companies)
SELECT ats_type, company_id FROM r JOIN n USING (ats_type) WHERE rn <= n""")
def _(spark, sf):
    return sampling.proportional_sample(view(spark, sf, "companies"), 60, 7).select("ats_type", "company_id")


@health.add("t8_poll_batch", ctes("companies", "jobs") + f"""
SELECT company_id, (company_id IN (SELECT company_id FROM jobs))::INT AS polled
FROM companies WHERE active ORDER BY polled, {_BY_ID} LIMIT 700""")
def _(spark, sf):
    batch = sampling.select_poll_batch(view(spark, sf, "companies"), view(spark, sf, "jobs"), 700, 7)
    return batch.select("company_id", "polled")


@health.add("t9_stability_sample", ctes("results") + f"""
SELECT company_slug, pos FROM results WHERE score >= 40 AND NOT rejected ORDER BY {_BY_RESULT} LIMIT 25""")
def _(spark, sf):
    return sampling.stability_sample(results(spark, sf), 25, 7, "company_slug", "pos").select("company_slug", "pos")


@health.add("w8_stratum_rank", ctes("companies") + f"""
SELECT ats_type, company_id, row_number() OVER (PARTITION BY ats_type ORDER BY {_BY_ID}) AS rn FROM companies""")
def _(spark, sf):
    return sampling.stratum_rank(view(spark, sf, "companies"), "ats_type", 7, "company_id").select(
        "ats_type", "company_id", "rn")
