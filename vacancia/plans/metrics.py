"""Metric queries: every sample of the exposition, triage and rate control included."""
from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.operators import monitoring as mon
from vacancia.operators import ratecontrol
from vacancia.plans import evaluation as review
from vacancia.plans.domain import ctes, view
from vacancia.plans.health import _vendor_polls, health
from vacancia.plans.registry import Registry, scratch
from vacancia.sources import landing

metrics = Registry()

def _metrics(spark, sf):
    now = F.lit("2024-03-06 15:00:00").cast("timestamp")
    stats = mon.triage_stats(review._rows(spark, sf), review._labels(spark, sf), now)
    return mon.metrics_long(view(spark, sf, "companies"), view(spark, sf, "jobs"),
                            view(spark, sf, "company_sources"), view(spark, sf, "polls"), stats=stats,
                            aimd=ratecontrol.aimd_replay(_vendor_polls(spark, sf)))


_AIMD_FIELDS = ("current_concurrent", "ceiling_concurrent", "current_interval_ms", "ceiling_interval_ms", "clean_window")
_STAT_FIELDS = {"total": ("matches_total", ""), "push": ("matches_push", ""), "digest": ("matches_digest", ""),
                "new_push": ("matches_new_since_view", ""), "labeled_total": ("labels_total", ""),
                "labeled_today": ("labels_today", ""), "unlabeled_push": ("matches_unlabeled", 'tier="push"'),
                "unlabeled_digest": ("matches_unlabeled", 'tier="digest"')}
_MORE = "".join(f"""
  UNION ALL SELECT 'aimd_{f}', concat('ats="', ats_type, '"'), {f} FROM aimd""" for f in _AIMD_FIELDS) + "".join(f"""
  UNION ALL SELECT '{name}', '{tags}', {f} FROM stats""" for f, (name, tags) in _STAT_FIELDS.items())


_METRICS = ctes("companies", "jobs", "company_sources", "polls") + """
, s AS (SELECT company_id, source_type FROM company_sources GROUP BY ALL),
 sm AS (SELECT source_type, count(*) AS y, count(*) FILTER (WHERE k = 1) AS u FROM (SELECT *,
   count(*) OVER (PARTITION BY company_id) AS k FROM s) GROUP BY source_type),
 fr AS (SELECT ats_type, count(*) AS t, count(ats_posted_at) AS w,
   round(avg(epoch_ms(first_seen_at) - epoch_ms(ats_posted_at))) AS l
   FROM jobs JOIN companies USING (company_id) GROUP BY ats_type),
 aimd AS (""" + health.oracles["w6_aimd_replay"] + """),
 stats AS (""" + review.evaluation.oracles["a23_triage_stats"] + """),
 m(name, tags, value) AS (
  SELECT 'companies_total', '', count(*) FROM companies
  UNION ALL SELECT 'companies_active', '', count(*) FROM companies WHERE active
  UNION ALL SELECT 'companies_disabled', '', count(*) FROM companies WHERE NOT active
  UNION ALL SELECT 'jobs_total', '', count(*) FROM jobs
  UNION ALL SELECT 'companies_by_ats', concat('ats="', ats_type, '"'), count(*) FROM companies
    GROUP BY ats_type
  UNION ALL SELECT 'discovery_yield', concat('source="', source_type, '"'), y FROM sm
  UNION ALL SELECT 'discovery_unique_contribution', concat('source="', source_type, '"'), u FROM sm
  UNION ALL SELECT 'polls_total', 'result="success"', count(*) FROM polls WHERE status = 'success'
  UNION ALL SELECT 'polls_total', 'result="fail"', count(*) FROM polls WHERE status <> 'success'
  UNION ALL SELECT 'freshness_jobs_total', concat('ats="', ats_type, '"'), t FROM fr
  UNION ALL SELECT 'freshness_with_posted_at', concat('ats="', ats_type, '"'), w FROM fr
  UNION ALL SELECT 'freshness_avg_lag_ms', concat('ats="', ats_type, '"'), l FROM fr
  UNION ALL SELECT 'recent_poll_errors', '', count(*) FROM (SELECT * FROM polls
    ORDER BY attempted_at DESC, poll_id DESC LIMIT 20) WHERE status <> 'success'""" + _MORE + """)
"""


@metrics.add("a24_metrics_long", _METRICS + "SELECT name, tags, CAST(value AS DOUBLE) AS value FROM m")
def _(spark, sf):
    tags = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(
        e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return _metrics(spark, sf).select("name", tags.alias("tags"), "value")


@metrics.add("s24_exposition", _METRICS + """
SELECT concat('vacancia_', name, CASE WHEN tags = '' THEN '' ELSE concat('{', tags, '}') END, ' ',
   CAST(CAST(value AS BIGINT) AS VARCHAR)) AS line FROM m
UNION ALL SELECT DISTINCT concat('# HELP vacancia_', name, ' ',
   CASE name WHEN 'jobs_total' THEN 'Stored postings.' ELSE '' END) FROM m
UNION ALL SELECT DISTINCT concat('# TYPE vacancia_', name, ' ',
   CASE name WHEN 'polls_total' THEN 'counter' ELSE 'gauge' END) FROM m""")
def _(spark, sf):
    path = scratch(spark, "metrics")
    lines = mon.exposition(_metrics(spark, sf), {"jobs_total": "Stored postings."})
    landing.write_exposition(lines, path)
    return spark.read.text(path).select(F.col("value").alias("line"))
