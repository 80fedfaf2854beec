"""Evaluation queries: thresholds, review queue, ranking and labelling metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from vacancia.functions import scoring
from vacancia.operators import dedup, monitoring, qualify
from vacancia.operators import evaluation as ev
from vacancia.operators.ordered import running_totals
from vacancia.plans.domain import ctes, results, view
from vacancia.plans.registry import Registry, ms

evaluation = Registry()

_RUNS = ctes("results", "label_log", "llm_log") + """
, latest AS (SELECT *, concat(company_slug, '/', title) AS key FROM (SELECT *, row_number() OVER
   (PARTITION BY company_slug, title ORDER BY run_ts DESC, run_id DESC, pos DESC) AS rn FROM results)
   WHERE rn = 1),
 labels AS (SELECT key, value, labeled_at FROM (SELECT *, row_number() OVER (PARTITION BY key
   ORDER BY labeled_at DESC) AS rn FROM label_log) WHERE rn = 1 AND value IS NOT NULL),
 llm AS (SELECT key, verdict FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY labeled_at
   DESC) AS rn FROM llm_log WHERE labeler_id = 'model-v1') WHERE rn = 1)
"""
# The oracle engine resolves "labels" to the table of that name inside label_log.
_RUNS = _RUNS.replace(" labels AS (", " user_labels AS (")


def _latest(spark, sf):
    return dedup.latest_results(results(spark, sf))


def _labels(spark, sf):
    return dedup.latest_labels(view(spark, sf, "label_log"))


def _llm(spark, sf):
    log = view(spark, sf, "llm_log").filter("labeler_id = 'model-v1'")
    return dedup.latest(log, ["key"], ["labeled_at"])


@evaluation.add("p16_band", ctes("results") + """
SELECT pos, CASE WHEN score >= 65 THEN 'push' WHEN score >= 40 THEN 'digest' ELSE 'skip' END AS band
FROM results""")
def _(spark, sf):
    return results(spark, sf).select("pos", scoring.band(F.col("score")).alias("band"))


@evaluation.add("p17_tier", ctes("results") + """
SELECT pos, CASE WHEN score >= 70 THEN 'push' WHEN score >= 40 THEN 'digest' ELSE 'skip' END AS tier
FROM results""")
def _(spark, sf):
    return results(spark, sf).select("pos", scoring.tier(F.col("score")).alias("tier"))


_GRADE = """CASE WHEN rejected THEN 0 WHEN score >= 65 THEN 3 WHEN score >= 40 THEN 2
  WHEN score >= 20 THEN 1 ELSE 0 END"""


@evaluation.add("p18_relevance_grade", ctes("results") + f"SELECT pos, {_GRADE} AS grade FROM results")
def _(spark, sf):
    return results(spark, sf).select(
        "pos", scoring.relevance_grade(F.col("score"), F.col("rejected")).alias("grade"))


@evaluation.add("p19_label_verdict", ctes("label_log") + """
SELECT key, epoch_ms(labeled_at) AS labeled_at_ms, CASE WHEN value IN ('applied', 'interested')
  THEN 'fit' WHEN value = 'false_positive' THEN 'unfit' END AS verdict FROM label_log""")
def _(spark, sf):
    return view(spark, sf, "label_log").select(
        "key", ms("labeled_at"), scoring.label_verdict(F.col("value")).alias("verdict"))


VIEWED = "2024-03-02 12:00:00"


def _rows(spark, sf):
    return monitoring.review_rows(_latest(spark, sf), _labels(spark, sf), _llm(spark, sf),
                                  F.lit(VIEWED).cast("timestamp"))


_REVIEW = _RUNS.rstrip() + f"""
, rows_ AS (SELECT latest.*, u.value AS label, u.labeled_at AS label_at, l.verdict AS llm_verdict,
   run_ts > TIMESTAMP '{VIEWED}' AS is_new FROM latest LEFT JOIN user_labels u USING (key)
   LEFT JOIN llm l USING (key))
"""


@evaluation.add("j10_results_labels", _REVIEW + """
SELECT key, score, label, epoch_ms(label_at) AS label_at_ms, llm_verdict FROM rows_""")
def _(spark, sf):
    return _rows(spark, sf).select("key", "score", "label", ms("label_at"), "llm_verdict")


@evaluation.add("p21_is_new", _REVIEW + "SELECT key, is_new FROM rows_")
def _(spark, sf):
    return _rows(spark, sf).select("key", "is_new")


_VIEW_SQL = {"unlabeled": "label IS NULL", "acted": "label IN ('applied', 'interested')",
             "passed": "label IN ('not_interested', 'false_positive')", "all": "true"}
_TIER_SQL = {"push": "score >= 70", "digest": "score >= 40 AND score < 70", "both": "score >= 40"}


@evaluation.add("p20_triage_views", _REVIEW + " UNION ALL ".join(
    f"SELECT '{v}' AS view, '{t}' AS tier, key, score FROM rows_ WHERE NOT rejected AND ({ts}) AND ({vs})"
    for v, vs in _VIEW_SQL.items() for t, ts in _TIER_SQL.items()))
def _(spark, sf):
    """All lists of the review queue, from one pass over the reviewed rows."""
    return monitoring.triage_views(_rows(spark, sf)).select("view", "tier", "key", "score")


@evaluation.add("a23_triage_stats", _REVIEW + """
SELECT count(*) AS total, count(*) FILTER (WHERE NOT rejected AND score >= 70) AS push,
  count(*) FILTER (WHERE NOT rejected AND score >= 40 AND score < 70) AS digest,
  count(*) FILTER (WHERE NOT rejected AND score >= 70 AND label IS NULL) AS unlabeled_push,
  count(*) FILTER (WHERE NOT rejected AND score >= 40 AND score < 70 AND label IS NULL)
    AS unlabeled_digest,
  count(*) FILTER (WHERE NOT rejected AND score >= 70 AND is_new) AS new_push,
  (SELECT count(*) FROM user_labels) AS labeled_total,
  (SELECT count(*) FROM user_labels WHERE labeled_at >= TIMESTAMP '2024-03-06 00:00:00')
    AS labeled_today FROM rows_""")
def _(spark, sf):
    now = F.lit("2024-03-06 15:00:00").cast("timestamp")
    return monitoring.triage_stats(_rows(spark, sf), _labels(spark, sf), now)


@evaluation.add("a23_chip_counts", _REVIEW + "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE score >= 40 AND ({s})) AS \"{v}\"" for v, s in _VIEW_SQL.items()) + """,
  count(*) FILTER (WHERE score >= 70) AS push,
  count(*) FILTER (WHERE score >= 40 AND score < 70) AS digest FROM rows_ WHERE NOT rejected""")
def _(spark, sf):
    return monitoring.triage_counts(_rows(spark, sf), "both")


# --- ranking metrics ---

_IR = ctes("results") + f"""
, g AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS rank, {_GRADE} AS grade
   FROM results),
 i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY grade DESC, rank) AS best,
   sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY rank
       ROWS UNBOUNDED PRECEDING) AS found FROM g)
"""


def _ndcg_sql(k: int) -> str:
    gain = "(pow(2, grade) - 1) / log2({r} + 1)"
    return (f"round(sum({gain.format(r='rank')}) FILTER (WHERE rank <= {k}) / "
            f"sum({gain.format(r='best')}) FILTER (WHERE best <= {k}), 6) AS ndcg_at_{k}")


def _ranked(spark, sf):
    rows = results(spark, sf).select("run_id", "pos", "score", F.col("rejected").alias("hard_rejected"))
    return running_totals(rows, ["run_id"], ["pos"], {"rank": F.lit(1)})


def _ir(spark, sf, *cols):
    return ev.ir_metrics(_ranked(spark, sf)).select("run_id", *[F.round(c, 6).alias(c) for c in cols])


@evaluation.add("w3_rank_positions", ctes("results") + """
SELECT run_id, pos, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS rank FROM results""")
def _(spark, sf):
    return _ranked(spark, sf).select("run_id", "pos", "rank")


@evaluation.add("m1_ndcg", _IR + "SELECT run_id, " + ", ".join(_ndcg_sql(k) for k in (5, 10, 30))
                + " FROM i GROUP BY run_id")
def _(spark, sf):
    return _ir(spark, sf, "ndcg_at_5", "ndcg_at_10", "ndcg_at_30")


@evaluation.add("m2_mrr", _IR + """
SELECT run_id, round(coalesce(1.0 / min(rank) FILTER (WHERE grade >= 2), 0), 6) AS mrr
FROM i GROUP BY run_id""")
def _(spark, sf):
    return _ir(spark, sf, "mrr")


@evaluation.add("m3_precision_recall_at_k", _IR + "SELECT run_id, " + ", ".join(
    f"round(count(*) FILTER (WHERE grade >= 2 AND rank <= {k}) / least({k}, count(*)), 6) "
    f"AS precision_at_{k}" for k in (5, 10, 30)) + """,
  round(count(*) FILTER (WHERE grade >= 2 AND rank <= 30) / count(*) FILTER (WHERE grade >= 2), 6)
    AS recall_at_30 FROM i GROUP BY run_id""")
def _(spark, sf):
    return _ir(spark, sf, "precision_at_5", "precision_at_10", "precision_at_30", "recall_at_30")


@evaluation.add("m4_map", _IR + """
SELECT run_id, round(avg(found / rank) FILTER (WHERE grade >= 2), 6) AS map,
  count(*) FILTER (WHERE grade >= 2) AS total_relevant, count(*) AS total_evaluated
FROM i GROUP BY run_id""")
def _(spark, sf):
    return ev.ir_metrics(_ranked(spark, sf)).select(
        "run_id", F.round("map", 6).alias("map"), "total_relevant", "total_evaluated")


@evaluation.add("f8_dcg_gain", ctes("results") + _IR.split(ctes("results"), 1)[1] + """
SELECT run_id, rank, round((pow(2, grade) - 1) / log2(rank + 1), 6) AS gain FROM g""")
def _(spark, sf):
    grade = scoring.relevance_grade(F.col("score"), F.col("hard_rejected"))
    return _ranked(spark, sf).select(
        "run_id", "rank", F.round(scoring.dcg_gain(grade, F.col("rank")), 6).alias("gain"))


# --- labels ---

_GOOD = "value IN ('applied', 'interested')"


@evaluation.add("m5_precision_by_tier", _RUNS + " UNION ALL ".join(f"""
SELECT '{t}' AS tier, count(*) FILTER (WHERE {_GOOD}) AS good, count(*) FILTER (WHERE NOT {_GOOD}) AS bad,
  round(avg(CASE WHEN {_GOOD} THEN 1.0 ELSE 0.0 END), 6) AS precision
FROM latest JOIN user_labels USING (key) WHERE {w}""" for t, w in (
    ("push", "score >= 70"), ("digest", "score >= 40 AND score < 70"))))
def _(spark, sf):
    r, lab = _latest(spark, sf), _labels(spark, sf)
    push = ev.precision(r, lab, 70).withColumn("tier", F.lit("push"))
    digest = ev.precision(r, lab, 40, 70).withColumn("tier", F.lit("digest"))
    return push.unionByName(digest).select("tier", "good", "bad",
                                           F.round("precision", 6).alias("precision"))


@evaluation.add("m6_recall_at_push", _RUNS + f"""
SELECT count(*) AS n, count(*) FILTER (WHERE score >= 70) AS hits,
  round(avg(CASE WHEN score >= 70 THEN 1.0 ELSE 0.0 END), 6) AS recall
FROM latest JOIN user_labels USING (key) WHERE {_GOOD}""")
def _(spark, sf):
    return ev.recall(_latest(spark, sf), _labels(spark, sf)).withColumn("recall", F.round("recall", 6))


@evaluation.add("j11_results_join_labels", _RUNS + """
SELECT key, score, value FROM latest JOIN user_labels USING (key)""")
def _(spark, sf):
    return _latest(spark, sf).join(_labels(spark, sf).select("key", "value"), "key").select(
        "key", "score", "value")


@evaluation.add("m7_precision_recall_llm", _RUNS + """
SELECT 'precision_push' AS metric, count(*) FILTER (WHERE verdict <> 'borderline') AS n,
  count(*) FILTER (WHERE verdict = 'fit') AS hits FROM latest JOIN llm USING (key) WHERE score >= 70
UNION ALL SELECT 'precision_digest', count(*) FILTER (WHERE verdict <> 'borderline'),
  count(*) FILTER (WHERE verdict = 'fit') FROM latest JOIN llm USING (key)
  WHERE score >= 40 AND score < 70
UNION ALL SELECT 'recall_push', count(*), count(*) FILTER (WHERE score >= 70)
  FROM latest JOIN llm USING (key) WHERE verdict = 'fit'""")
def _(spark, sf):
    r, lab = _latest(spark, sf), _llm(spark, sf)
    def part(name, df, hits):
        return df.select(F.lit(name).alias("metric"), "n", F.col(hits).alias("hits"))
    return part("precision_push", ev.precision_llm(r, lab, 70), "good").unionByName(
        part("precision_digest", ev.precision_llm(r, lab, 40, 70), "good")).unionByName(
        part("recall_push", ev.recall_llm(r, lab), "hits"))


@evaluation.add("m8_llm_user_agreement", _RUNS + """
SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS agree, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6)
 AS agreement FROM (SELECT CASE WHEN value = 'false_positive' THEN verdict <> 'fit'
  ELSE verdict <> 'unfit' END AS ok FROM user_labels JOIN llm USING (key) WHERE value <> 'not_interested')""")
def _(spark, sf):
    return ev.agreement(_labels(spark, sf), _llm(spark, sf)).withColumn(
        "agreement", F.round("agreement", 6))


@evaluation.add("j12_label_llm_join", _RUNS + """
SELECT key, value, verdict FROM user_labels JOIN llm USING (key)""")
def _(spark, sf):
    return _labels(spark, sf).join(_llm(spark, sf).select("key", "verdict"), "key").select(
        "key", "value", "verdict")


@evaluation.add("w2_precision_trend", _RUNS + f"""
SELECT row_number() OVER w AS n, key, round(sum(CASE WHEN {_GOOD} THEN 1 ELSE 0 END) OVER w
  / row_number() OVER w, 6) AS precision FROM user_labels JOIN latest USING (key) WHERE score >= 70
WINDOW w AS (ORDER BY labeled_at, key ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    return ev.precision_trend(_latest(spark, sf), _labels(spark, sf)).select(
        "n", "key", F.round("precision", 6).alias("precision"))


# --- output quality ---

@evaluation.add("m9_output_quality", ctes("results") + """
, r AS (SELECT *, score BETWEEN 0 AND 100 AND length(reasoning) >= 10 AS valid,
   n_posting > 0 OR n_profile > 0 AS shown FROM results WHERE latency_ms > 0 AND NOT rejected),
 l AS (SELECT list(latency_ms ORDER BY latency_ms) AS xs FROM r)
SELECT round(avg(CAST(valid AS INT)), 6) AS validity, round(avg(CAST(shown AS INT)), 6) AS evidence,
  (SELECT xs[CAST(floor(len(xs) * 0.5) AS INT) + 1] FROM l) AS latency_p50,
  (SELECT xs[CAST(floor(len(xs) * 0.95) AS INT) + 1] FROM l) AS latency_p95 FROM r""")
def _(spark, sf):
    return ev.output_quality(results(spark, sf)).select(
        F.round("validity", 6).alias("validity"), F.round("evidence", 6).alias("evidence"),
        "latency_p50", "latency_p95")


@evaluation.add("m11_score_stability", ctes("results") + """
SELECT count(*) AS jobs, round(avg(sd), 6) AS score_stability FROM (SELECT stddev_pop(score) AS sd
 FROM results GROUP BY company_slug, title)""")
def _(spark, sf):
    return ev.score_stability(results(spark, sf), "company_slug", "title").withColumn(
        "score_stability", F.round("score_stability", 6))


@evaluation.add("m12_score_distribution", ctes("results") + """
SELECT count(*) AS jobs_evaluated, count(*) FILTER (WHERE rejected) AS jobs_hard_rejected,
  count(*) FILTER (WHERE score >= 70) AS jobs_push,
  count(*) FILTER (WHERE score >= 40 AND score < 70) AS jobs_digest,
  count(*) FILTER (WHERE score < 40) AS jobs_skip FROM results""")
def _(spark, sf):
    return ev.score_distribution(results(spark, sf))


@evaluation.add("m14_quality_gates", ctes("results") + """
, m(name, value) AS (SELECT 'max_score', max(score) FROM results UNION ALL
  SELECT 'share_rejected', avg(CAST(rejected AS INT)) FROM results UNION ALL
  SELECT 'min_score', min(score) FROM results)
SELECT name, round(value, 6) AS value, CASE name WHEN 'max_score' THEN value <= 100
  WHEN 'min_score' THEN value = 0 ELSE value >= 0.5 END AS ok FROM m""")
def _(spark, sf):
    m = results(spark, sf).agg(
        F.max("score").alias("max_score"), F.min("score").alias("min_score"),
        F.avg(F.col("rejected").cast("int")).alias("share_rejected"),
    ).unpivot([], ["max_score", "min_score", "share_rejected"], "name", "value")
    gates = {"max_score": ("le", 100), "min_score": ("eq", 0), "share_rejected": ("ge", 0.5)}
    return ev.quality_gates(m, gates).select("name", F.round("value", 6).alias("value"), "ok")


@evaluation.add("a26_verdict_distribution", ctes("llm_log") + """
SELECT verdict, count(*) AS n FROM llm_log GROUP BY verdict""")
def _(spark, sf):
    return ev.verdict_distribution(view(spark, sf, "llm_log"))


@evaluation.add("a31_run_summary", ctes("results") + """
, b AS (SELECT *, CASE WHEN score >= 65 THEN 'push' WHEN score >= 40 THEN 'digest' ELSE 'skip' END
  AS band FROM results)
SELECT count(*) FILTER (WHERE rejected) AS hard_rejected, 0 AS title_filtered,
  count(*) FILTER (WHERE latency_ms > 0) AS evaluated, count(*) FILTER (WHERE band = 'push') AS push,
  count(*) FILTER (WHERE band = 'digest') AS digest, count(*) FILTER (WHERE band = 'skip') AS skip,
  (SELECT xs[CAST(floor(len(xs) * 0.5) AS INT) + 1] FROM (SELECT list(latency_ms ORDER BY latency_ms)
    AS xs FROM b WHERE latency_ms > 0)) AS latency_p50 FROM b""")
def _(spark, sf):
    from vacancia.operators.ordered import order_statistics
    r = results(spark, sf).withColumn("band", scoring.band(F.col("score")))
    p50 = order_statistics(r.filter("latency_ms > 0").select("latency_ms"), [], "latency_ms",
                           {"p50": ("floor", 0.5)})
    return qualify.result_summary(r).withColumn("latency_p50", p50.select("p50").scalar())


@evaluation.add("w4_latest_per_key", ctes("llm_log") + """
SELECT labeler_id, key, verdict FROM (SELECT *, row_number() OVER (PARTITION BY labeler_id, key
  ORDER BY labeled_at) AS rn FROM llm_log) WHERE rn = 1""")
def _(spark, sf):
    return dedup.dedup_first(view(spark, sf, "llm_log"), ["labeler_id", "key"], ["labeled_at"]).select(
        "labeler_id", "key", "verdict")


@evaluation.add("f6_time_functions", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso,
  epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01') AS lag,
  epoch_ms(date_trunc('day', o_orderdate)) AS day_ms FROM orders""")
def _(spark, sf):
    from vacancia.functions import text
    ts = F.col("o_orderdate").cast("timestamp")
    start = F.lit("1995-01-01").cast("timestamp")
    return view(spark, sf, "orders").select(
        "o_orderkey", text.iso_millis(F.unix_millis(ts)).alias("iso"),
        text.lag_ms(ts, start).alias("lag"), F.unix_millis(text.utc_day(ts)).alias("day_ms"))
