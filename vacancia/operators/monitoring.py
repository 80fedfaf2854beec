"""Feed and review observability: counts, rates, latency, error lists, metrics."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia import rules
from vacancia.functions.scoring import escape_label, is_good
from vacancia.functions.text import lag_ms, utc_day
from vacancia.operators.ordered import order_statistics
from vacancia.session import reliable

COMPANY_DIM = ["company_id", "slug", "name", "ats_type"]


def with_company(facts: DataFrame, companies: DataFrame,
                 columns: list[str] | None = None) -> DataFrame:
    """Fact rows with their company's columns.

    No broadcast hint: the optimiser broadcasts the dimension only when its
    measured size allows, and splits skewed partitions otherwise.
    """
    return facts.join(companies.select(*(columns or COMPANY_DIM)), "company_id")


def _by_company_then_ats(facts: DataFrame, companies: DataFrame, aggs: dict[str, Column],
                         merge: dict[str, str] | None = None) -> DataFrame:
    """Aggregate facts per company before the join, then per vendor.

    The join input is one row per company, so a company holding a third of all
    facts is a single row there. ``merge`` names a non-sum combiner.
    """
    merge = merge or {}
    per_company = facts.groupBy("company_id").agg(*[c.alias(n) for n, c in aggs.items()])
    joined = per_company.join(companies.select("company_id", "ats_type"), "company_id")
    return joined.groupBy("ats_type").agg(
        *[getattr(F, merge.get(n, "sum"))(n).alias(n) for n in aggs])


def universe_counts(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: companies, active, disabled, jobs."""
    n_jobs = jobs.agg(F.count(F.lit(1)).alias("n"))
    return companies.agg(
        F.count(F.lit(1)).alias("companies"), F.count_if("active").alias("active"),
        F.count_if(~F.col("active")).alias("disabled"),
    ).withColumn("jobs", n_jobs.scalar())


def companies_by_ats(companies: DataFrame) -> DataFrame:
    """Companies and share per vendor (the window runs over the few vendors)."""
    per = companies.groupBy("ats_type").agg(F.count(F.lit(1)).alias("companies"))
    everything = Window.partitionBy()
    return per.withColumn("percentage", F.col("companies") * 100.0 / F.sum("companies")
                          .over(everything)).orderBy(F.desc("companies"), "ats_type")


def source_types(company_sources: DataFrame) -> DataFrame:
    return company_sources.select("source_type").distinct().orderBy("source_type")


def source_metrics(company_sources: DataFrame) -> DataFrame:
    """Yield, unique contribution and first discoveries per source, in one pass.

    A company is first reduced to one row per source; ties for the earliest
    sighting count for every tied source.
    """
    pairs = company_sources.groupBy("company_id", "source_type").agg(
        F.min("discovered_at").alias("first_at"))
    company = Window.partitionBy("company_id")      # at most one row per source type
    marked = pairs.select(
        "source_type", (F.count(F.lit(1)).over(company) == 1).alias("alone"),
        (F.col("first_at") == F.min("first_at").over(company)).alias("first"))
    return marked.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("yield"), F.count_if("alone").alias("unique_contribution"),
        F.count_if("first").alias("first_discovery"))


def source_overlap(company_sources: DataFrame) -> DataFrame:
    """Companies shared by each ordered pair of sources (source types are few)."""
    sets = company_sources.groupBy("company_id").agg(
        F.array_sort(F.collect_set("source_type")).alias("s"))
    left = sets.select("s", F.explode("s").alias("source_a"))
    return (
        left.select("source_a", F.explode("s").alias("source_b"))
        .filter("source_a < source_b").groupBy("source_a", "source_b")
        .agg(F.count(F.lit(1)).alias("shared"))
    )


def freshness_by_ats(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Per vendor: jobs, jobs with a posting time, rounded mean publish-to-ingest lag."""
    lag = lag_ms(F.col("first_seen_at"), F.col("ats_posted_at"))
    sums = _by_company_then_ats(jobs, companies, {
        "total": F.count(F.lit(1)), "with_posted_at": F.count("ats_posted_at"),
        "lag_sum": F.sum(lag)})
    return sums.select("ats_type", "total", "with_posted_at",
                       F.round(F.try_divide("lag_sum", "with_posted_at")).alias("avg_lag_ms"))


def poll_counts_by_ats(polls: DataFrame, companies: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    return _by_company_then_ats(polls, companies, {
        "ok": F.count_if(ok), "fail": F.count_if(~ok)})


def poll_report(polls: DataFrame, companies: DataFrame) -> DataFrame:
    """Per vendor: successful and failed polls and jobs found."""
    ok = F.col("status") == "success"
    return _by_company_then_ats(polls, companies, {
        "ok": F.count_if(ok), "fail": F.count_if(~ok),
        "jobs": F.sum(F.when(ok, F.coalesce("jobs_found", F.lit(0))).otherwise(0))})


def latency_by_ats(polls: DataFrame, companies: DataFrame) -> DataFrame:
    """p50 and p95 of successful polls, floor-index rule."""
    counted = polls.filter("status = 'success'").groupBy("company_id", "latency_ms").agg(
        F.count(F.lit(1)).alias("k"))
    rows = counted.join(companies.select("company_id", "ats_type"), "company_id")
    return order_statistics_weighted(rows, ["ats_type"], "latency_ms", "k")


def order_statistics_weighted(rows: DataFrame, keys: list[str], value: str,
                              weight: str) -> DataFrame:
    """p50/p95 (floor rule) where each row stands for ``weight`` equal values."""
    from vacancia.operators.ordered import running_totals

    counts = rows.groupBy(*keys, value).agg(F.sum(weight).alias("__n"))
    cum = running_totals(counts, keys, [value], {"__cum": F.col("__n")})
    size = counts.groupBy(*keys).agg(F.sum("__n").alias("__size"))
    at = lambda p: F.min(F.when(
        F.col("__cum") >= F.floor(F.col("__size") * F.lit(p)) + 1, F.col(value)))
    return cum.join(size, keys).groupBy(*keys).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def jobs_by_ats(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs per vendor and rounded percentage with a posting time."""
    sums = _by_company_then_ats(jobs, companies, {
        "total": F.count(F.lit(1)), "with_posted": F.count("ats_posted_at")})
    return sums.select("ats_type", "total", "with_posted",
                       F.round(F.col("with_posted") * 100.0 / F.col("total")).cast("bigint")
                       .alias("posted_pct"))


def missing_posted_by_ats(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    return _by_company_then_ats(jobs.filter("ats_posted_at is null"), companies,
                                {"jobs": F.count(F.lit(1))})


def latest_polls(polls: DataFrame, companies: DataFrame, k: int = 20,
                 failures_only: bool = False) -> DataFrame:
    """The ``k`` latest polls with their company: the top-k runs before the join."""
    rows = polls.filter("status <> 'success'") if failures_only else polls
    top = rows.orderBy(F.desc("attempted_at"), F.desc("poll_id")).limit(k)
    return with_company(top, companies)


def error_summary(polls: DataFrame, companies: DataFrame, k: int = 50) -> DataFrame:
    """Counts by vendor, status and code over the latest ``k`` failures."""
    key = F.concat_ws(":", "ats_type", "status",
                      F.coalesce(F.nullif(F.col("status_code"), F.lit(0)).cast("string"),
                                 F.lit("null")))
    return latest_polls(polls, companies, k, failures_only=True).groupBy(
        key.alias("error_key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_key")


def recent_poll_errors(polls: DataFrame, k: int = 20) -> DataFrame:
    """One row: failures among the latest ``k`` polls."""
    top = polls.orderBy(F.desc("attempted_at"), F.desc("poll_id")).limit(k)
    return top.agg(F.count_if(F.col("status") != "success").alias("errors"))


def empty_boards(polls: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies with a successful poll that found no job."""
    none = polls.filter("status = 'success' and jobs_found = 0").select("company_id")
    return companies.select("company_id", "slug", "ats_type").join(none, "company_id", "left_semi")


def unpolled_companies(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    return companies.filter("active").join(jobs.select("company_id"), "company_id", "left_anti")


def polled_companies(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    return companies.filter("active").join(jobs.select("company_id"), "company_id", "left_semi")


def soak_totals(companies: DataFrame, polls: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of run totals."""
    ok = F.col("status") == "success"
    p = polls.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"))
    return universe_counts(companies, jobs).withColumn("polls", p.select("n").scalar()) \
        .withColumn("polls_ok", p.select("ok").scalar()) \
        .withColumn("polls_failed", F.col("polls") - F.col("polls_ok"))


def crawl_report(lines: DataFrame) -> DataFrame:
    """Per crawl pattern: pages, lines, bytes and newly seen companies, with a total row.

    ``lines`` has (pattern, pattern_no, page, line, ats_type, slug). A company
    counts for the first pattern that shows it, so the total is their sum.
    """
    volume = lines.groupBy("pattern", "page").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("bytes"))
    firsts = (
        lines.filter("slug is not null").groupBy("ats_type", "slug")
        .agg(F.min_by("pattern", "pattern_no").alias("pattern"))
        .groupBy("pattern").agg(F.count(F.lit(1)).alias("new_slugs"))
    )
    per = volume.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("lines").alias("lines"),
        F.sum("bytes").alias("bytes")).join(firsts, "pattern", "left")
    return per.rollup("pattern").agg(
        F.sum("pages").alias("pages"), F.sum("lines").alias("lines"),
        F.sum("bytes").alias("bytes"),
        F.coalesce(F.sum("new_slugs"), F.lit(0)).alias("new_slugs"),
    ).withColumn("pattern", F.coalesce("pattern", F.lit("TOTAL")))


# --- review queue ---

def review_rows(results: DataFrame, labels: DataFrame, llm_labels: DataFrame,
                last_viewed: Column) -> DataFrame:
    """Current results with their user and model labels and the is-new mark."""
    left = results.withColumn("key", F.concat_ws("/", "company_slug", "title"))
    user = labels.select("key", F.col("value").alias("label"), F.col("labeled_at").alias("label_at"))
    model = llm_labels.select("key", F.col("verdict").alias("llm_verdict"),
                              F.col("rationale").alias("llm_rationale"))
    return (
        left.join(user, "key", "left").join(model, "key", "left")
        .withColumn("is_new", F.col("added_at") > last_viewed)
    )


def _clean() -> Column:
    return F.size("hard_failures") == 0


def _in_tier(tier: str) -> Column:
    if tier == "push":
        return F.col("score") >= rules.TIER_PUSH
    if tier == "digest":
        return (F.col("score") >= rules.TIER_DIGEST) & (F.col("score") < rules.TIER_PUSH)
    return F.col("score") >= rules.TIER_DIGEST


_VIEWS = {
    "unlabeled": lambda: F.col("label").isNull(),
    "acted": lambda: F.coalesce(is_good(F.col("label")), F.lit(False)),
    "passed": lambda: F.coalesce(F.col("label").isin("not_interested", "false_positive"),
                                 F.lit(False)),
    "all": lambda: F.lit(True),
}


def triage_view(rows: DataFrame, view: str = "unlabeled", tier: str = "push",
                sort: str = "score") -> DataFrame:
    """One list of the review queue, ordered."""
    by_score, by_time = F.col("score").desc(), F.col("added_at").desc()
    order = [by_time, by_score] if sort == "newest" else [by_score, by_time]
    return rows.filter(_clean() & _in_tier(tier) & _VIEWS[view]()).orderBy(*order, "key")


def triage_views(rows: DataFrame, tiers: tuple[str, ...] = ("push", "digest", "both")) -> DataFrame:
    """Every list of the review queue in one pass: the rows with the views and tiers that they belong to."""
    lists = F.array(*[F.when(_in_tier(t) & test(), F.struct(F.lit(v).alias("view"), F.lit(t).alias("tier")))
                      for v, test in _VIEWS.items() for t in tiers])
    return rows.filter(_clean()).select("*", F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("__list")).select(
        F.col("__list.view").alias("view"), F.col("__list.tier").alias("tier"), *rows.columns)


def triage_counts(rows: DataFrame, tier: str = "push") -> DataFrame:
    """Chip counts of the review queue in one pass."""
    clean = rows.filter(_clean())
    return clean.agg(*[F.count_if(_in_tier(tier) & test()).alias(name)
                       for name, test in _VIEWS.items()],
                     F.count_if(_in_tier("push")).alias("push"),
                     F.count_if(_in_tier("digest")).alias("digest"))


def triage_stats(rows: DataFrame, labels: DataFrame, now: Column) -> DataFrame:
    """Headline numbers of the review queue."""
    push, digest = _clean() & _in_tier("push"), _clean() & _in_tier("digest")
    unlabeled = F.col("label").isNull()
    lab = labels.agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(F.col("labeled_at") >= utc_day(now)).alias("today"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(push).alias("push"),
        F.count_if(digest).alias("digest"), F.count_if(push & unlabeled).alias("unlabeled_push"),
        F.count_if(digest & unlabeled).alias("unlabeled_digest"),
        F.count_if(push & F.col("is_new")).alias("new_push"),
    ).withColumn("labeled_total", lab.select("n").scalar()) \
        .withColumn("labeled_today", lab.select("today").scalar())


# --- metrics ---

def _samples(df: DataFrame, values: dict[str, str], label: str | None = None) -> DataFrame:
    """Long form of aggregate rows: (name, labels, value)."""
    tags = (F.create_map(F.lit(label), F.col(_LABEL_COLUMN[label])) if label
            else F.create_map().cast("map<string,string>"))
    cols = [F.struct(F.lit(metric).alias("name"), F.col(c).cast("double").alias("value"))
            for c, metric in values.items()]
    return df.select(tags.alias("labels"), F.explode(F.array(*cols)).alias("m")).select(
        F.col("m.name").alias("name"), "labels", F.col("m.value").alias("value")
    ).filter("value is not null")


_LABEL_COLUMN = {"ats": "ats_type", "source": "source_type"}


def metrics_long(companies: DataFrame, jobs: DataFrame, company_sources: DataFrame,
                 polls: DataFrame, stats: DataFrame | None = None,
                 aimd: DataFrame | None = None) -> DataFrame:
    """Every metric sample as (name, labels, value).

    ``stats`` is the row of ``triage_stats``, ``aimd`` the rate-control state by vendor; both are small
    and are worked out once.
    """
    stats, aimd = (None if small is None else reliable(small) for small in (stats, aimd))
    ok = F.col("status") == "success"
    totals = polls.agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("fail"))
    per_result = totals.select(F.explode(F.create_map(
        F.lit("success"), "success", F.lit("fail"), "fail")).alias("result", "n"))
    parts = [
        _samples(universe_counts(companies, jobs), {
            "companies": "companies_total", "active": "companies_active",
            "disabled": "companies_disabled", "jobs": "jobs_total"}),
        _samples(companies_by_ats(companies), {"companies": "companies_by_ats"}, "ats"),
        _samples(source_metrics(company_sources), {
            "yield": "discovery_yield",
            "unique_contribution": "discovery_unique_contribution"}, "source"),
        per_result.select(F.lit("polls_total").alias("name"),
                          F.create_map(F.lit("result"), "result").alias("labels"),
                          F.col("n").cast("double").alias("value")),
        _samples(freshness_by_ats(jobs, companies), {
            "total": "freshness_jobs_total", "with_posted_at": "freshness_with_posted_at",
            "avg_lag_ms": "freshness_avg_lag_ms"}, "ats"),
        _samples(recent_poll_errors(polls), {"errors": "recent_poll_errors"}),
    ]
    if aimd is not None:
        fields = ("current_concurrent", "ceiling_concurrent", "current_interval_ms",
                  "ceiling_interval_ms", "clean_window")
        parts.append(_samples(aimd, {f: f"aimd_{f}" for f in fields}, "ats"))
    if stats is not None:
        parts.append(_samples(stats, {
            "total": "matches_total", "push": "matches_push", "digest": "matches_digest",
            "new_push": "matches_new_since_view", "labeled_total": "labels_total",
            "labeled_today": "labels_today"}))
        for tier in ("push", "digest"):
            parts.append(stats.select(
                F.lit("matches_unlabeled").alias("name"),
                F.create_map(F.lit("tier"), F.lit(tier)).alias("labels"),
                F.col(f"unlabeled_{tier}").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def exposition(metrics: DataFrame, help_text: dict[str, str], prefix: str = "vacancia_") -> DataFrame:
    """Text exposition lines (seq, line): help, type, then samples per metric.

    The input is one row per sample of a bounded metric list.
    """
    helps = F.create_map(*[x for k, v in help_text.items() for x in (F.lit(k), F.lit(v))])
    name = F.concat(F.lit(prefix), F.col("name"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(
        e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"')))
    tags = F.when(F.size("labels") > 0,
                  F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    whole = F.col("value") == F.floor("value")
    shown = F.when(whole, F.col("value").cast("bigint").cast("string")) \
        .otherwise(F.col("value").cast("string"))
    samples = metrics.select("name", F.concat(F.lit("2"), tags).alias("rank"),
                             F.concat(name, tags, F.lit(" "), shown).alias("line"))
    kinds = F.when(F.col("name").isin("polls_total"), "counter").otherwise("gauge")
    heads = metrics.select("name").distinct()
    head = heads.select("name", F.lit("0").alias("rank"), F.concat(
        F.lit("# HELP "), name, F.lit(" "),
        F.coalesce(F.try_element_at(helps, F.col("name")), F.lit(""))).alias("line"))
    kind = heads.select("name", F.lit("1").alias("rank"), F.concat(
        F.lit("# TYPE "), name, F.lit(" "), kinds).alias("line"))
    lines = samples.unionByName(head).unionByName(kind)
    return lines.select(F.concat_ws("|", "name", "rank", "line").alias("seq"), "line")
