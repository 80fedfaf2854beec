"""Source health from the poll log: streaks, current state, due and recovery lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia import rules
from vacancia.operators.ordered import first_k_per_key, running_totals


def _stamp() -> Column:
    return F.struct("attempted_at", "poll_id")


def daily_summaries(polls: DataFrame, max_failures: int = rules.MAX_FAILURES) -> DataFrame:
    """``company_id, day, last_ok, tail, head``: a company's day as a mergeable summary.

    The last success, the failures after it, and the first ``max_failures`` of these
    (with their rank in the day). Two summaries merge in the order of time: a later success replaces
    all before it, else counts add up and the heads are joined and cut. One scan and one shuffle;
    a group is a company's day, whatever the length of its log.
    """
    rows = polls.select("company_id", "attempted_at", "poll_id", F.unix_date(F.to_date("attempted_at")).alias("day"),
                        (F.col("status") == "success").alias("ok"))
    day = Window.partitionBy("company_id", "day")
    marked = rows.withColumn("last_ok", F.max(F.when(F.col("ok"), _stamp())).over(day))
    tail = ~F.col("ok") & (F.col("last_ok").isNull() | (_stamp() > F.col("last_ok")))
    marked = marked.withColumn("in_tail", F.coalesce(tail, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("company_id", "day", "in_tail").orderBy("attempted_at", "poll_id"))
    first = F.col("in_tail") & (F.col("rn") <= max_failures)
    return marked.withColumn("rn", rank).groupBy("company_id", "day").agg(
        F.max("last_ok").alias("last_ok"), F.count_if("in_tail").alias("tail"),
        F.sort_array(F.collect_list(F.when(first, F.struct("rn", "attempted_at")))).alias("head"))


def merged_summaries(days: DataFrame, max_failures: int = rules.MAX_FAILURES) -> DataFrame:
    """``company_id, last_ok, failures, head``: the daily summaries of a company merged.

    ``head`` has the times of the first ``max_failures`` failures after the last success.
    """
    company = Window.partitionBy("company_id")
    since = F.max(F.when(F.col("last_ok").isNotNull(), F.col("day"))).over(company)
    live = days.withColumn("since", since).filter(F.col("since").isNull() | (F.col("day") >= F.col("since")))
    earlier = F.coalesce(F.sum("tail").over(company.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = live.withColumn("earlier", earlier)
    # Days that start behind the first failures give none of them.
    head = F.when(F.col("earlier") < max_failures, F.struct("day", "head"))
    return live.groupBy("company_id").agg(
        F.max("last_ok").alias("last_ok"), F.sum("tail").cast("bigint").alias("failures"),
        F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(head)), lambda d: d["head"]["attempted_at"])),
                1, max_failures).alias("head"))


def poll_health(polls: DataFrame, max_failures: int = rules.MAX_FAILURES,
                interval_ms: int = rules.POLL_INTERVAL_MS) -> DataFrame:
    """Current state per company, from one scan of the log: only failures after the last success matter."""
    last = merged_summaries(daily_summaries(polls, max_failures), max_failures)
    disabled = F.get("head", F.lit(max_failures - 1))
    return last.select(
        "company_id", F.col("failures").alias("consecutive_failures"), disabled.isNull().alias("active"),
        disabled.alias("disabled_at"),
        (F.col("last_ok.attempted_at") + F.make_dt_interval(secs=F.lit(interval_ms / 1000))).alias("next_poll_at"))


def failure_streaks(polls: DataFrame, max_failures: int = rules.MAX_FAILURES) -> DataFrame:
    """Every run of consecutive failures, with the moment it disabled the company.

    The streak number is the running count of successes, computed over
    range-partitioned chunks so that one company's log may span many tasks.
    """
    ok = F.when(F.col("status") == "success", 1).otherwise(0)
    numbered = running_totals(polls.select("company_id", "attempted_at", "poll_id", "status"),
                              ["company_id"], ["attempted_at", "poll_id"], {"streak_no": ok})
    failed = numbered.filter("status <> 'success'")
    keys = ["company_id", "streak_no"]
    spans = failed.groupBy(*keys).agg(
        F.min("attempted_at").alias("started_at"), F.max("attempted_at").alias("ended_at"),
        F.count(F.lit(1)).alias("failures"))
    nth = first_k_per_key(failed, keys, [F.col("attempted_at"), F.col("poll_id")],
                          max_failures).filter(F.col("rn") == max_failures)
    return spans.join(nth.select(*keys, F.col("attempted_at").alias("disabled_at")), keys, "left")


def next_poll_times(polls: DataFrame, interval_ms: int = rules.POLL_INTERVAL_MS) -> DataFrame:
    """Last success plus the interval; a failure does not move it."""
    return polls.groupBy("company_id").agg(
        (F.max(F.when(F.col("status") == "success", F.col("attempted_at")))
         + F.make_dt_interval(secs=F.lit(interval_ms / 1000))).alias("next_poll_at"))


def due_companies(companies: DataFrame, now: Column, limit: int) -> DataFrame:
    """Active companies due at ``now``, never-polled first, then oldest."""
    due = companies.filter(F.col("active") & (F.col("next_poll_at").isNull()
                                              | (F.col("next_poll_at") <= now)))
    return due.orderBy(F.col("next_poll_at").asc_nulls_first(), "company_id").limit(limit)


def disabled_companies(companies: DataFrame, now: Column) -> DataFrame:
    """Disabled companies with the seconds since they were disabled."""
    off = companies.filter(~F.col("active") & F.col("disabled_at").isNotNull())
    gap = (F.unix_millis(now) - F.unix_millis("disabled_at")) / 1000.0
    return off.withColumn("seconds_disabled", gap)


def recovery_due(seconds: Column, sweep_s: int = rules.RECOVERY_SWEEP_S) -> Column:
    """True in the sweep after each fixed retry point, then once per day."""
    hit = F.lit(False)
    for point in rules.RECOVERY_POINTS_S:
        hit = hit | ((seconds >= point) & (seconds < point + sweep_s))
    day = rules.RECOVERY_REPEAT_S
    return hit | ((seconds >= day) & (F.pmod(seconds - day, F.lit(day)) < sweep_s))


def disabled_list(companies: DataFrame, limit: int | None = None) -> DataFrame:
    """Inactive companies, latest disabled first; all of them when no limit is given."""
    off = companies.filter(~F.col("active")).select(
        "company_id", "name", "slug", "ats_type", "consecutive_failures", "disabled_at")
    ranked = off.orderBy(F.col("disabled_at").desc_nulls_last(), "company_id")
    return ranked if limit is None else ranked.limit(limit)


def containment(polls: DataFrame, good: DataFrame) -> DataFrame:
    """Share of the ``good`` companies that had at least one success."""
    ok = polls.filter("status = 'success'").select("company_id").distinct() \
        .withColumn("ok", F.lit(1))
    return good.select("company_id").join(ok, "company_id", "left").agg(
        F.avg(F.coalesce("ok", F.lit(0))).alias("containment"))


def auto_disable_correct(polls: DataFrame, max_failures: int = rules.MAX_FAILURES) -> DataFrame:
    """Per company: a disabling streak existed, and a later success cleared it."""
    streaks = failure_streaks(polls, max_failures)
    ever = streaks.groupBy("company_id").agg(
        F.bool_or(F.col("failures") >= max_failures).alias("was_disabled"))
    state = poll_health(polls, max_failures)
    return state.join(ever, "company_id", "left").select(
        "company_id", F.coalesce("was_disabled", F.lit(False)).alias("was_disabled"), "active",
        ((F.col("consecutive_failures") >= max_failures) == ~F.col("active")).alias("consistent"))
