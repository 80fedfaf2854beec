"""Streaming source health, recovery schedule and rate control."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vacancia import rules
from vacancia.operators.health import daily_summaries, merged_summaries
from vacancia.operators.ordered import first_k_per_key, running_totals
from vacancia.operators.ratecontrol import aimd_replay
from vacancia.streaming.tables import read_all, read_before, write_batch, write_state

HEALTH = ("company_id bigint, consecutive_failures bigint, active boolean, "
          "disabled_at timestamp, next_poll_at timestamp")
AIMD = ("ats_type string, current_concurrent bigint, ceiling_concurrent bigint, "
        "current_interval_ms bigint, ceiling_interval_ms bigint, clean_window bigint")
POLLS = "company_id bigint, attempted_at timestamp, poll_id bigint, status string"


def advance_health(state: DataFrame | None, polls: DataFrame,
                   max_failures: int = rules.MAX_FAILURES,
                   interval_ms: int = rules.POLL_INTERVAL_MS) -> DataFrame:
    """Company state after a batch of polls, from the state before it.

    The batch is reduced to one mergeable summary a company, in one scan.
    """
    batch = merged_summaries(daily_summaries(polls, max_failures), max_failures).select(
        "company_id", "last_ok", F.col("failures").alias("fresh"), F.col("head").alias("marks"))
    old = state if state is not None else polls.sparkSession.createDataFrame([], HEALTH)
    old = old.select("company_id", F.col("consecutive_failures").alias("was_cf"),
                     F.col("disabled_at").alias("was_disabled"), F.col("next_poll_at").alias("was_next"))
    both = old.join(batch, "company_id", "full")
    ok = F.col("last_ok").isNotNull()
    carried = F.when(ok, 0).otherwise(F.coalesce("was_cf", F.lit(0)))
    total = carried + F.coalesce("fresh", F.lit(0))
    nth = (F.lit(max_failures) - carried).cast("int")
    kept = F.when(~ok, F.col("was_disabled"))
    disabled = F.coalesce(kept, F.when((total >= max_failures) & (nth >= 1),
                                       F.try_element_at("marks", nth)))
    nxt = F.col("last_ok.attempted_at") + F.make_dt_interval(secs=F.lit(interval_ms / 1000))
    return both.select(
        "company_id", total.cast("bigint").alias("consecutive_failures"),
        (total < max_failures).alias("active"), disabled.alias("disabled_at"),
        F.coalesce(F.when(ok, nxt), F.col("was_next")).alias("next_poll_at"))


def _stateful(polls: DataFrame, checkpoint: str, step, available_now: bool) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    return polls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(
        **trigger).start()


def health_stream(polls: DataFrame, target: str, checkpoint: str,
                  available_now: bool = False) -> StreamingQuery:
    """Maintain the company state table; each batch writes one new version."""
    def step(df: DataFrame, batch_id: int) -> None:
        before = read_before(df.sparkSession, target, HEALTH, batch_id)
        write_state(advance_health(before, df), target, batch_id)
    return _stateful(polls, checkpoint, step, available_now)


def aimd_stream(polls: DataFrame, target: str, checkpoint: str,
                ceilings: dict[str, tuple[int, int]] | None = None,
                available_now: bool = False) -> StreamingQuery:
    """Maintain the rate-control state per vendor; each batch is folded in parallel."""
    def step(df: DataFrame, batch_id: int) -> None:
        before = read_before(df.sparkSession, target, AIMD, batch_id)
        carried = None if before is None else before.select(
            "ats_type", "current_concurrent", "current_interval_ms", "clean_window")
        write_state(aimd_replay(df, ceilings, carried), target, batch_id)
    return _stateful(polls, checkpoint, step, available_now)


#: What is settled about a company: failures since the last success, when it was disabled (0: it is not), and up to when.
NOTHING = (0, 0, -1 << 62)


def disabled_periods(polls: np.ndarray, max_failures: int = rules.MAX_FAILURES,
                     settled: tuple[int, int, int] = NOTHING) -> list[tuple[int, int | None]]:
    """When a company was disabled: ``(since, until)`` in ms, until the moment before the next success or open.

    ``polls`` has rows of time in ms, poll id and success (0 or 1), in any order; all are later than what is settled.
    """
    polls = polls[np.lexsort((polls[:, 1], polls[:, 0]))]
    ok = np.flatnonzero(polls[:, 2])
    starts, ends = np.concatenate(([0], ok + 1)), np.concatenate((ok, [len(polls)]))
    out: list[tuple[int, int | None]] = []
    failures, since, _ = settled
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if not since and failures + end - start >= max_failures:
            since = int(polls[start + max_failures - failures - 1, 0])
        if since:
            out.append((since, int(polls[end, 0]) - 1 if end < len(polls) else None))
        failures = since = 0
    return out


def settle(polls: np.ndarray, until: int, max_failures: int = rules.MAX_FAILURES,
           settled: tuple[int, int, int] = NOTHING) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Polls before ``until`` folded into the summary, and those that are left."""
    old, left = polls[polls[:, 0] < until], polls[polls[:, 0] >= until]
    if not len(old):
        return left, (settled[0], settled[1], max(settled[2], until))
    old = old[np.lexsort((old[:, 1], old[:, 0]))]
    ok = np.flatnonzero(old[:, 2])
    if len(ok):
        failures = len(old) - int(ok[-1]) - 1
    else:
        failures = settled[0] + len(old)
    last = disabled_periods(old, max_failures, settled)
    since = last[-1][0] if last and last[-1][1] is None else 0
    return left, (min(failures, max_failures), since, max(settled[2], until))


def retries(since: int, until: int, points: tuple[int, ...] = rules.RECOVERY_POINTS_S,
            repeat_s: int = rules.RECOVERY_REPEAT_S) -> list[int]:
    """The retry moments in ms after ``since``, up to and with ``until``."""
    first = [since + p * 1000 for p in points]
    daily = range(since + repeat_s * 1000, until + 1, repeat_s * 1000)
    return [d for d in first if d <= until] + list(daily)


class RecoverySchedule(StatefulProcessor):
    """Per company: the retry moments while it is disabled, as they come and whatever comes late.

    A list state holds the polls until their order is settled, ``hold_ms`` after them; older ones are folded
    into three numbers. A poll that comes late is put in its place: the schedule before and after it is compared, and
    what differs is emitted with sign 1 (a retry that is due) or -1 (one that was emitted and is none).
    Of the last, open period the next moment is a timer. The sum of signs per company and moment
    is the schedule. Without ``hold_ms`` no poll is too late; with it, polls of before the settled
    moment are left out. ``ttl_ms`` ends the state of companies that are polled no more; it has to exceed ``hold_ms``.

    The clock is the processing time, or ``clock_ms`` to replay a history up to a moment. Rows are
    taken frame by frame as they arrive; what is in memory is three numbers for each poll that is not settled.
    """

    def __init__(self, max_failures: int = rules.MAX_FAILURES, points: tuple[int, ...] = rules.RECOVERY_POINTS_S,
                 repeat_s: int = rules.RECOVERY_REPEAT_S, hold_ms: int | None = None, ttl_ms: int | None = None,
                 clock_ms: int | None = None) -> None:
        self.max_failures, self.points, self.repeat_s = max_failures, points, repeat_s
        self.hold_ms, self.ttl_ms, self.clock_ms = hold_ms, ttl_ms, clock_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.polls = handle.getListState("polls", "at_ms long, poll_id long, ok long", self.ttl_ms)
        self.summary = handle.getValueState("summary", "failures long, since long, settled long, told long", self.ttl_ms)

    def _held(self) -> tuple[np.ndarray, tuple[int, int, int], int | None]:
        rows = list(self.polls.get()) if self.polls.exists() else []
        known = self.summary.get() if self.summary.exists() else None
        settled = NOTHING if known is None else tuple(int(x) for x in known[:3])
        return np.array(rows, np.int64).reshape(-1, 3), settled, None if known is None else int(known[3])

    def _due(self, periods: list[tuple[int, int | None]], clock: int) -> set[int]:
        out: set[int] = set()
        for since, until in periods:
            out.update(retries(since, clock if until is None else min(until, clock), self.points, self.repeat_s))
        return out

    def _clock(self, timerValues) -> int:
        return self.clock_ms if self.clock_ms is not None else timerValues.getCurrentProcessingTimeInMs()

    def _rows(self, company: int, signed: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"company_id": [company] * len(signed), "due_ms": [d for d, _ in signed],
                             "sign": [s for _, s in signed]}).astype("int64")

    def _set_timer(self, periods: list[tuple[int, int | None]], clock: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if self.clock_ms is None and periods and periods[-1][1] is None:
            since, day = periods[-1][0], self.repeat_s * 1000
            later = [since + p * 1000 for p in self.points] + [since + (max(clock - since, 0) // day + 1) * day]
            self.handle.registerTimer(min(d for d in later if d > clock))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock = self._clock(timerValues)
        held, settled, told = self._held()
        parts = [held]
        for frame in rows:
            new = np.column_stack([frame["at_ms"].to_numpy(np.int64), frame["poll_id"].to_numpy(np.int64),
                                   (frame["status"] == "success").to_numpy(np.int64)])
            new = new[new[:, 0] >= settled[2]]
            if len(new):
                self.polls.appendList([tuple(r) for r in new.tolist()])
                parts.append(new)
        polls = np.concatenate(parts)
        periods = disabled_periods(polls, self.max_failures, settled)
        before = self._due(disabled_periods(held, self.max_failures, settled), told) if told is not None else set()
        after = self._due(periods, clock)
        if self.hold_ms is not None and len(polls):
            left, settled = settle(polls, int(polls[:, 0].max()) - self.hold_ms, self.max_failures, settled)
            if len(left) < len(polls):
                self.polls.put([tuple(r) for r in left.tolist()])
        self.summary.update((*settled, clock))
        self._set_timer(periods, clock)
        yield self._rows(key[0], [(d, 1) for d in sorted(after - before)] + [(d, -1) for d in sorted(before - after)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = self._clock(timerValues)
        polls, settled, told = self._held()
        periods = disabled_periods(polls, self.max_failures, settled)
        fresh = sorted(self._due(periods, clock) - self._due(periods, told or 0))
        self.summary.update((*settled, clock))
        self._set_timer(periods, clock)
        yield self._rows(key[0], [(d, 1) for d in fresh])

    def close(self) -> None:
        pass


def recovery_schedule(polls: DataFrame, hold_ms: int | None = None, ttl_ms: int | None = None,
                      clock_ms: int | None = None) -> DataFrame:
    """Streaming ``(company_id, due_ms, sign)``: retries as they fall due, corrected by polls that come late.

    Needs the RocksDB state store provider, and a processing-time trigger: with timers of that kind a stream that
    takes what is available never ends by itself. ``recovery_schedule_now`` sums the signs.
    A company whose polls do not fit a task belongs to ``recovery_stream`` and ``recovery_points``.
    """
    named = polls.select("company_id", F.unix_millis("attempted_at").alias("at_ms"), "poll_id", "status")
    return named.groupBy("company_id").transformWithStateInPandas(
        statefulProcessor=RecoverySchedule(hold_ms=hold_ms, ttl_ms=ttl_ms, clock_ms=clock_ms),
        outputStructType="company_id bigint, due_ms bigint, sign bigint", outputMode="Append", timeMode="ProcessingTime")


def recovery_schedule_now(changes: DataFrame) -> DataFrame:
    """``company_id, due_ms`` of the retries that stand after all changes."""
    return changes.groupBy("company_id", "due_ms").agg(F.sum("sign").alias("n")).filter("n > 0").select("company_id", "due_ms")


def recovery_stream(polls: DataFrame, target: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the polls that ``recovery_points`` folds; each batch writes its own folder."""
    def step(df: DataFrame, batch_id: int) -> None:
        write_batch(df.select("company_id", "attempted_at", "poll_id", "status"), target, batch_id)
    return _stateful(polls, checkpoint, step, available_now)


def recovery_points(spark: SparkSession, target: str, max_failures: int = rules.MAX_FAILURES,
                    points: tuple[int, ...] = rules.RECOVERY_POINTS_S,
                    repeat_s: int = rules.RECOVERY_REPEAT_S) -> DataFrame:
    """``company_id, due_ms``: the retries of every disabled company up to its next success, or the last poll of all."""
    polls = read_all(spark, target, POLLS)
    ok = F.col("status").eqNullSafe("success")
    counted = running_totals(polls, ["company_id"], ["attempted_at", "poll_id"], {"episode": F.when(ok, 1).otherwise(0)})
    disabled = first_k_per_key(counted.filter(~ok), ["company_id", "episode"], [F.col("attempted_at"), F.col("poll_id")],
                               max_failures).filter(F.col("rn") == max_failures)
    ends = counted.filter(ok).select("company_id", (F.col("episode") - 1).alias("episode"),
                                     F.unix_millis("attempted_at").alias("until"))
    last = polls.agg(F.max(F.unix_millis("attempted_at"))).scalar()
    since, day = F.col("since"), repeat_s * 1000
    until = F.coalesce(F.col("until") - 1, F.col("last"))
    return (
        disabled.select("company_id", "episode", F.unix_millis("attempted_at").alias("since"))
        .join(ends, ["company_id", "episode"], "left").withColumn("last", last)
        .withColumn("days", F.floor((until - since) / day))
        .withColumn("after", F.explode(F.concat(
            F.array(*[F.lit(p * 1000).cast("bigint") for p in points]),
            F.when(F.col("days") > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("days")), lambda n: n * day))
            .otherwise(F.array().cast("array<bigint>")))))
        .filter(since + F.col("after") <= until)
        .select("company_id", (since + F.col("after")).alias("due_ms")))
