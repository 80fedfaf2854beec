"""Rate control as data: replaying the additive-increase rule over a poll log,
probe-rung statistics and the calibration recommendation.

The replay is an ordered, non-linear fold per vendor, and there are only a
handful of vendors, so one key holds a large share of the log. Rows are therefore range-partitioned by (vendor, time) and
each task folds its rows into one *transition*: a function from the state at
its start to the state at its end. Transitions compose, so only a few numbers
per partition meet in the final step.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia import rules
from vacancia.operators.ordered import order_statistics
from vacancia.session import reliable

# One row per vendor and chunk. Until the chunk's first failure the window count
# carried in matters, so the clean prefix is kept apart from the rest.
_FIELDS = ("prefix", "failed", "conc", "slope", "shift", "low", "high", "pivot", "mid", "suffix")
_TRANSITION = ("ats_type string, chunk int, prefix bigint, failed boolean, conc array<bigint>, "
               "slope bigint, shift bigint, low bigint, high bigint, pivot bigint, mid bigint, "
               "suffix bigint")


class _Transition:
    """Maps the controller state at a chunk's start to the state at its end.

    Concurrency is a table over its few values. The interval is a clamped line
    ``clamp(slope * x + shift, low, high)``; once the slope exceeds the clamp
    width at most one whole-number start value (``pivot``) lands between the
    clamps, and from then on three values are followed exactly.
    """

    def __init__(self, cap: int, floor_ms: int) -> None:
        self.cap, self.floor_ms = cap, floor_ms
        self.top_ms = floor_ms * rules.AIMD_MAX_BACKOFF
        self.prefix = self.run = 0
        self.failed = False
        self.conc = list(range(1, max(1, cap) + 1))
        self.slope, self.shift = 1, 0
        self.low, self.high = self.floor_ms, self.top_ms
        self.pivot: int | None = None
        self.mid = 0

    def _raise(self, steps: int) -> None:
        if not steps:
            return
        drop = rules.AIMD_INTERVAL_STEP_MS * steps
        self.conc = [min(self.cap, c + steps) for c in self.conc]
        self.shift -= drop
        self.low, self.mid, self.high = (
            max(self.floor_ms, v - drop) for v in (self.low, self.mid, self.high))

    def _back_off(self) -> None:
        self.conc = [max(1, c // 2) for c in self.conc]
        self.low, self.mid, self.high = (
            min(self.top_ms, 2 * v) for v in (self.low, self.mid, self.high))
        if self.pivot is not None:
            return
        self.slope, self.shift = 2 * self.slope, 2 * self.shift
        if self.slope > self.high - self.low:
            self.pivot = (self.low - self.shift) // self.slope + 1
            self.mid = min(self.high, self.slope * self.pivot + self.shift)

    def clean(self, n: int) -> None:
        self.run += n

    def fail(self) -> None:
        if self.failed:
            self._raise(self.run // rules.AIMD_CLEAN_WINDOW)
        else:
            self.prefix, self.failed = self.run, True
        self._back_off()
        self.run = 0

    def close(self) -> tuple:
        suffix = 0
        if self.failed:
            self._raise(self.run // rules.AIMD_CLEAN_WINDOW)
            suffix = self.run % rules.AIMD_CLEAN_WINDOW
        else:
            self.prefix = self.run
        slope, shift = (0, 0) if self.pivot is not None else (self.slope, self.shift)
        return (self.prefix, self.failed, self.conc, slope, shift, self.low, self.high,
                self.pivot, self.mid, suffix)


def _fold_rows(ceilings: dict[str, tuple[int, int]]):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, _Transition] = {}
        chunk = 0
        for pdf in batches:
            if not len(pdf):
                continue
            chunk = int(pdf["chunk"].iloc[0])
            for ats, part in pdf.groupby("ats_type", sort=False):
                t = open_.get(ats)
                if t is None:
                    t = open_[ats] = _Transition(*ceilings.get(ats, rules.DEFAULT_CEILING))
                clean, at = part["clean"].to_numpy(dtype=bool), 0
                for bad in (~clean).nonzero()[0]:
                    t.clean(int(bad) - at)
                    t.fail()
                    at = int(bad) + 1
                t.clean(len(clean) - at)
        out = pd.DataFrame([(a, chunk, *t.close()) for a, t in open_.items()],
                           columns=["ats_type", "chunk", *_FIELDS])
        out["pivot"] = out["pivot"].astype("Int64")
        yield out

    return fold


def aimd_transitions(polls: DataFrame,
                     ceilings: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """One transition row per vendor and range partition.

    ``polls`` has (ats_type, attempted_at, poll_id, status, throttled).
    """
    clean = (F.col("status") == "success") & ~F.coalesce("throttled", F.lit(False))
    ranged = (
        polls.select("ats_type", "attempted_at", "poll_id", clean.alias("clean"))
        .repartitionByRange("ats_type", "attempted_at", "poll_id")
        .sortWithinPartitions("ats_type", "attempted_at", "poll_id")
        .select("ats_type", "clean", F.spark_partition_id().alias("chunk"))
    )
    return ranged.mapInPandas(_fold_rows(ceilings or rules.VENDOR_CEILINGS), _TRANSITION)


def aimd_initial(spark: SparkSession, ceilings: dict[str, tuple[int, int]]) -> DataFrame:
    """Start state per vendor."""
    rows = [(a, max(1, c // 2), i * 2, 0) for a, (c, i) in ceilings.items()]
    return spark.createDataFrame(
        rows, "ats_type string, current_concurrent bigint, current_interval_ms bigint, "
              "clean_window bigint")


def aimd_replay(polls: DataFrame, ceilings: dict[str, tuple[int, int]] | None = None,
                state: DataFrame | None = None) -> DataFrame:
    """Controller state per vendor after every poll, from ``state`` or the start state.

    The collected list has one entry per range partition of the log, never one
    per poll.
    """
    ceilings = ceilings or rules.VENDOR_CEILINGS
    window, step = rules.AIMD_CLEAN_WINDOW, rules.AIMD_INTERVAL_STEP_MS
    spark = polls.sparkSession
    caps = F.create_map(*[x for a, (c, _) in ceilings.items() for x in (F.lit(a), F.lit(c))])
    floors = F.create_map(*[x for a, (_, i) in ceilings.items()
                            for x in (F.lit(a), F.lit(i))])
    steps = aimd_transitions(polls, ceilings).groupBy("ats_type").agg(
        F.array_sort(F.collect_list(F.struct("chunk", *_FIELDS))).alias("ts"))
    start = state if state is not None else aimd_initial(spark, ceilings)
    both = (start.join(steps, "ats_type", "left")
            .withColumn("cap", F.element_at(caps, F.col("ats_type")).cast("bigint"))
            .withColumn("floor_ms", F.element_at(floors, F.col("ats_type")).cast("bigint")))

    def advance(acc: Column, t: Column) -> Column:
        carried = acc["w"] + t["prefix"]
        ups = F.floor(carried / window)
        conc = F.least(F.col("cap"), acc["c"] + ups)
        interval = F.greatest(F.col("floor_ms"), acc["i"] - ups * step)
        line = F.greatest(t["low"], F.least(t["high"], t["slope"] * interval + t["shift"]))
        through = (F.when(t["pivot"].isNull(), line).when(interval < t["pivot"], t["low"])
                   .when(interval == t["pivot"], t["mid"]).otherwise(t["high"]))
        return F.struct(
            F.when(t["failed"], F.element_at(t["conc"], conc.cast("int"))).otherwise(conc).alias("c"),
            F.when(t["failed"], through).otherwise(interval).alias("i"),
            F.when(t["failed"], t["suffix"]).otherwise(F.pmod(carried, F.lit(window)))
            .cast("bigint").alias("w"))

    begin = F.struct(F.col("current_concurrent").alias("c"), F.col("current_interval_ms").alias("i"),
                     F.col("clean_window").alias("w"))
    end = F.when(F.col("ts").isNull(), begin).otherwise(F.aggregate("ts", begin, advance))
    return both.withColumn("__end", end).select(
        "ats_type", F.col("__end.c").alias("current_concurrent"),
        F.col("cap").alias("ceiling_concurrent"),
        F.col("__end.i").alias("current_interval_ms"),
        F.col("floor_ms").alias("ceiling_interval_ms"), F.col("__end.w").alias("clean_window"))


def calibration_signal(p95: Column, baseline: Column, e429: Column, e5xx: Column,
                       conn: Column, throttled: Column) -> Column:
    """True when a probe rung shows that the vendor is pushing back."""
    return (e429 > 0) | (e5xx > 2) | (conn > 0) | throttled | (p95 > baseline * 2)


def rung_stats(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Per rung: requests, nearest-rank p95, error classes, any throttle header."""
    counts = probes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") == 429).alias("errors_429"),
        F.count_if(F.col("status_code") >= 500).alias("errors_5xx"),
        F.count_if(F.col("status_code").isNull()).alias("errors_conn"),
        F.bool_or("throttled").alias("rate_limit_headers"))
    p95 = order_statistics(probes, keys, "latency_ms", {"p95_ms": ("nearest", 0.95)}).drop("n")
    return counts.join(p95, keys)


def baselines(probes: DataFrame) -> DataFrame:
    """``ats_type, baseline_p95_ms, ramp_interval_ms`` from the probes of the sequential baseline phase."""
    base = order_statistics(probes.filter("ramp = 'baseline'"), ["ats_type"], "latency_ms",
                            {"baseline_p95_ms": ("nearest", 0.95)}).drop("n")
    return base.withColumn("ramp_interval_ms", ramp_interval_ms(F.col("baseline_p95_ms")).cast("bigint"))


def signalled_rungs(probes: DataFrame, base: DataFrame) -> DataFrame:
    """Rung statistics with ``signal``, judged against the vendor's own baseline (0 if there is none)."""
    rungs = rung_stats(probes, ["ats_type", "ramp", "rung_no", "level"]).join(base, "ats_type", "left")
    return rungs.withColumn("signal", calibration_signal(
        F.col("p95_ms"), F.coalesce("baseline_p95_ms", F.lit(0)), F.col("errors_429"), F.col("errors_5xx"),
        F.col("errors_conn"), F.col("rate_limit_headers")))


def calibrated(probes: DataFrame) -> DataFrame:
    """Recommendation per (vendor, ramp), in two phases: ``ats_type, ramp, stopped, recommended, baseline_p95_ms``.

    The concurrency ramp comes first; of the interval ramp only the rungs that
    were probed at the concurrency it recommends count. ``probes`` has (ats_type, ramp, rung_no, level,
    concurrent, latency_ms, status_code, throttled), baseline probes included.
    """
    base = reliable(baselines(probes))
    first = reliable(recommend(signalled_rungs(probes.filter("ramp = 'concurrency'"), base)))
    chosen = first.select("ats_type", F.col("recommended").alias("concurrent"))
    second = recommend(signalled_rungs(probes.filter("ramp = 'interval'").join(chosen, ["ats_type", "concurrent"]), base))
    return first.unionByName(second).join(base.select("ats_type", "baseline_p95_ms"), "ats_type", "left")


def recommend(rungs: DataFrame) -> DataFrame:
    """Recommendation per (vendor, ramp): the rung before the first signal.

    ``rungs`` has (ats_type, ramp, rung_no, level, signal), at most a few dozen
    per ramp. With no signal the last rung is recommended; when even the first
    signals, the first rung itself.
    """
    first = rungs.groupBy("ats_type", "ramp").agg(
        F.min(F.when(F.col("signal"), F.col("rung_no"))).alias("stop"),
        F.min("rung_no").alias("lowest"), F.max("rung_no").alias("highest"))
    pick = first.select(
        "ats_type", "ramp", F.col("stop").isNotNull().alias("stopped"),
        F.when(F.col("stop").isNull(), F.col("highest"))
        .otherwise(F.greatest(F.col("lowest"), F.col("stop") - 1)).alias("rung_no"))
    return pick.join(rungs, ["ats_type", "ramp", "rung_no"]).select(
        "ats_type", "ramp", "stopped", F.col("level").alias("recommended"))


def ramp_interval_ms(baseline_p95: Column) -> Column:
    """Spacing used while ramping concurrency."""
    return F.greatest(F.lit(10), F.floor(baseline_p95 / 4))


def calibration_gate(company_counts: DataFrame, recommendations: DataFrame,
                     max_concurrent: int = rules.PROBE_MAX_CONCURRENT) -> DataFrame:
    """Vendors worth calibrating, with the two caution flags."""
    return company_counts.join(recommendations, "ats_type", "left").select(
        "ats_type", "companies", (F.col("companies") >= rules.PROBE_MIN_COMPANIES).alias("calibrate"),
        "recommended_concurrent",
        F.coalesce(F.col("recommended_concurrent") <= 1, F.lit(False)).alias("warn_baseline_limited"),
        F.coalesce(F.col("recommended_concurrent") >= max_concurrent, F.lit(False))
        .alias("note_probe_limit"))


def latest_ceilings(history: DataFrame) -> DataFrame:
    """Last usable calibration per vendor; zero or absent recommendations are skipped."""
    ok = history.filter((F.coalesce("recommended_concurrent", F.lit(0)) != 0)
                        & (F.coalesce("recommended_interval_ms", F.lit(0)) != 0))
    return ok.groupBy("ats_type").agg(
        F.max_by(F.struct(F.col("recommended_concurrent").alias("ceiling_concurrent"),
                          F.col("recommended_interval_ms").alias("ceiling_interval_ms")),
                 F.struct("timestamp", "seq")).alias("c")).select("ats_type", "c.*")
