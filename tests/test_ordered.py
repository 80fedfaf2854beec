"""Chunked ordered operators against plain Python, with one hot key."""
import math
import random

import pytest
from pyspark.sql import functions as F

from vacancia import rules
from vacancia.operators import health, ordered, ratecontrol


@pytest.fixture(scope="module")
def polls(spark):
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        company = 0 if rng.random() < 0.5 else rng.randrange(1, 12)     # one hot company
        ok = rng.random() < (0.9 if i % 1000 < 500 else 0.4)
        rows.append((i, company, 1_700_000_000 + rng.randrange(3000), "success" if ok else "error",
                     rng.random() < 0.02, rng.randrange(200)))
    df = spark.createDataFrame(
        rows, "poll_id bigint, company_id bigint, t bigint, status string, throttled boolean, "
              "latency_ms bigint")
    return df.withColumn("attempted_at", F.timestamp_seconds("t")).repartition(7).cache(), rows


def by_company(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_running_totals(polls):
    df, rows = polls
    got = {(r.company_id, r.poll_id): r.k for r in ordered.running_totals(
        df, ["company_id"], ["attempted_at", "poll_id"], {"k": F.col("latency_ms")}).collect()}
    for company, items in by_company(rows).items():
        total = 0
        for r in items:
            total += r[5]
            assert got[(company, r[0])] == total


def test_global_rank(polls):
    df, rows = polls
    got = sorted((r.rn, r.poll_id) for r in ordered.global_rank(df, ["attempted_at", "poll_id"]).collect())
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert [p for _, p in got] == want and [n for n, _ in got] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("rule,p", [("floor", 0.5), ("floor", 0.95), ("nearest", 0.5), ("nearest", 0.95)])
def test_order_statistics(polls, rule, p):
    df, rows = polls
    got = {r.company_id: r.v for r in ordered.order_statistics(
        df, ["company_id"], "latency_ms", {"v": (rule, p)}).collect()}
    for company, items in by_company(rows).items():
        xs = sorted(r[5] for r in items)
        at = math.floor(len(xs) * p) if rule == "floor" else max(0, math.ceil(len(xs) * p) - 1)
        assert got[company] == xs[at]


def test_percentile_rules_differ(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v bigint")
    row = ordered.order_statistics(df, [], "v", {"a": ("floor", 0.5), "b": ("nearest", 0.5)}).first()
    assert (row.a, row.b) == (3, 2)


def machine(items, limit=5):
    failures, disabled, nxt = 0, None, None
    for r in items:
        if r[3] == "success":
            failures, disabled, nxt = 0, None, r[2] + 900
        else:
            failures += 1
            if failures >= limit and disabled is None:
                disabled = r[2]
    return failures, disabled, nxt


def test_poll_health(polls):
    df, rows = polls
    got = {r.company_id: (r.consecutive_failures, r.d, r.n) for r in health.poll_health(df).select(
        "*", F.unix_seconds("disabled_at").alias("d"), F.unix_seconds("next_poll_at").alias("n")).collect()}
    assert got == {c: machine(items) for c, items in by_company(rows).items()}


def test_streaks_add_up(polls):
    df, rows = polls
    total = health.failure_streaks(df).agg(F.sum("failures").alias("n")).first().n
    assert total == sum(r[3] != "success" for r in rows)


def aimd(items, cap, floor):
    c, i, w = max(1, cap // 2), floor * 2, 0
    for r in items:
        if r[3] == "success" and not r[4]:
            w += 1
            if w >= 10:
                c, i, w = min(cap, c + 1), max(floor, i - 50), 0
        else:
            c, i, w = max(1, c // 2), min(floor * 10, i * 2), 0
    return c, i, w


@pytest.mark.parametrize("cap,floor", [(3, 100), (20, 500), (1, 3000), (8, 37)])
def test_aimd_replay_matches_the_sequential_rule(spark, polls, cap, floor):
    df, rows = polls
    vendors = {0: "lever"}
    named = df.withColumn("ats_type", F.when(F.col("company_id") == 0, "lever").otherwise("ashby"))
    ceilings = {"lever": (cap, floor), "ashby": (cap, floor), "idle": (cap, floor)}
    got = {r.ats_type: (r.current_concurrent, r.current_interval_ms, r.clean_window)
           for r in ratecontrol.aimd_replay(named.repartition(5), ceilings).collect()}
    ordered_rows = sorted(rows, key=lambda r: (r[2], r[0]))
    for ats in ("lever", "ashby"):
        items = [r for r in ordered_rows if vendors.get(r[1], "ashby") == ats]
        assert got[ats] == aimd(items, cap, floor)
    assert got["idle"] == (max(1, cap // 2), floor * 2, 0)


def test_transitions_compose_from_any_state():
    rng = random.Random(11)
    for _ in range(400):
        cap, floor = rng.choice([(3, 100), (20, 500), (2, 7)])
        events = [rng.random() < rng.choice([0.3, 0.9, 0.97]) for _ in range(rng.randrange(1, 400))]
        t = ratecontrol._Transition(cap, floor)
        for ok in events:
            t.clean(1) if ok else t.fail()
        prefix, failed, conc, slope, shift, low, high, pivot, mid, suffix = t.close()
        c, i, w = rng.randrange(1, cap + 1), rng.randrange(floor, floor * 10 + 1), rng.randrange(10)
        ups, left = divmod(w + prefix, 10)
        gc, gi = min(cap, c + ups), max(floor, i - 50 * ups)
        if failed:
            line = max(low, min(high, slope * gi + shift))
            gi = line if pivot is None else low if gi < pivot else mid if gi == pivot else high
            gc, left = conc[gc - 1], suffix
        for ok in events:
            if ok:
                w += 1
                if w >= 10:
                    c, i, w = min(cap, c + 1), max(floor, i - 50), 0
            else:
                c, i, w = max(1, c // 2), min(floor * 10, i * 2), 0
        assert (gc, gi, left) == (c, i, w)


@pytest.mark.parametrize("k", [3, 250])
def test_first_k_per_key(polls, k):
    df, rows = polls
    got = {}
    for r in ordered.first_k_per_key(df, ["company_id"], [F.desc("latency_ms"), F.asc("poll_id")], k).collect():
        got.setdefault(r.company_id, {})[r.rn] = r.poll_id
    for company, items in by_company(rows).items():
        want = [r[0] for r in sorted(items, key=lambda r: (-r[5], r[0]))][:k]
        assert [got[company][i + 1] for i in range(len(want))] == want and len(got[company]) == len(want)


def test_recovery_windows(spark):
    seconds = [0, 599, 600, 1199, 1200, 3600, 14400, 15001, 86400, 86999, 87000, 172800, 173400]
    df = spark.createDataFrame([(float(s),) for s in seconds], "s double")
    got = [r.d for r in df.select(health.recovery_due(F.col("s")).alias("d")).collect()]
    assert got == [False, False, True, True, False, True, True, False, True, True, False, True, False]


def test_default_ceilings_are_known():
    assert set(rules.VENDOR_CEILINGS) == set(rules.VENDORS)
