from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tests.llm.conftest import prose, rows_of
from vacancia.llm import mixing
from vacancia.llm.mixing import mix_documents, period_slots, schedule, shares


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": .5, "b": .3, "c": .2}, {f"s{k}": 1 / (k + 1) for k in range(40)},
                                     {"big": 1e6, "small": 1e-6, "mid": 3}])
def test_every_source_has_its_share_to_within_a_block(weights):
    units = shares(weights, 256)
    period, placed = sum(units.values()), Counter()
    assert period == 256 and min(units.values()) >= 1
    for slot, (source, i, at, release, deadline) in enumerate(period_slots(units)):
        assert slot == at and release <= slot < deadline
        placed[source] += 1
        assert placed[source] == i
        for s, u in units.items():
            assert abs(placed[s] - Fraction((slot + 1) * u, period)) < 1


def test_shares_refuse_bad_weights():
    with pytest.raises(ValueError):
        shares({"a": 0})


def documents(spark):
    rows = [(k, prose(k, 20 + k % 50), "hot" if k % 3 else f"s{k % 5}") for k in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)


def test_the_schedule_of_documents(spark):
    block = 2000
    rows = schedule(documents(spark), {"hot": 3, "s0": 1, "s1": 1, "s2": 1, "s3": 1, "s4": 1}, block_chars=block,
                    period=64).collect()
    texts = {r["doc_id"]: r for r in documents(spark).collect()}
    assert {r["doc_id"] for r in rows} == set(texts)            # nobody is left out
    units = shares({"hot": 3, "s0": 1, "s1": 1, "s2": 1, "s3": 1, "s4": 1}, 64)
    order = {(s, i): at for s, i, at, _, _ in period_slots(units)}
    by_reading = defaultdict(list)
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"]
        turn, i = divmod(r["block"], units[r["source"]])
        assert r["slot"] == order[r["source"], i + 1] + 64 * turn
        by_reading[r["source"], r["epoch"]].append(r)
    for (source, epoch), found in by_reading.items():
        found.sort(key=lambda r: r["offset"])
        if epoch == 1:
            at = 0
            for r in found:                                     # offsets are the running characters of the source
                assert r["offset"] == at
                assert r["block"] == min(at // block, -(-sum(len(texts[x["doc_id"]]["text"]) for x in found) // block) - 1)
                at += len(texts[r["doc_id"]]["text"])


def test_documents_in_mix_order(spark):
    docs = documents(spark)
    out = mix_documents(docs, block_chars=500)
    assert out.columns == docs.columns
    count = Counter(r["doc_id"] for r in out.collect())
    assert set(count) == set(range(900))
    assert rows_of(out.distinct(), *docs.columns) == rows_of(docs, *docs.columns)


def test_awkward_rows(awkward, nothing):
    rows = schedule(awkward, block_chars=1000).filter("epoch = 1")
    assert rows.count() == awkward.count()
    out = mix_documents(awkward, block_chars=1000)
    assert out.columns == awkward.columns
    assert rows_of(out.distinct(), "doc_id", "source") == rows_of(awkward.distinct(), "doc_id", "source")
    assert schedule(nothing).count() == 0 and mix_documents(nothing).count() == 0


def test_missing_weight(spark):
    with pytest.raises(ValueError):
        schedule(documents(spark), {"hot": 1.0})


@pytest.mark.parametrize("weights", [{"hot": .3333, "rare": .0001, "other": .6666},
                                     {"hot": 2500., **{f"s{k}": 1. for k in range(5000)}}])
def test_target_weights_hold_for_long_mixes_and_many_sources(weights):
    exact, placed = {s: Fraction(w) for s, w in weights.items()}, Counter()
    total, length = sum(exact.values()), 30_000
    for slot, (source, i, _, release, deadline) in enumerate(period_slots(shares(weights), length)):
        assert release <= slot < deadline
        placed[source] = i
        assert abs(i - (slot + 1) * exact[source] / total) < 1
    assert all(abs(placed[s] - length * w / total) < 1 for s, w in exact.items())


@pytest.mark.parametrize("broadcast", [0, 4_000_000])
def test_a_light_source_has_its_target_weight(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", broadcast)
    rows = [(k, "x" * 20, "hot") for k in range(500)] + [(1000, "y" * 20, "rare"), (1001, "y" * 20, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = schedule(docs, {"hot": .9999, "rare": .0001}, block_chars=20).collect()
    slots = sorted(r["slot"] for r in out)
    assert slots == list(range(len(slots))) and 19_990 <= len(slots) <= 20_010
    assert sum(r["source"] == "rare" for r in out) == 2
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
