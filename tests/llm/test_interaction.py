from collections import defaultdict
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from vacancia.llm.interaction import failures, interaction_report, scaled_potentials

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text, doc_id, first):
    words = [w for w in text.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    out = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
           "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
           "E": doc_id is not None and first is not None and first < doc_id}
    return {k for k, v in out.items() if v}


def brute(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = defaultdict(list)
    for d, t, s in docs:
        parts[s or ""].append((d, fails(t or "", d, first.get(t or ""))))
    out = {}
    for part, rows in parts.items():
        total, step_rows = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                total[letter] += len(gone)
                step_rows.append((
                    "".join(order), step, letter, len(left), len(gone),
                    sum(letter in f for _, f in rows) - len(gone), sum(f == {letter} for _, f in rows),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        for order, step, letter, *counts in step_rows:
            out[part, order, step] = (*counts, total[letter])
    return out


def found(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_failures_of_a_text():
    assert failures("") == 1
    assert failures("a " * 200) == 2
    assert failures(" ".join(f"w{i}" for i in range(200))) == 0
    assert failures(" ".join(f"w{i}" for i in range(200)) + " AAAAAAAAAAAAAAAAAAAAAAAAAA|") == 12
    # only ASCII blanks part words; the share of capitals is of code points
    assert failures("é" * 48 + "Z") & 4 == 4 and failures("é" * 49 + "Z") & 4 == 0
    assert failures("a\u00a0b " * 199 + "a\u2003b") == 2


def test_potentials_give_the_shapley_sums(spark):
    v = [0] + [(37 * s * s + 11 * s) % 101 for s in range(1, 32)]
    q = spark.range(1).select(scaled_potentials(F.array(*[F.lit(x).cast("long") for x in v])).alias("q")).first()["q"]
    for i in range(5):
        want = 0
        for order in permutations(range(5)):
            before = sum(1 << x for x in order[:order.index(i)])
            want += v[before | 1 << i] - v[before]
        assert q[31] - 5 * q[31 - (1 << i)] == want
    potential = {0: 0.0}
    for s in range(1, 32):
        members = [i for i in range(5) if s >> i & 1]
        potential[s] = (v[s] + sum(potential[s - (1 << i)] for i in members)) / len(members)
        assert q[s] == pytest.approx(factorial(len(members)) * potential[s])


def test_against_brute_force(spark, sf_dir):
    import __spark_entry__ as entry
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found(entry.queries()["op12_filter_interaction"](spark, sf_dir)) == brute(docs, labels)


def test_awkward_rows(spark, awkward, nothing):
    label_rows = [(1, 1, 0), (1, 0, 1), (5, 1, None), (None, 1, 1), (6, None, 1), (77, 1, 1)]
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int, toxic int")
    docs = [tuple(r) for r in awkward.select("doc_id", "text", "source").collect()]
    assert found(interaction_report(awkward, labels)) == brute(docs, label_rows)
    assert interaction_report(nothing, labels).count() == 0
    assert found(interaction_report(awkward, labels.limit(0))) == brute(docs, [])


def test_a_text_of_many_copies(spark):
    docs = [(k, prose(1, 250), "hot") for k in range(300)] + [(1000 + k, prose(k, 260), "cold") for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 1020, 5)]
    got = found(interaction_report(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic boolean")
                                   .withColumn("toxic", F.col("toxic").cast("int"))))
    assert got == brute(docs, [(d, q, int(t)) for d, q, t in labels])
