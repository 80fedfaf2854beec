import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from vacancia.llm import fingerprints as fp
from vacancia.llm.ranges import id_bounds, range_number


def edited(rows):
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    for k, r in enumerate(order):
        t, after = r["text"] or "", order[(k + 1) % len(order)]["text"] or ""
        half = len(t) // 2
        yield r["doc_id"], len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


@pytest.mark.parametrize("range_rows", [1, 3, 1000])
def test_the_next_document(awkward, monkeypatch, range_rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", range_rows)
    got = fp.fingerprint_report(awkward).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(edited(awkward.collect()), key=str)


def test_null_ids_one_row_and_no_row(spark, awkward, nothing):
    assert fp.fingerprint_report(nothing).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")
    assert fp.fingerprint_report(one).first()["near_next"] == 1.0
    none = spark.createDataFrame([(None, "b"), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in fp.fingerprint_report(none).select("doc_id", "n_chars", "edited_sha256").collect()), key=str)
    assert got == sorted(edited(none.collect()), key=str)


def test_sketches(spark):
    a, b = prose(1, 3000), prose(2, 3000)
    df = spark.createDataFrame([(a, a + " " + b, b)], "a string, ab string, b string")
    s = {c: fp.sketch(F.col(c)) for c in df.columns}
    r = df.select(
        fp.resemblance(s["a"], s["a"]).alias("same"), fp.resemblance(s["a"], s["b"]).alias("apart"),
        fp.resemblance(s["a"], s["ab"]).alias("half"), fp.containment(s["a"], s["ab"]).alias("inside"),
        F.size(s["a"]).alias("kept"), fp.fingerprint_string(s["a"]).alias("text"), s["a"].alias("s"),
        (fp.merge_sketches(s["a"], s["b"]) == F.sort_array(F.array_union(s["a"], s["b"]))).alias("merged")).first()
    assert r["same"] == 1 and r["apart"] == 0 and abs(r["half"] - 0.5) < 0.08 and r["inside"] > 0.99
    assert abs(r["kept"] - 3000 / fp.SCALE) < 80 and r["merged"] is not False
    assert len(r["text"]) == 16 * r["kept"] and all(0 <= h < 2 ** 64 // fp.SCALE for h in r["s"])


def test_short_texts_are_never_empty_sketches(awkward):
    rows = fp.fingerprint_report(awkward).collect()
    assert all(r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by_text = {}
    for r in awkward.select("doc_id", "text").collect():
        by_text.setdefault(r["text"] or "", set()).add(r["doc_id"])
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[1] == prints[5]


def test_likeness_is_near_the_true_resemblance(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars > 8000")
    got = {r["doc_id"]: r["near_edited"] for r in fp.fingerprint_report(docs).collect()}
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    for k, r in enumerate(rows):
        t, after = r["text"], rows[(k + 1) % len(rows)]["text"]
        half = len(t) // 2
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split(), (t[: len(t) - half] + after[:half]).split()))
        assert abs(got[r["doc_id"]] - len(x & y) / len(x | y)) < 0.15


def test_ranges(spark):
    df = spark.createDataFrame([(k * k,) for k in range(500)] + [(None,)], "k long")
    bounds = id_bounds(df, "k", 40)
    assert bounds[-1] == 499 ** 2 and set(bounds) <= {k * k for k in range(500)}
    got = df.select("k", range_number(F.col("k"), bounds).alias("n")).collect()
    assert all(r["n"] == (0 if r["k"] is None else sum(b < r["k"] for b in bounds)) for r in got)
