"""Retrieval, re-ranking, prompts and decoding against plain Python."""
import math

import pytest
from pyspark.sql import functions as F

from vacancia.candidate import Profile
from vacancia.functions.text import tokenize_literal
from vacancia.operators import dedup, evaluation, qualify, retrieval, sampling

TEXTS = ["python and react work", "java java python", "nothing here", "React react REACT tags <b>x</b>",
         "python and react work", "long " * 40 + "python"]
TERMS = ["python", "react", "java"]


def brute_bm25(texts, terms):
    docs = [tokenize_literal(t) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for i, toks in enumerate(docs):
        score = 0.0
        for t in terms:
            tf = toks.count(t)
            if tf:
                df = sum(t in d for d in docs)
                idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
                score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avg))
        if score > 0:
            out[i] = round(score, 9)
    return out


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def test_bm25_matches_brute_force(spark):
    for materialize in (True, False):
        got = {r.doc_id: r.bm25_score for r in retrieval.bm25(
            docs(spark), TERMS, F.col("text"), materialize=materialize).collect()}
        want = brute_bm25(TEXTS, TERMS)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_many_profiles_agree_with_one(spark):
    queries = spark.createDataFrame([(1, t) for t in TERMS] + [(2, "java"), (2, "java")],
                                    "profile_id int, term string")
    got = retrieval.bm25_profiles(docs(spark), queries, F.col("text"), 3).collect()
    single = brute_bm25(TEXTS, TERMS)
    top = sorted(single, key=lambda i: (-single[i], i))[:3]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rn) if r.profile_id == 1] == top
    assert [r.doc_id for r in got if r.profile_id == 2] == [1]


@pytest.mark.parametrize("profiles, cells, pairs, terms", [(2, 60, 10 ** 6, 10 ** 6), (256, 10 ** 6, 10 ** 6, 0), (256, 300, 20, 10 ** 6)])
def test_blocks_and_bounds_change_nothing(spark, monkeypatch, profiles, cells, pairs, terms):
    """Small blocks that are skipped, several groups of profiles, several passes, a shuffled join: the rows of a plain scoring."""
    import random
    monkeypatch.setattr(retrieval, "MOST_TERMS", terms)
    monkeypatch.setattr(retrieval, "SCORE_PROFILES", profiles)
    monkeypatch.setattr(retrieval, "SCORE_CELLS", cells)
    monkeypatch.setattr(retrieval, "MOST_PAIRS", pairs)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(30)], k=rng.randint(0, 40))) for i in range(200)}
    texts.update({500 + i: texts[i] for i in range(20)})                  # ties
    wanted = {p: rng.sample(words, rng.randint(1, 8)) for p in range(9)} | {9: ["absent"]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(p, t) for p, ts in wanted.items() for t in ts], "profile_id int, term string")
    got = {}
    for r in retrieval.bm25_profiles(df, queries, F.col("text"), 7).collect():
        got.setdefault(r.profile_id, {})[r.rn] = (r.doc_id, r.bm25_score)
    for p, ts in wanted.items():
        ids = list(texts)
        scores = {ids[i]: v for i, v in brute_bm25(list(texts.values()), ts).items()}
        top = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:7]
        assert [got.get(p, {})[n][0] for n in sorted(got.get(p, {}))] == top


PROFILE = Profile(name="p", experience_years=2, role_targets=("backend",), strong=("python", "react"),
                  working=("java", "go"), hard_constraints=(("exclude_pattern", "senior"),))


def test_rerank_features(spark):
    df = spark.createDataFrame([
        (1, "Junior Backend Engineer", "Remote", "python, javascript; 2 years of experience", "{}"),
        (2, "Staff Platform Engineer", "Austin, TX", "x" * 60 + " 7 years experience", "{}"),
        (3, "Engineer", None, "5+ yrs of professional work", "{}"),
        (4, "Writer", "Berlin", "", "{}")],
        "job_id int, title string, location string, description string, raw_json string")
    got = {r.job_id: r for r in retrieval.with_features(df, PROFILE).collect()}
    assert (got[1].skill_overlap, got[1].level_match, got[1].location_match) == (0.5, 1.0, 1.0)
    assert (got[2].level_match, got[2].location_match, got[2].has_description) == (0.1, 0.8, 1.0)
    assert (got[3].level_match, got[3].title_relevance, got[3].location_match) == (0.1, 0.5, 1.0)
    assert (got[4].title_relevance, got[4].level_match, got[4].has_description) == (0.0, 0.7, 0.3)


def test_retrieve_drops_rejected_rows_from_the_corpus(spark):
    df = spark.createDataFrame(
        [(i, ("Senior " if i % 3 == 0 else "") + "Backend Engineer", None, None,
          TEXTS[i % len(TEXTS)], "{}") for i in range(30)],
        "job_id int, title string, location string, department string, description string, raw_json string")
    out = retrieval.retrieve_and_rerank(df, PROFILE, k=12, n=5).collect()
    assert len(out) == 5 and all(r.job_id % 3 for r in out)
    scores = [(r.combined, r.bm25_score, -r.job_id) for r in out]
    assert scores == sorted(scores, reverse=True)


def batched(spark, n=5, size=2):
    df = spark.createDataFrame([(i, f"Engineer {i}", "Oslo", None, "text") for i in range(n)],
                               "job_id bigint, title string, location string, department string, "
                               "description string")
    return qualify.assign_batches(df, ["job_id"], size)


def test_batches_and_prompts(spark):
    b = batched(spark)
    assert sorted((r.batch_id, r.job_no) for r in b.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)]
    p = {r.batch_id: r for r in qualify.build_prompts(b, "PRE").collect()}
    assert p[0].n_jobs == 2 and p[2].n_jobs == 1
    assert p[0].prompt.startswith("PRE\n\nPostings: 2\n\n<posting n=\"1\">\nEngineer 0 | ")
    assert " | -\n" in p[0].prompt


def test_decode_failure_modes(spark):
    responses = spark.createDataFrame([
        (0, '```json\n[{"qualified":true,"score":180,"reasoning":"r"}]\n```', 10.0, None),
        (1, "no json", 10.0, None), (2, None, 9.0, "boom")],
        "batch_id bigint, response string, latency_ms double, error string")
    out = {r.job_id: r for r in qualify.decode_responses(batched(spark), responses).collect()}
    assert (out[0].score, out[0].band, out[0].qualified, out[0].latency_ms) == (100.0, "push", True, 5.0)
    assert out[1].reasoning == "Missing from batch output"
    assert out[2].reasoning == out[3].reasoning == "Failed to parse batch output"
    assert out[4].reasoning == "Batch error: boom" and out[4].latency_ms == 9.0
    assert all(out[i].score == 0.0 and out[i].band == "skip" for i in (1, 2, 3, 4))


def test_decode_labels(spark):
    responses = spark.createDataFrame([
        (0, 'x [{"verdict":"FIT","rationale":"ok"},{"verdict":"??","rationale":5}] y', None),
        (1, "none", None), (2, None, "late")], "batch_id bigint, response string, error string")
    out = {r.job_id: (r.verdict, r.rationale) for r in qualify.decode_labels(batched(spark), responses).collect()}
    assert out == {0: ("fit", "ok"), 1: ("borderline", ""), 2: ("borderline", "parse error"),
                   3: ("borderline", "parse error"), 4: ("borderline", "labeler error: late")}


def test_ir_metrics(spark):
    def run(grades):
        score = {3: 80.0, 2: 50.0, 1: 30.0, 0: 5.0}
        return [score[g] for g in grades]
    lists = {"a": [3, 0, 2, 1, 0, 3], "none": [0, 0], "top": [3]}
    df = spark.createDataFrame([(k, i + 1, s, False) for k, g in lists.items() for i, s in enumerate(run(g))],
                               "run_id string, rank bigint, score double, hard_rejected boolean")
    got = {r.run_id: r for r in evaluation.ir_metrics(df).collect()}
    def dcg(g, k):
        return sum((2 ** x - 1) / math.log2(i + 2) for i, x in enumerate(g[:k]))
    a = lists["a"]
    assert abs(got["a"].ndcg_at_5 - dcg(a, 5) / dcg(sorted(a, reverse=True), 5)) < 1e-9
    assert got["a"].mrr == 1.0 and abs(got["a"].precision_at_5 - 2 / 5) < 1e-9
    assert abs(got["a"].map - (1 + 2 / 3 + 3 / 6) / 3) < 1e-9
    assert (got["none"].ndcg_at_5, got["none"].mrr, got["none"].recall_at_30, got["none"].map) == (1.0, 0.0, 1.0, 0.0)
    assert got["top"].precision_at_30 == 1.0


def test_samples_repeat_and_respect_quotas(spark):
    df = spark.createDataFrame([(i, "greenhouse" if i < 90 else "lever" if i < 97 else "ashby", True)
                                for i in range(100)], "company_id bigint, ats_type string, active boolean")
    one = sampling.proportional_sample(df, 30, 3).collect()
    assert one == sampling.proportional_sample(df.repartition(9), 30, 3).collect() or \
        {r.company_id for r in one} == {r.company_id for r in sampling.proportional_sample(
            df.repartition(9), 30, 3).collect()}
    counts = {}
    for r in one:
        counts[r.ats_type] = counts.get(r.ats_type, 0) + 1
    # 27 of 30 by share, then the minimum of five capped by what is left (3), then none.
    assert counts == {"greenhouse": 27, "lever": 3}


def test_first_and_latest_wins(spark):
    df = spark.createDataFrame([("k", 2, None), ("k", 1, "x"), ("j", 1, "y")], "key string, at int, value string")
    assert {r.key: r.at for r in dedup.dedup_first(df, ["key"], ["at"]).collect()} == {"k": 1, "j": 1}
    assert [r.key for r in dedup.latest_labels(df, ["key"], ["at"]).collect()] == ["j"]
