import zlib

import numpy as np

from vacancia.llm.langid import codewords, fit_model, held_out, identify, predict_languages, profile, train


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 40):
        code = codewords(n)
        apart = (code[:, None] != code[None]).sum(axis=2)
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n < 3 else 2)
        assert all(abs(c.sum()) < n for c in code.T)


def test_profiles_read_the_whole_text(monkeypatch):
    from vacancia.llm import langid
    text = "the quick Brown fox, jumps 123 over; " * 200 + "ÄÖÜ ende"
    whole = profile(text)
    monkeypatch.setattr(langid, "_STEP", 64)
    assert np.allclose(whole, profile(text)) and not np.allclose(whole, profile(text[:100]))
    assert not profile("").any()


def test_held_out_accuracy_and_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    kept = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in kept) / len(kept) > 0.95


def test_labels_of_held_out_documents_are_not_learned(spark):
    rows = [(k, "alpha beta gamma" if k % 2 else "uno dos tres", "en" if k % 2 else "es") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = df.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 THEN 'xx' ELSE lang END AS lang")
    assert train(wrong).languages == ["en", "es"]
    assert {r["lang_pred"] for r in identify(wrong).collect()} == {"en", "es"}


def test_one_language_and_ambiguity():
    one = fit_model(np.stack([profile("hello there"), profile("good day")]), ["en", "en"])
    best, score, unsure = one.decode(profile("whatever")[None])
    assert one.languages[best[0]] == "en" and score[0] == 1 and not unsure[0]
    texts = ["the cat and the dog"] * 8 + ["der hund und die katze"] * 8
    two = fit_model(np.stack([profile(t) for t in texts]), ["en"] * 8 + ["de"] * 8)
    _, _, unsure = two.decode(np.stack([profile(t) for t in ("the cat and the dog", "the cat and the dog der hund und die katze")]))
    assert unsure.tolist() == [False, True]


def test_awkward_rows(awkward, nothing):
    got = identify(awkward).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0) for r in awkward.collect())
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (2, 3, 4))
    assert by_id[1]["lang_pred"] == "en"
    assert identify(nothing).count() == 0 and train(nothing) is None
    assert {r["lang_pred"] for r in predict_languages(awkward, None).collect()} == {"und"}
    assert awkward.filter(held_out(awkward["doc_id"])).count() > 0
