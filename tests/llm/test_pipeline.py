import corpus_pipeline
from tests.llm.conftest import prose
from vacancia.llm.simhash import near_duplicates


def test_stages_take_effect(spark, tmp_path):
    token = "token = " + "0123456789abcdef" * 2
    rows = [(1, prose(1, 300)), (2, prose(1, 300)), (3, "### " * 90), (4, prose(4, 300) + " " + token), (5, "short"),
            (6, prose(6, 200)), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], None).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert seen[-1].columns == docs.columns
    ids = [sorted({r["doc_id"] for r in s.collect()}) for s in seen]
    assert ids == [[1, 2, 3, 4, 5, 6, 7], [1, 2, 4, 6], [1, 4, 6], [1, 4, 6], [1, 4, 6], [1, 4, 6]]
    masked = {r["doc_id"]: r for r in seen[3].collect()}
    assert masked[4]["text"].endswith("[SECRET]") and masked[4]["n_chars"] == len(masked[4]["text"])
    assert near_duplicates(seen[2]).select("component_id").distinct().count() == seen[2].count()


def test_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    for name, docs in (("a", awkward), ("n", nothing)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, None).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert docs.count() == 0


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and len({r["doc_id"] for r in rows}) <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
