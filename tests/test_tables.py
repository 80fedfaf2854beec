"""The log of batches: versions, merging, retention, retries and new checkpoints."""
import pytest
from pyspark.sql import functions as F

from vacancia.streaming import rates
from vacancia.streaming.tables import BatchLog, query_of


def rows(spark, batch, n=5):
    return spark.range(n).selectExpr(f"{batch} AS batch", "id % 3 AS k", "1L AS n")


def counts(df):
    return {(r["k"]): r["n"] for r in df.groupBy("k").agg(F.sum("n").alias("n")).collect()}


def summed(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def test_results_are_equal_before_and_after_merging(spark, tmp_path):
    log = BatchLog(spark, f"file://{tmp_path}/t", lambda d: summed(d), fanout=4, keep=2)
    plain = BatchLog(spark, f"file://{tmp_path}/p", fanout=1000)
    for b in range(22):
        part = summed(rows(spark, b, b + 1))
        log.append(part, b, "q")
        plain.append(part, b, "q")
        assert counts(log.rows("k bigint, n bigint")) == counts(plain.rows("k bigint, n bigint"))
    now = log.version()
    assert [e["level"] for e in now.entries] == [2, 1, 0, 0] and now.merged == {"q": 19}
    assert len(plain.version().entries) == 22
    named = {e["folder"] for n in log.versions() for e in log.version(n).entries}
    assert {f"data/{n}" for n in log.folder.names("data")} == named and len(named) <= 3 * 4 + 4
    assert len(log.versions()) == 2


def test_a_lost_or_repeated_batch(spark, tmp_path):
    log = BatchLog(spark, f"file://{tmp_path}/t", fanout=4)
    for b in range(3):
        log.append(rows(spark, b), b, "q")
    # An attempt that wrote its rows and broke off before the commit is not seen, and goes with the next commit.
    rows(spark, 3).write.parquet(f"file://{tmp_path}/t/data/00000003-broken")
    assert log.rows("batch int, k bigint, n bigint").count() == 15
    # The last batch is repeated, with other rows.
    log.append(rows(spark, 2, 7), 2, "q")
    got = log.rows("batch int, k bigint, n bigint")
    assert got.count() == 17 and log.folder.names("data") and "00000003-broken" not in log.folder.names("data")
    # A batch that was merged with others is not written again.
    log.append(rows(spark, 3), 3, "q")
    assert log.version().merged == {"q": 3}
    assert log.append(rows(spark, 3), 3, "q") is False
    assert log.rows("batch int, k bigint, n bigint").count() == 22
    # A manifest that was only written in part is no version.
    (tmp_path / "t" / "manifest" / "000000000099.json.abc").write_text("{")
    assert log.rows("batch int, k bigint, n bigint").count() == 22


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    one = BatchLog(spark, f"file://{tmp_path}/t")
    one.append(rows(spark, 0), 0, "q")
    with pytest.raises(RuntimeError, match="another writer"):
        one._commit(type(one.version())(one.version().number - 1, [], {}))


def test_a_new_checkpoint_goes_on_from_the_last_version(spark, tmp_path):
    log = BatchLog(spark, f"file://{tmp_path}/t", fanout=4)
    for b in range(2):
        log.append(rows(spark, b), b, "first")
    log.append(rows(spark, 10), 0, "second")           # batch 0 of another query is another batch
    assert log.rows("batch int, k bigint, n bigint").count() == 15
    log.append(rows(spark, 20), 0, "third", restart=True)
    log.append(rows(spark, 21), 1, "third", restart=True)
    got = log.rows("batch int, k bigint, n bigint")
    assert {r["batch"] for r in got.collect()} == {20, 21}


def test_states(spark, tmp_path):
    log = BatchLog(spark, f"file://{tmp_path}/s", keep=2)
    schema = "batch int, k bigint, n bigint"
    assert log.state_before(schema, 0, "a") is None and log.state(schema).count() == 0
    for b in range(6):
        before = log.state_before(schema, b, "a")
        assert (before is None) == (b == 0) and (b == 0 or before.first()["batch"] == b - 1)
        log.replace(rows(spark, b), b, "a")
    assert log.state_before(schema, 5, "a").first()["batch"] == 4            # a retry starts where the first try did
    log.replace(rows(spark, 50), 5, "a")
    assert log.state(schema).first()["batch"] == 50
    assert log.state_before(schema, 0, "b").first()["batch"] == 50           # a new checkpoint goes on
    assert len(log.version().entries) == 2 and len(log.folder.names("data")) <= 4


@pytest.mark.parametrize("files", [1, 6])
def test_streams_know_their_query_and_fold_what_they_merge(spark, tmp_path, files, monkeypatch):
    from vacancia.streaming import tables
    monkeypatch.setattr(tables, "FANOUT", 2)
    events = spark.range(60).selectExpr("id", "timestamp_seconds(1700000000 + id * 600) AS at", "id % 2 AS k")
    for f in range(files):
        events.filter(F.col("id") % files == f).coalesce(1).write.parquet(f"{tmp_path}/in/f{f}")
    seen = []

    def partial(df):
        seen.append(query_of(df.sparkSession))
        return rates.tumbling_counts(df, "at", "1 hour", ("k",))
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(f"{tmp_path}/in"))
    query = rates.counting_stream(stream, partial, f"{tmp_path}/out", f"{tmp_path}/c", True)
    query.awaitTermination()
    assert set(seen) == {query.id} and len(seen) == files
    got = rates.folded(spark, f"{tmp_path}/out", "window_start timestamp, window_end timestamp, k bigint")
    want = rates.tumbling_counts(events, "at", "1 hour", ("k",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(BatchLog(spark, f"{tmp_path}/out").version().entries) == bin(files).count("1")
