"""Payload normalisation, conformance and upserts."""
import datetime as dt
import json

from pyspark.sql import functions as F

from vacancia.operators import upsert
from vacancia.sources import boards, landing

PAYLOAD = "ats_type string, slug string, body string"


def rows(spark, *items):
    return spark.createDataFrame(list(items), PAYLOAD)


def test_greenhouse_prefers_first_published_and_keeps_unknown_fields(spark):
    body = json.dumps({"jobs": [
        {"id": 7, "title": "T", "absolute_url": "u", "updated_at": "2024-02-01T00:00:00Z",
         "first_published": "2024-01-01T00:00:00-05:00", "location": {"name": "L"},
         "departments": [{"id": 1, "name": "D"}], "custom": {"a": [1, 2]}},
        {"id": 8, "title": "T2", "absolute_url": "u2", "updated_at": "2024-02-01T00:00:00Z"}]})
    out = {r.external_id: r for r in boards.normalize_vendor(
        rows(spark, ("greenhouse", "co", body)), "greenhouse").collect()}
    assert out["7"].posted_at == dt.datetime(2024, 1, 1, 5) and out["7"].department == "D"
    assert json.loads(out["7"].raw_json)["custom"] == {"a": [1, 2]}
    assert out["8"].location is None and out["8"].department is None


def test_ashby_null_board_is_conformant_and_empty(spark):
    df = rows(spark, ("ashby", "co", '{"data":{"jobBoard":null}}'), ("ashby", "co", '{"data":{}}'),
              ("ashby", "co", '{"data":{"jobBoard":{"jobPostings":[{"id":"i","title":"t",'
                              '"locationName":"x"}]}}}'))
    verdicts = [(r.conformant, r.n_postings) for r in boards.payload_conformance(df).collect()]
    assert verdicts == [(True, 0), (False, None), (True, 1)]
    assert [r.url for r in boards.normalize_vendor(df, "ashby").collect()] == [
        "https://jobs.ashbyhq.com/co/i"]


def test_one_bad_element_rejects_the_response(spark):
    good = '{"id":"a","text":"t","hostedUrl":"u","createdAt":1706918706123}'
    bad = '{"id":"b","text":"t","hostedUrl":"u","createdAt":"x"}'
    df = rows(spark, ("lever", "co", f"[{good}]"), ("lever", "co", f"[{good},{bad}]"),
              ("lever", "co", "[]"), ("lever", "co", "not json"), ("lever", "co", '{"a":1}'))
    got = [(r.conformant, r.reason) for r in boards.payload_conformance(df).collect()]
    assert [g[0] for g in got] == [True, False, True, False, False]
    out = boards.normalize_postings(df).collect()
    assert [(r.external_id, r.posted_raw) for r in out] == [("a", "2024-02-03T00:05:06.123Z")]


def test_missing_list_and_malformed_are_quarantined(spark):
    df = rows(spark, ("workable", "c", '{"name":"x"}'), ("workable", "c", '{"jobs":['),
              ("greenhouse", "c", '{"jobs":[]}'), ("greenhouse", "c", '{"data":[],"meta":{}}'))
    assert [r.conformant for r in boards.payload_conformance(df).collect()] == [
        False, False, True, False]


JOB = ("company_id bigint, external_id string, title string, first_seen_at timestamp, "
       "updated_at timestamp")


def ts(day):
    return dt.datetime(2024, 1, day)


def test_upsert_keeps_first_seen_and_never_goes_back(spark):
    old = spark.createDataFrame([(1, "a", "old", ts(1), ts(5))], JOB)
    new = spark.createDataFrame([(1, "a", "late arrival", ts(4), ts(4)),
                                 (1, "b", "v1", ts(6), ts(6)), (1, "b", "v2", ts(7), ts(7))], JOB)
    out = {r.external_id: r for r in upsert.upsert_jobs(old, new).collect()}
    assert out["a"].title == "old" and out["a"].first_seen_at == ts(1) and not out["a"].is_new
    assert out["b"].title == "v2" and out["b"].first_seen_at == ts(6) and out["b"].is_new


def test_upsert_is_idempotent_and_ignores_partitioning(spark):
    new = spark.createDataFrame([(i % 5, str(i % 7), f"t{i}", ts(1 + i % 9), ts(1 + i % 9))
                                 for i in range(200)], JOB).withColumn("seq", F.lit(1))
    once = upsert.upsert_jobs(None, new).drop("is_new")
    assert upsert.rows_added(once, upsert.upsert_jobs(once, new)).first().dedup_rate == 0
    assert upsert.first_seen_violations(once, upsert.upsert_jobs(once, new)).first().violations == 0
    keys = ["company_id", "external_id", "updated_at"]
    sets = [{tuple(r) for r in upsert.upsert_jobs(None, new.repartition(n)).select(*keys).collect()}
            for n in (1, 4, 16)]
    assert sets[0] == sets[1] == sets[2]


def test_delta_upsert_equals_the_full_one(spark):
    old = spark.createDataFrame([(i, "a", f"o{i}", ts(1), ts(3)) for i in range(20)], JOB)
    new = spark.createDataFrame([(i, "a", f"n{i}", ts(4), ts(2 + i % 4)) for i in range(15, 25)], JOB)
    cols = ["company_id", "external_id", "title", "first_seen_at", "updated_at", "is_new"]
    rows = [sorted(map(tuple, f(old, new).select(*cols).collect()))
            for f in (upsert.upsert_jobs, upsert.upsert_jobs_delta)]
    assert rows[0] == rows[1]


def test_reposts_stay_separate(spark):
    new = spark.createDataFrame([(1, "ORIG", "Same", ts(1), ts(1)), (1, "AGAIN", "Same", ts(2), ts(2))], JOB)
    assert upsert.upsert_jobs(None, new).count() == 2


def test_discovery_keeps_first_name_and_last_url(spark):
    found = spark.createDataFrame(
        [("A", "s", "lever", "u1", ts(1), 1, "hn", "d"), ("B", "s", "lever", "u2", ts(2), 2, "yc", "d"),
         ("B", "s", "lever", "u3", ts(2), 3, "hn", "d")],
        "name string, slug string, ats_type string, ats_url string, seen_at timestamp, seq bigint, "
        "source_type string, source_detail string")
    row = upsert.discover_companies(None, found).first()
    assert (row.name, row.ats_url, row.discovered_at, row.is_new) == ("A", "u3", ts(1), True)
    again = upsert.discover_companies(upsert.discover_companies(None, found), found).collect()
    assert len(again) == 1 and not again[0].is_new
    assert upsert.discover_sources(None, found).count() == 2


def test_payload_files(spark, tmp_path):
    folder = tmp_path / "greenhouse"
    folder.mkdir()
    (folder / "acme.json").write_text('{"jobs":\n[]}')
    row = landing.read_payload_files(spark, str(tmp_path)).first()
    assert (row.ats_type, row.slug, row.body) == ("greenhouse", "acme", '{"jobs":\n[]}')


def test_lines_keep_file_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    lines = landing.read_lines(spark, str(tmp_path)).orderBy("doc", "line_no").collect()
    assert [r.line for r in lines] == ["one", "two", "three"]


def test_one_scan_of_the_bodies(spark, sf_dir):
    """The dispatch by vendor reads the bodies once, for postings, verdicts and both together."""
    import __spark_entry__ as entry
    for name in ("s7_normalize_postings", "x1_adapter_registry", "p22_poll_status"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("orders.parquet") <= 1 and plan.count("Relation [") == 1, name
