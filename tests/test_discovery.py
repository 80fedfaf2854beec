"""Extractors, merging and source metrics on small documents."""
import datetime as dt

from pyspark.sql import functions as F

from vacancia.operators import dedup, monitoring
from vacancia.sources import discovery as src


def lines(spark, *rows):
    return spark.createDataFrame([("d", i, x) for i, x in enumerate(rows)], "doc string, line_no bigint, line string")


def keys(df):
    return [(r.ats_type, r.slug, r.name) for r in df.orderBy("doc", "line_no", "pos").collect()]


def test_markdown_takes_first_board_per_line_and_cell_name(spark):
    df = lines(spark, "| [Acme](https://acme.com) | x | [Apply](https://jobs.lever.co/acme) |",
               "no table https://jobs.lever.co/skip",
               "| Plain | https://boards.greenhouse.io/Plain/jobs/1 https://jobs.lever.co/second |")
    assert keys(src.from_markdown(df)) == [("lever", "acme", "Acme"), ("greenhouse", "plain", "plain")]


def test_readme_names_and_last_line(spark):
    df = lines(spark, "| **Bold Co** | [go](https://jobs.ashbyhq.com/bold). |", "https://jobs.lever.co/last)")
    assert keys(src.from_readme(df)) == [("ashby", "bold", "Bold Co"), ("lever", "last", "last")]


def test_crawl_rows(spark):
    df = lines(spark, '{"slug":"S","ats_type":"lever","url":"u","source":"github:x"}',
               '{"url":"https://jobs.lever.co/plain"}', "not json", "")
    got = [(r.slug, r.source_type, r.source_detail) for r in src.from_crawl_jsonl(df).orderBy("line_no").collect()]
    assert got == [("S", "github", "github:x"), ("plain", "common_crawl", "CC-MAIN")]


def test_cluster_blocks_can_include_the_preceding_block(spark):
    df = lines(spark, "aa,x)/ 1\ts0\t0\t5", "co,lever,jobs)/a 1\ts1\t5\t7", "zz)/ 1\ts2\t12\t3", "short\tline")
    assert src.cluster_blocks(df).count() == 1
    both = src.cluster_blocks(df, include_preceding=True).filter("surt_prefix = 'co,lever,jobs)'").collect()
    assert sorted(r.shard for r in both) == ["s0", "s1"]


def test_first_source_in_precedence_order_wins(spark):
    a = src.from_url_list(lines(spark, "https://jobs.lever.co/one"))
    b = src.from_readme(lines(spark, "| Two | https://jobs.lever.co/one https://jobs.lever.co/two |"))
    merged = {r.slug: r.name for r in dedup.merge_sources([a, b.withColumn("source_type", F.lit("hn"))]).collect()}
    assert merged == {"one": "one", "two": "Two"}
    new = {r.source_type: (r.found, r.new) for r in dedup.new_per_source(
        [a, b.withColumn("source_type", F.lit("hn"))]).collect()}
    assert new == {"oss_list": (1, 1), "hn": (2, 1)}


def test_source_metrics_ties_count_for_every_source(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", "x", t), (1, "b", "x", t), (2, "a", "x", t), (2, "a", "y", t)],
                               "company_id bigint, source_type string, source_detail string, discovered_at timestamp")
    got = {r.source_type: tuple(r)[1:] for r in monitoring.source_metrics(df).collect()}
    assert got == {"a": (2, 1, 2), "b": (1, 0, 1)}
    assert [tuple(r) for r in monitoring.source_overlap(df).collect()] == [("a", "b", 1)]


def test_exposition_escapes_labels(spark):
    df = spark.createDataFrame([("m", {"k": 'a"b\\c'}, 2.0), ("m", {}, 0.5)],
                               "name string, labels map<string,string>, value double")
    out = {r.line for r in monitoring.exposition(df, {"m": "Help."}).collect()}
    assert out == {"# HELP vacancia_m Help.", "# TYPE vacancia_m gauge", "vacancia_m 0.5",
                   'vacancia_m{k="a\\"b\\\\c"} 2'}


def test_line_order_does_not_depend_on_the_splits(spark, tmp_path):
    """One file read whole and in many splits gives the same first rows."""
    from vacancia.operators.dedup import dedup_first
    from vacancia.sources.landing import read_lines

    (tmp_path / "list.txt").write_text("".join(f"{i % 97},{'x' * (i % 11)}\n" for i in range(4000)))
    key, key_cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before, found = (spark.conf.get(key), spark.conf.get(key_cost)), []
    try:
        for size in ("128m", "900b", "333b"):
            spark.conf.set(key, size)
            spark.conf.set(key_cost, "1b")
            lines = read_lines(spark, f"{tmp_path}/list.txt")
            assert lines.select("line_no").distinct().count() == 4000
            keyed = lines.selectExpr("split(line, ',')[0] ats_type", "'s' slug", "doc", "line_no", "0 pos", "line")
            found.append(sorted((r.ats_type, r.line) for r in dedup_first(keyed).collect()))
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set(key_cost, before[1])
    assert found[0] == found[1] == found[2]
    assert found[0] == sorted((str(i), f"{i},{'x' * (i % 11)}") for i in range(97))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_new_per_source_reads_each_source_once(spark):
    def source(k):
        return src.from_url_list(spark.range(k).selectExpr(
            "'d' doc", "id line_no", "concat('https://jobs.lever.co/c', id) line"))
    df = dedup.new_per_source([source(20), source(30).withColumn("source_type", F.lit("hn"))])
    assert plan(df).count("Range (") == 2
    assert {r.source_type: (r.found, r.new) for r in df.collect()} == {"oss_list": (20, 20), "hn": (30, 10)}


def test_derived_text_is_made_once(spark):
    """No test on a text is pushed below the projection that makes it."""
    rows = spark.range(10).selectExpr("'d' doc", "id line_no", "id thread_id", "id comment_no", "concat('M@DE ', id) line",
                                      "concat('M@DE ', id) comment_html", "'who is hiring' title", "now() created_at")
    for df in (src.from_markdown(rows), src.from_readme(rows), src.from_url_list(rows), src.from_cdx(rows),
               src.from_threads(rows.select("thread_id", "title", "created_at"), rows, F.now())):
        assert plan(df).count("M@DE") == 1


def test_url_ends(spark):
    rows = lines(spark, "(https://a.b/c..", "https://a.b/d.\u0085", "https://a.b/e\u2028", "https://a.b/f.x")
    from vacancia.functions.urls import extract_urls
    got = [r.u for r in rows.select("line_no", extract_urls(F.col("line"), "text").alias("u")).orderBy("line_no").collect()]
    assert got == [["https://a.b/c"], ["https://a.b/d\u0085"], ["https://a.b/e\u2028"], ["https://a.b/f.x"]]


def test_first_pattern_in_order_wins(spark):
    from vacancia.functions.urls import parse_board_url
    rows = lines(spark, "https://x.workable.com/?r=JOBS.lever.co/abc", "https://boards.greenhouse.io/?r=apply.workable.com/q",
                 "https://apply.workable.com/", "none")
    got = [r.b and (r.b.ats_type, r.b.slug) for r in rows.select("line_no", parse_board_url(F.col("line")).alias("b"))
           .orderBy("line_no").collect()]
    assert got == [("lever", "abc"), ("workable", "q"), None, None]
