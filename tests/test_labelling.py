"""The label job: drawn once, resumed where it broke off, never labelled twice."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vacancia.operators.labelling import LabelJob


def tables(spark, n=120):
    results = spark.range(n).selectExpr(
        "concat('co', id % 7) AS company_slug", "concat('Job ', id) AS title", "cast(id * 37 % 101 AS double) AS score",
        "1.0D AS latency_ms", "cast(array() AS array<string>) AS hard_failures")
    jobs = spark.range(n).selectExpr(
        "id AS job_id", "concat('co', id % 7) AS company_slug", "concat('Job ', id) AS title", "'x' AS location",
        "cast(null AS string) AS department", "concat('text ', id) AS description")
    return results, jobs


def answers(frame):
    return pd.DataFrame({"batch_id": frame["batch_id"], "response": [
        "[" + ",".join('{"verdict":"fit","rationale":"r"}' for _ in range(int(n))) + "]" for n in frame["n_jobs"]],
        "latency_ms": 1.0, "error": None})


def test_a_repeated_run_asks_nothing(spark, tmp_path):
    results, jobs = tables(spark)
    job = LabelJob(spark, f"file://{tmp_path}/l", "m1", answers, "rubric", size=5, group=3)
    assert job.run("a", results, jobs, n=60, seed=1) == 12
    first = sorted(map(str, job.labels().collect()))
    assert len(first) == 60 and job.labels().select("key").distinct().count() == 60
    assert job.run("a", results, jobs, n=60, seed=1) == 0              # the same run
    assert job.run("b", results, jobs, n=60, seed=1) == 0              # another run, the same sample
    assert sorted(map(str, job.labels().collect())) == first
    assert job.run("c", results, jobs, n=90, seed=1) == 6              # a larger sample: what is left of it
    assert job.labels().select("key").distinct().count() == job.labels().count() == 90


def test_a_run_that_broke_off_resumes(spark, tmp_path):
    results, jobs = tables(spark)

    def breaks(frame):
        if (frame["batch_id"] >= 7).any():
            raise RuntimeError("the model is away")
        return answers(frame)
    broken = LabelJob(spark, f"file://{tmp_path}/l", "m1", breaks, "rubric", size=5, group=2)
    with pytest.raises(Exception, match="the model is away"):
        broken.run("a", results, jobs, n=60, seed=1)
    there = broken.labels().select("batch_id").distinct().count()
    assert there == 6                                                   # three groups of two are committed
    # The plan is the run's own: results that came since then don't change its batches.
    more = results.unionByName(results.withColumn("title", F.concat("title", F.lit(" new"))))
    job = LabelJob(spark, f"file://{tmp_path}/l", "m1", answers, "rubric", size=5, group=2)
    assert job.run("a", more, jobs, n=60, seed=1) == 12 - there
    labels = job.labels()
    assert labels.count() == labels.select("key").distinct().count() == 60
    assert labels.groupBy("batch_id").count().filter("count <> 5").count() == 0


def test_labels_given_from_elsewhere_and_an_empty_sample(spark, tmp_path):
    results, jobs = tables(spark, 30)
    given = results.select(F.concat("company_slug", F.lit("/"), "title").alias("key"), F.lit("m1").alias("labeler_id"))
    job = LabelJob(spark, f"file://{tmp_path}/l", "m1", answers, "rubric")
    assert job.run("a", results, jobs, given, n=60) == 0 and job.labels().count() == 0
    assert job.run("b", results, jobs, given.withColumn("labeler_id", F.lit("other")), n=60) == 3
