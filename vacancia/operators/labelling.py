"""Labelling as a job that can be repeated: sample, leave out what is labelled, prompt in batches, append.

A run's candidates and their batches are drawn once and stored under the run's id. Answers are
appended in groups of batches, each group in one commit, with the run and the batch on every label. A run
that broke off goes on with the batches that have no labels yet; a run that is
repeated finds none, and a later run draws no labelled key again.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators.dedup import first_job_per_title
from vacancia.operators.qualify import assign_batches, build_prompts, decode_labels, score_with
from vacancia.operators.sampling import stratified_sample
from vacancia.session import reliable
from vacancia.streaming.tables import BatchLog

KEY = ("company_slug", "title")
PLAN = "company_slug string, title string, job_id bigint, batch_id bigint, job_no bigint, run_id string"
LABELS = ("key string, verdict string, rationale string, labeler_id string, labeled_at timestamp, run_id string, "
          "batch_id bigint")


def label_key(slug: Column, title: Column) -> Column:
    return F.concat(slug, F.lit("/"), title)


@dataclass
class LabelJob:
    """Labels of one labeler below ``path``.

    ``scorer`` maps a pandas frame of prompts (batch_id, n_jobs, prompt) to answers (batch_id, response,
    latency_ms, error). ``group`` batches are asked and committed at a time.
    """

    spark: SparkSession
    path: str
    labeler_id: str
    scorer: Callable
    preamble: str
    size: int = 10
    limit: int = 1500
    group: int = 100

    def __post_init__(self) -> None:
        self.plans = BatchLog(self.spark, f"{self.path}/plans")
        self.log = BatchLog(self.spark, f"{self.path}/labels")

    def labels(self) -> DataFrame:
        return self.log.rows(LABELS)

    def candidates(self, results: DataFrame, jobs: DataFrame, labelled: DataFrame | None, n: int, seed: int) -> DataFrame:
        """Sampled results without those that are labelled, with the first posting of each title.

        The sample is drawn first, so a later run gets what the sample has left, not a fresh ``n``.
        """
        done = self.labels().select("key")
        if labelled is not None:
            done = done.unionByName(labelled.filter(F.col("labeler_id") == self.labeler_id).select("key"))
        keyed = results.withColumn("key", label_key(F.col("company_slug"), F.col("title")))
        sample = stratified_sample(keyed, n, seed, *KEY).join(done.distinct(), "key", "left_anti")
        return sample.select(*KEY).join(first_job_per_title(jobs), list(KEY))

    def _plan(self, run_id: str, results: DataFrame, jobs: DataFrame, labelled: DataFrame | None, n: int, seed: int) -> DataFrame:
        mine = self.plans.rows(PLAN).filter(F.col("run_id") == run_id)
        if all(e["query"] != run_id for e in self.plans.version().entries) and run_id not in self.plans.version().merged:
            rows = reliable(self.candidates(results, jobs, labelled, n, seed).select(*KEY, "job_id"))
            batched = assign_batches(rows, list(KEY), self.size).select(*KEY, "job_id", "batch_id", "job_no", F.lit(run_id).alias("run_id"))
            self.plans.append(batched, 0, run_id)
            mine = self.plans.rows(PLAN).filter(F.col("run_id") == run_id)
        return mine

    def run(self, run_id: str, results: DataFrame, jobs: DataFrame, labelled: DataFrame | None = None, n: int = 60,
            seed: int = 0, labeled_at: Column | None = None) -> int:
        """Label what the run has left to label; the number of prompts that were asked.

        ``results`` has the latest result per title, ``jobs`` (job_id, company_slug, title, location, department, description).
        """
        plan = self._plan(run_id, results, jobs, labelled, n, seed)
        asked = 0
        while True:
            done = self.labels().filter(F.col("run_id") == run_id).select("batch_id").distinct()
            left = plan.join(done, "batch_id", "left_anti")
            first = [r["batch_id"] for r in left.select("batch_id").distinct().orderBy("batch_id").limit(self.group).collect()]
            if not first:
                return asked
            part = left.filter(F.col("batch_id").between(first[0], first[-1]))
            texts = jobs.select("job_id", "location", "department", "description")
            batch = part.join(texts, "job_id")
            prompts = build_prompts(batch, self.preamble, self.limit, True)
            answers = reliable(score_with(prompts, self.scorer))       # a model is asked once
            made = decode_labels(part.drop("run_id"), answers).select(
                label_key(F.col("company_slug"), F.col("title")).alias("key"), "verdict", "rationale",
                F.lit(self.labeler_id).alias("labeler_id"),
                (F.current_timestamp() if labeled_at is None else labeled_at).alias("labeled_at"),
                F.lit(run_id).alias("run_id"), "batch_id")
            self.log.append(made, first[0], run_id)
            asked += len(first)
