"""The matching loop: unscored postings to scored results, run by run."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacancia.candidate import Profile
from vacancia.operators.dedup import exclude_seen
from vacancia.operators.qualify import (assign_batches, build_prompts, decode_responses,
                                        gated_results, qualify_gate, qualify_preamble, score_with)
from vacancia.operators.retrieval import FEATURES, best_first, rerank, retrieve_and_rerank, score_hits
from vacancia.session import reliable
from vacancia.streaming.termindex import KEY, TermIndex

RUN_COLUMNS = ("company_slug", "title", "url", "location", "qualified", "score", "band",
               "hard_failures", "reasoning", "evidence", "latency_ms", "features")


def _scored_run(best: DataFrame, profile: Profile, scorer: Callable, batch: int, text: str) -> DataFrame:
    """Ranked postings, gated and scored in batches."""
    features = F.struct("bm25_score", *FEATURES, "combined")
    gated = qualify_gate(best.withColumn("features", features), profile, text=text)
    # Scored once: the prompts and the decoded rows must see the same batches.
    batches = reliable(assign_batches(gated.filter("disposition = 'score'").drop("reasoning"),
                                      ["job_id"], batch))
    prompts = build_prompts(batches, qualify_preamble(profile))
    scored = decode_responses(batches, score_with(prompts, scorer))
    return scored.select(*RUN_COLUMNS).unionByName(gated_results(gated).select(*RUN_COLUMNS))


def _kept(text: str) -> tuple[str, ...]:
    return ("company_slug", "title", "url", "location", "department", "description") + (
        () if text == "description" else (text,))


def matching_tick(jobs: DataFrame, runs: DataFrame | None, profile: Profile,
                  scorer: Callable, k: int = 500, n: int = 30, batch: int = 20,
                  min_new: int = 50, text: str = "raw_json") -> DataFrame | None:
    """One loop step from whole tables; none when fewer than ``min_new`` postings are unscored.

    ``jobs`` has (job_id, company_slug, title, url, location, department,
    description, text).
    """
    fresh = jobs if runs is None else exclude_seen(jobs, runs)
    if len(fresh.select("job_id").take(min_new)) < min_new:
        return None
    best = retrieve_and_rerank(fresh, profile, k, n, text=text, keep=_kept(text))
    return _scored_run(best, profile, scorer, batch, text)


def indexed_tick(index: TermIndex, jobs: DataFrame, scorer: Callable, k: int = 500, n: int = 30, batch: int = 20,
                 min_new: int = 50) -> DataFrame | None:
    """The same step from a maintained index: narrow rows and sums are read, and the texts of ``n`` winners.

    The winners' ids are pushed to the scan of ``jobs``.
    """
    if index.open_count() < min_new:
        return None
    scored = score_hits(index.open_rows().drop(*KEY), index.terms, stats=index.corpus())
    chosen = reliable(rerank(scored, k, n))
    ids = [r["job_id"] for r in chosen.select("job_id").collect()]
    texts = jobs.filter(F.col("job_id").isin(ids)).select("job_id", *_kept(index.text))
    best = texts.join(chosen, "job_id").orderBy(*best_first("job_id"))
    return _scored_run(best, index.profile, scorer, batch, index.text)


def matching_stream(arrivals: DataFrame, index: TermIndex, load_jobs: Callable, load_runs: Callable,
                    save_run: Callable, scorer: Callable, checkpoint: str, interval: str = "5 minutes",
                    available_now: bool = False, **options) -> StreamingQuery:
    """Take arriving postings into ``index`` and run a tick per trigger.

    ``load_jobs(spark)`` returns the stored postings, ``load_runs(spark, batch_id)`` the runs
    stored before this batch (or none), ``save_run`` stores a run under its batch number
    and replaces it on a retry. Titles of stored runs leave the index.
    """
    def step(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        index.apply(batch_id, df, scored=load_runs(spark, batch_id))
        out = indexed_tick(index, load_jobs(spark), scorer, **options)
        if out is not None:
            save_run(out, batch_id)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(
        **trigger).start()
