"""A posting index that is kept up to date batch by batch, for one candidate.

A posting's text is read once, when it arrives: what stays is a narrow row with its length, the
counts of the query terms in it, its re-rank features, and whether the constraints let
it pass. Corpus statistics (documents, lengths, document frequencies) are sums of signed
contributions: a batch adds those of its new rows and takes back those of the rows
that they replace, that were removed, or whose title a run has scored. A tick then reads narrow rows
and a handful of sums; texts are fetched for the winners only.

Three logs hold the index: rows by posting (the newest counts), statistics by term, and
scored titles. A batch is in all three or is written to all three again when it is retried; folders
are merged only when all three have it.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacancia.candidate import Profile, expand_query
from vacancia.operators.constraints import check_hard_constraints
from vacancia.operators.retrieval import FEATURES, query_hits, search_text, with_features
from vacancia.session import reliable
from vacancia.streaming.tables import BatchLog

KEY = ("company_slug", "title")
ROWS = ("job_id bigint, company_slug string, title string, open boolean, eligible boolean, doc_len bigint, "
        "hits array<struct<term: string, tf: int>>, " + ", ".join(f"{f} double" for f in FEATURES) + ", seq bigint")
STATS = "term string, df bigint, docs bigint, len bigint, open bigint"
SCORED = "company_slug string, title string"
#: The statistics row that has the totals instead of a term's count.
TOTALS = ""


def _newest(rows: DataFrame) -> DataFrame:
    last = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    return rows.withColumn("__turn", F.row_number().over(last)).filter("__turn = 1").drop("__turn")


def _summed(stats: DataFrame) -> DataFrame:
    return stats.groupBy("term").agg(*[F.sum(c).cast("long").alias(c) for c in ("df", "docs", "len", "open")])


def _contribution(rows: DataFrame, sign: int) -> DataFrame:
    """What open rows add to the statistics, or take back."""
    def times(c: Column) -> Column:
        return (c * sign).cast("long")
    passed = rows.filter("open and eligible")
    totals = rows.filter("open").select(
        F.lit(TOTALS).alias("term"), F.lit(0).cast("long").alias("df"), times(F.col("eligible").cast("long")).alias("docs"),
        times(F.when(F.col("eligible"), F.col("doc_len")).otherwise(0)).alias("len"), times(F.lit(1)).alias("open"))
    none = F.lit(0).cast("long")
    terms = passed.select(F.explode("hits.term").alias("term")).select(
        "term", times(F.lit(1)).alias("df"), none.alias("docs"), none.alias("len"), none.alias("open"))
    return totals.unionByName(terms)


@dataclass
class TermIndex:
    """The index below ``path`` for ``profile``; ``body`` is the text that is searched, ``text`` that of the constraints."""

    spark: SparkSession
    path: str
    profile: Profile
    body: str = "description"
    text: str = "raw_json"
    terms: list[str] | None = None
    fanout: int | None = None

    def __post_init__(self) -> None:
        self.terms = self.terms or expand_query(self.profile)
        self.rows_log = BatchLog(self.spark, f"{self.path}/rows", _newest, self.fanout)
        self.stats_log = BatchLog(self.spark, f"{self.path}/stats", _summed, self.fanout)
        self.scored_log = BatchLog(self.spark, f"{self.path}/scored", lambda rows: rows.distinct(), self.fanout)

    def narrow(self, postings: DataFrame) -> DataFrame:
        """One narrow row per posting (job_id, company_slug, title, location, department, body, text)."""
        words = search_text(F.col("title"), F.col("location"), F.col("department"), F.col(self.body))
        checked = check_hard_constraints(postings, self.profile, text=self.text).withColumnRenamed("passed", "eligible")
        narrow = with_features(query_hits(checked, self.terms, words), self.profile, self.body)
        return narrow.select("job_id", *KEY, "eligible", "doc_len", "hits", *[F.col(f).cast("double").alias(f) for f in FEATURES])

    def apply(self, batch_id: int, postings: DataFrame | None = None, removed: DataFrame | None = None,
              scored: DataFrame | None = None, query: str | None = None) -> None:
        """Take in a batch: new or changed postings (one row per job_id), ids of removed ones, scored titles.

        ``scored`` may hold all runs there are; titles that the index knows are left out. A posting whose title was
        scored before it came is never open. A posting that is put and removed in one batch is removed.
        """
        spark = self.spark
        logs = (self.rows_log, self.scored_log, self.stats_log)
        if any(log.has_merged(batch_id, query) for log in logs):
            for log in logs:
                log.merge()
            return
        prior = self.rows_log.before(ROWS, batch_id, query)
        prior = _newest(prior if prior is not None else spark.createDataFrame([], ROWS)).drop("seq")
        known = self.scored_log.before(SCORED, batch_id, query)
        known = known if known is not None else spark.createDataFrame([], SCORED)
        runs = spark.createDataFrame([], SCORED) if scored is None else scored.select(*KEY)
        fresh = reliable(runs.filter(" and ".join(f"{c} is not null" for c in KEY)).distinct().join(known, list(KEY), "left_anti"))
        gone = spark.createDataFrame([], "job_id bigint") if removed is None else removed.select(F.col("job_id").cast("long")).distinct()

        done = known.unionByName(fresh).distinct().withColumn("__done", F.lit(True))
        put = spark.createDataFrame([], ROWS).drop("seq", "open") if postings is None else self.narrow(postings)
        put = put.join(gone, "job_id", "left_anti").join(done, list(KEY), "left")
        put = put.withColumn("open", F.col("__done").isNull()).drop("__done")
        columns = [c for c in spark.createDataFrame([], ROWS).columns if c != "seq"]
        # Rows that close without new content: removed, or scored since the last batch.
        closing = prior.filter("open").join(gone.withColumn("__gone", F.lit(True)), "job_id", "left").join(
            fresh.withColumn("__hit", F.lit(True)), list(KEY), "left").filter("__gone or __hit")
        put = reliable(put.select(*columns))
        closed = closing.join(put.select("job_id"), "job_id", "left_anti").withColumn("open", F.lit(False)).select(*columns)
        now = reliable(put.unionByName(closed))
        replaced = prior.join(now.select("job_id"), "job_id", "left_semi")
        delta = _summed(_contribution(now, 1).unionByName(_contribution(replaced, -1)))
        delta = reliable(delta.filter("df <> 0 or docs <> 0 or len <> 0 or open <> 0").coalesce(1))
        seq = self.rows_log.version().number + 1
        self.rows_log.append(now.withColumn("seq", F.lit(seq).cast("long")), batch_id, query, merge=False)
        self.scored_log.append(fresh, batch_id, query, merge=False)
        self.stats_log.append(delta, batch_id, query, merge=False)
        for log in logs:
            log.merge()

    def open_rows(self) -> DataFrame:
        """The narrow rows that can still be picked: unscored, and passed by the constraints."""
        return _newest(self.rows_log.rows(ROWS)).filter("open and eligible").drop("seq", "open", "eligible")

    def statistics(self) -> DataFrame:
        """``term, df, docs, len, open``: the sums of all contributions."""
        return _summed(self.stats_log.rows(STATS))

    def open_count(self) -> int:
        """Unscored postings, whether or not the constraints pass them."""
        row = self.statistics().filter(F.col("term") == TOTALS).select("open").first()
        return row["open"] if row else 0

    def corpus(self) -> DataFrame:
        """The statistics as one row: ``n_docs, avg_len, df`` by query term."""
        sums = self.statistics()
        total = F.col("term") == TOTALS
        counts = F.map_from_entries(F.collect_list(F.when(~total, F.struct("term", "df"))))
        # A term that no open posting holds any more counts zero.
        every = F.map_from_arrays(F.array(*[F.lit(t) for t in self.terms]), F.array(*[F.lit(0).cast("long")] * len(self.terms)))
        return sums.agg(
            F.coalesce(F.max(F.when(total, F.col("docs"))), F.lit(0)).alias("n_docs"),
            F.max(F.when(total, F.col("len") / F.nullif(F.col("docs"), F.lit(0)))).alias("avg_len"), counts.alias("found")).select(
            "n_docs", "avg_len", F.transform_values(every, lambda t, n: F.coalesce(F.try_element_at("found", t), n)).alias("df"))
