"""Ranking and labelling metrics as aggregations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia import rules
from vacancia.functions.scoring import dcg_gain, is_good, label_verdict, relevance_grade
from vacancia.operators.ordered import order_statistics, running_totals

CUTS = (5, 10, 30)
RELEVANT = 2


def _ideal_dcg(k: int) -> Column:
    """Best possible gain at ``k``: grades take four values, so their counts suffice."""
    n3, n2, n1 = F.col("n3"), F.col("n2"), F.col("n1")
    total = F.lit(0.0)
    for i in range(1, k + 1):
        grade = (F.when(n3 >= i, 3).when(n3 + n2 >= i, 2).when(n3 + n2 + n1 >= i, 1).otherwise(0))
        total = total + dcg_gain(grade, F.lit(i))
    return total


def ir_metrics(ranked: DataFrame) -> DataFrame:
    """Per run: NDCG, MRR, precision, recall and MAP of a ranked list.

    ``ranked`` has (run_id, rank, score, hard_rejected), ranks from 1 without
    gaps. The running count that MAP needs is computed over range-partitioned
    chunks, so one run may be arbitrarily long.
    """
    graded = ranked.select("run_id", "rank",
                           relevance_grade(F.col("score"), F.col("hard_rejected")).alias("grade"))
    hit = (F.col("grade") >= RELEVANT).cast("int")
    rows = running_totals(graded, ["run_id"], ["rank"], {"found": hit})
    rel = F.col("grade") >= RELEVANT
    per_run = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_evaluated"), F.count_if(rel).alias("total_relevant"),
        *[F.count_if(F.col("grade") == g).alias(f"n{g}") for g in (1, 2, 3)],
        *[F.sum(F.when(F.col("rank") <= k, dcg_gain(F.col("grade"), F.col("rank")))
                .otherwise(0.0)).alias(f"dcg{k}") for k in CUTS],
        *[F.count_if(rel & (F.col("rank") <= k)).alias(f"hit{k}") for k in CUTS],
        F.min(F.when(rel, F.col("rank"))).alias("first_rel"),
        F.sum(F.when(rel, F.col("found") / F.col("rank"))).alias("ap_sum"))
    def ndcg(k: int) -> Column:
        ideal = _ideal_dcg(k)
        return F.when(ideal > 0, F.col(f"dcg{k}") / ideal).otherwise(1.0).alias(f"ndcg_at_{k}")
    return per_run.select(
        "run_id", *[ndcg(k) for k in CUTS],
        F.coalesce(1.0 / F.col("first_rel"), F.lit(0.0)).alias("mrr"),
        *[(F.col(f"hit{k}") / F.least(F.lit(k), F.col("total_evaluated")))
          .alias(f"precision_at_{k}") for k in CUTS],
        F.when(F.col("total_relevant") > 0, F.col("hit30") / F.col("total_relevant"))
        .otherwise(1.0).alias("recall_at_30"),
        F.when(F.col("total_relevant") > 0, F.col("ap_sum") / F.col("total_relevant"))
        .otherwise(0.0).alias("map"),
        "total_relevant", "total_evaluated")


def _ratio(good: Column, n: Column) -> Column:
    return F.try_divide(good, n)


def precision(results: DataFrame, labels: DataFrame, low: float,
              high: float | None = None) -> DataFrame:
    """One row: labelled results scoring in [low, high) and the share that is good."""
    rows = results.filter(F.col("score") >= low)
    if high is not None:
        rows = rows.filter(F.col("score") < high)
    good = is_good(F.col("value"))
    return rows.join(labels.select("key", "value"), "key").agg(
        F.count_if(good).alias("good"), F.count_if(~good).alias("bad"),
    ).withColumn("n", F.col("good") + F.col("bad")) \
        .withColumn("precision", _ratio(F.col("good"), F.col("n")))


def recall(results: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: good labels that were ranked, and the share at push tier."""
    hit = F.col("score") >= rules.TIER_PUSH
    return labels.filter(is_good(F.col("value"))).select("key").join(
        results.select("key", "score"), "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"),
    ).withColumn("recall", _ratio(F.col("hits"), F.col("n")))


def precision_llm(results: DataFrame, llm_labels: DataFrame, low: float,
                  high: float | None = None) -> DataFrame:
    """As ``precision`` against model verdicts; borderline is left out."""
    rows = results.filter(F.col("score") >= low)
    if high is not None:
        rows = rows.filter(F.col("score") < high)
    return rows.join(llm_labels.select("key", "verdict"), "key").agg(
        F.count_if(F.col("verdict") == "fit").alias("good"),
        F.count_if(F.col("verdict") == "unfit").alias("bad"),
    ).withColumn("n", F.col("good") + F.col("bad")) \
        .withColumn("precision", _ratio(F.col("good"), F.col("n")))


def recall_llm(results: DataFrame, llm_labels: DataFrame) -> DataFrame:
    hit = F.col("score") >= rules.TIER_PUSH
    return llm_labels.filter("verdict = 'fit'").select("key").join(
        results.select("key", "score"), "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"),
    ).withColumn("recall", _ratio(F.col("hits"), F.col("n")))


def precision_trend(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision at push tier as labels accumulate, in label-time order."""
    push = results.filter(F.col("score") >= rules.TIER_PUSH).select("key")
    seq = labels.select("key", "labeled_at", "value").join(push, "key")
    run = running_totals(seq, [], ["labeled_at", "key"], {
        "n": F.lit(1), "good": is_good(F.col("value")).cast("int")})
    return run.select("n", "key", "labeled_at", (F.col("good") / F.col("n")).alias("precision"))


def agreement(labels: DataFrame, llm_labels: DataFrame) -> DataFrame:
    """One row: user labels with a verdict and the share the model does not contradict."""
    expected = label_verdict(F.col("value"))
    rows = labels.select("key", expected.alias("expected")).filter("expected is not null").join(
        llm_labels.select("key", "verdict"), "key")
    against = (((F.col("expected") == "fit") & (F.col("verdict") == "unfit"))
               | ((F.col("expected") == "unfit") & (F.col("verdict") == "fit")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~against).alias("agree")) \
        .withColumn("agreement", _ratio(F.col("agree"), F.col("n")))


def _reached(results: DataFrame) -> DataFrame:
    return results.filter((F.col("latency_ms") > 0) & (F.size("hard_failures") == 0))


def output_quality(results: DataFrame) -> DataFrame:
    """One row: validity, evidence rate and floor-index latencies of scored rows."""
    rows = _reached(results)
    valid = F.col("score").between(0, 100) & (F.length("reasoning") >= 10)
    shown = (F.size("evidence.from_posting") > 0) | (F.size("evidence.from_profile") > 0)
    rate = rows.agg(
        F.coalesce(F.avg(F.coalesce(valid, F.lit(False)).cast("int")), F.lit(0.0)).alias("validity"),
        F.coalesce(F.avg(F.coalesce(shown, F.lit(False)).cast("int")), F.lit(0.0)).alias("evidence"))
    lat = order_statistics(rows.select("latency_ms"), [], "latency_ms", {
        "p50": ("floor", 0.5), "p95": ("floor", 0.95)})
    return rate.withColumn("latency_p50", F.coalesce(lat.select("p50").scalar(), F.lit(0.0))) \
        .withColumn("latency_p95", F.coalesce(lat.select("p95").scalar(), F.lit(0.0)))


def score_stability(repeats: DataFrame, *keys: str) -> DataFrame:
    """One row: mean over jobs of the population deviation of repeated scores."""
    per = repeats.groupBy(*keys).agg(F.stddev_pop("score").alias("sd"))
    return per.agg(F.count(F.lit(1)).alias("jobs"), F.avg("sd").alias("score_stability"))


def score_distribution(results: DataFrame) -> DataFrame:
    """Counts by review tier and of rejected rows."""
    s = F.col("score")
    return results.agg(
        F.count(F.lit(1)).alias("jobs_evaluated"),
        F.count_if(F.size("hard_failures") > 0).alias("jobs_hard_rejected"),
        F.count_if(s >= rules.TIER_PUSH).alias("jobs_push"),
        F.count_if((s >= rules.TIER_DIGEST) & (s < rules.TIER_PUSH)).alias("jobs_digest"),
        F.count_if(s < rules.TIER_DIGEST).alias("jobs_skip"))


def verdict_distribution(llm_labels: DataFrame) -> DataFrame:
    known = F.when(F.col("verdict").isin("fit", "unfit"), F.col("verdict")).otherwise("borderline")
    return llm_labels.groupBy(known.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def quality_gates(metrics: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """``metrics(name, value)`` against ``name -> (op, bound)`` with op in eq, le, ge."""
    bound = F.create_map(*[x for n, (_, v) in gates.items() for x in (F.lit(n), F.lit(float(v)))])
    op = F.create_map(*[x for n, (o, _) in gates.items() for x in (F.lit(n), F.lit(o))])
    value = F.col("value")
    test = (F.when(F.col("op") == "eq", value == F.col("bound"))
            .when(F.col("op") == "le", value <= F.col("bound"))
            .otherwise(value >= F.col("bound")))
    return (
        metrics.filter(F.col("name").isin(*gates))
        .withColumn("op", F.element_at(op, F.col("name")))
        .withColumn("bound", F.element_at(bound, F.col("name")))
        .withColumn("ok", F.coalesce(test, F.lit(False)))
    )
