"""BM25 retrieval and feature re-ranking.

The posting text is read once. In that pass the constraint filter, tokenising,
query-term hits and re-rank features become one narrow row per posting; corpus
statistics, scoring and both top-k steps run on the narrow rows.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vacancia import rules
from vacancia.candidate import Profile, expand_query
from vacancia.functions.core import let
from vacancia.functions.scoring import idf, saturated_tf
from vacancia.functions.text import description, strip_tags, tokenize, tokenize_literal
from vacancia.operators.constraints import eligible
from vacancia.operators.ordered import first_k_per_key
from vacancia.session import reliable

# Scores are rounded so that equal texts tie in any summation order.
SCORE_DIGITS = 9


def search_text(title: Column, location: Column, department: Column, body: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(" ", title, F.coalesce(location, blank), F.coalesce(department, blank),
                       strip_tags(F.coalesce(body, blank)))


def _runs(x: Column) -> Column:
    """Counts of the values of a sorted array, as ``array<struct(term, tf)>``."""
    at = F.filter(F.transform(x, lambda t, i: F.when((i == 0) | (t != F.get(x, i - 1)), i)), lambda i: i.isNotNull())
    return let(at, lambda starts: F.transform(starts, lambda s, j: F.struct(
        F.get(x, s).alias("term"), (F.coalesce(F.get(starts, j + 1), F.size(x)) - s).alias("tf"))))


def query_hits(docs: DataFrame, terms: list[str], text: Column) -> DataFrame:
    """Add ``doc_len`` and ``hits array<struct(term, tf)>`` for the query terms.

    Row-local: the found terms are sorted and counted by their runs, so counting
    needs no explode and no shuffle.
    """
    tokens = docs.withColumn("__tokens", tokenize(text))
    found = F.sort_array(F.filter("__tokens", lambda t: t.isin(*terms)))
    return tokens.withColumn("doc_len", F.size("__tokens").cast("bigint")) \
        .withColumn("hits", let(found, _runs)).drop("__tokens")


def corpus_stats(hit_rows: DataFrame, terms: list[str]) -> DataFrame:
    """One row: documents, mean length and document frequency per query term."""
    found = F.col("hits.term")
    df = F.map_from_arrays(
        F.array(*[F.lit(t) for t in terms]),
        F.array(*[F.count_if(F.array_contains(found, t)) for t in terms]))
    return hit_rows.agg(F.count(F.lit(1)).alias("n_docs"),
                        F.avg("doc_len").alias("avg_len"), df.alias("df"))


def score_hits(hit_rows: DataFrame, terms: list[str], k1: float = rules.BM25_K1,
               b: float = rules.BM25_B, stats: DataFrame | None = None) -> DataFrame:
    """Add ``bm25_score`` and keep positive scores.

    The statistics are one row (``n_docs, avg_len, df``), read through a scalar
    subquery; they are taken from the rows unless ``stats`` has them.
    """
    stats = (corpus_stats(hit_rows, terms) if stats is None else stats).select(F.struct("*").alias("s")).scalar()
    c = F.col("__corpus")
    score = F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + idf(
        c["n_docs"], F.element_at(c["df"], h["term"])) * saturated_tf(
            h["tf"], F.col("doc_len"), c["avg_len"], k1, b))
    return hit_rows.filter(F.size("hits") > 0).withColumn("__corpus", stats) \
        .withColumn("bm25_score", F.round(score, SCORE_DIGITS)) \
        .filter("bm25_score > 0").drop("__corpus")


def bm25(docs: DataFrame, terms: list[str], text: Column, id_col: str = "doc_id",
         k1: float = rules.BM25_K1, b: float = rules.BM25_B,
         materialize: bool = True) -> DataFrame:
    """``(id, bm25_score)`` of the documents that score above zero."""
    rows = query_hits(docs.select(id_col, text.alias("__text")), terms, F.col("__text")) \
        .select(id_col, "doc_len", "hits")
    if materialize:
        rows = reliable(rows)
    return score_hits(rows, terms, k1, b).select(id_col, "bm25_score")


def top_k(scored: DataFrame, k: int, id_col: str = "doc_id",
          score: str = "bm25_score") -> DataFrame:
    """Best ``k`` by score, ties by id; each task forwards at most ``k`` narrow rows."""
    return scored.orderBy(F.desc(score), F.asc(id_col)).limit(k)


# --- long-form term statistics and many profiles at once ---

def term_frequencies(docs: DataFrame, text: Column, id_col: str = "doc_id",
                     terms: DataFrame | None = None) -> DataFrame:
    """``(id, doc_len, term, tf)``; restricted to ``terms(term)`` before the shuffle."""
    tokens = docs.select(id_col, tokenize(text).alias("__t")).select(
        id_col, F.size("__t").cast("bigint").alias("doc_len"), F.explode("__t").alias("term"))
    if terms is not None:
        tokens = tokens.join(terms.select("term").distinct(), "term", "left_semi")
    return tokens.groupBy(id_col, "term").agg(F.first("doc_len").alias("doc_len"),
                                              F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def length_stats(docs: DataFrame, text: Column) -> DataFrame:
    """One row: documents and mean token count."""
    return docs.select(F.size(tokenize(text)).alias("n")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_len"))


#: Query terms up to this number are broadcast to the tokens (some 30 MB); more meet them in a shuffled join.
MOST_TERMS = 1_000_000
#: (profile, term) pairs that one pass over the hits scores; more are scored in as many passes.
MOST_PAIRS = 500_000
#: Profiles scored together, and cells of the document-by-term table that a task holds.
SCORE_PROFILES, SCORE_CELLS = 256, 4_000_000
#: A block is skipped only if it misses by more than rounding can explain.
BOUND_SLACK = 1e-7


def term_hits(docs: DataFrame, text: Column, terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, doc_len, term, tf`` for the ``terms(term)`` found in each document, and a row without term for each document.

    A document's rows follow each other, the one without term first; ids are unique. Texts are read once. A
    document's tokens are counted by runs of the sorted tokens; the counts meet the terms in a hash join, so the
    plan holds no term and nothing but the hits leaves the task.
    """
    wanted = terms.select("term").distinct().withColumn("__wanted", F.lit(True))
    few = wanted.count() <= MOST_TERMS
    counted = docs.select(id_col, let(F.sort_array(tokenize(text)), lambda x: F.struct(
        F.size(x).cast("bigint").alias("doc_len"), _runs(x).alias("hits"))).alias("__t"))
    # The total comes first, as a run without a term.
    none = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"))
    each = counted.select(id_col, F.col("__t.doc_len").alias("doc_len"), F.explode(F.concat(F.array(none), F.col("__t.hits"))).alias("h"))
    named = each.select(id_col, "doc_len", F.col("h.term").alias("term"), F.col("h.tf").cast("bigint").alias("tf"))
    found = named.join(F.broadcast(wanted) if few else wanted, "term", "left").filter(
        F.col("term").isNull() | F.col("__wanted")).select(id_col, "doc_len", "term", "tf")
    # A hash join leaves a document's rows together; after a shuffled one they are brought together again.
    return found if few else found.repartition(id_col).sortWithinPartitions(id_col, F.col("term").asc_nulls_first())


class _Best:
    """The best ``k`` documents of each profile that a task has seen."""

    def __init__(self, profiles: int, k: int) -> None:
        self.k = k
        self.kept = pd.DataFrame({"p": np.empty(0, np.int64), "score": np.empty(0), "id": []})
        self.to_beat = np.full(profiles, -np.inf)      # the k-th best score, once there are k

    def add(self, profile: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        new = pd.DataFrame({"p": profile, "score": score, "id": ids})
        every = (pd.concat([self.kept, new]) if len(self.kept) else new).sort_values(
            ["p", "score", "id"], ascending=[True, False, True])
        self.kept = every.groupby("p").head(self.k)
        last = self.kept.groupby("p")["score"].agg(["size", "min"])
        full = last[last["size"] == self.k]
        self.to_beat[full.index.to_numpy(np.int64)] = full["min"].to_numpy()


def _local_best(hits: DataFrame, pairs: list, n_docs: int, avg_len: float, k: int, id_col: str, profile: T.DataType) -> DataFrame:
    """The best ``k`` documents per profile of every task: its documents against all profiles of ``pairs``.

    Documents are taken in blocks; a block's largest weight per term bounds every score in it, and
    profiles whose bound misses their ``k``-th best so far skip the block. The others are
    one matrix product of the block's weights. What leaves a task is ``k`` rows a profile.
    """
    profiles = sorted({r["profile_id"] for r in pairs})
    place = {p: i for i, p in enumerate(profiles)}
    counts = {r["term"]: r["df"] for r in pairs}
    terms = sorted(counts)
    number = {t: i for i, t in enumerate(terms)}
    df = np.array([counts[t] for t in terms], np.float64)
    rarity = np.log((n_docs - df + 0.5) / (df + 0.5) + 1)
    of_term = np.array([number[r["term"]] for r in pairs], np.int64)
    of_profile = np.array([place[r["profile_id"]] for r in pairs], np.int64)
    k1, b, digits = rules.BM25_K1, rules.BM25_B, SCORE_DIGITS
    out = T.StructType([T.StructField("profile_id", profile), T.StructField(id_col, hits.schema[id_col].dataType),
                        T.StructField("bm25_score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def score(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known, best = pa.array(terms, pa.string()), _Best(len(profiles), k)
        groups = []
        for at in range(0, len(profiles), SCORE_PROFILES):
            mine = (of_profile >= at) & (of_profile < at + SCORE_PROFILES)
            own, column = np.unique(of_term[mine], return_inverse=True)
            wants = np.zeros((len(own), min(SCORE_PROFILES, len(profiles) - at)))
            wants[column, of_profile[mine] - at] = 1.0
            lookup = np.full(len(terms), -1)
            lookup[own] = np.arange(len(own))
            groups.append((at, lookup, wants))
        widest = max((len(w) for _, _, w in groups), default=1)
        step = max(1, SCORE_CELLS // max(1, widest))

        def block(ids, row, term, weight):
            for at, lookup, wants in groups:
                column = lookup[term]
                there = column >= 0
                table = np.zeros((len(ids), len(wants)))
                table[row[there], column[there]] = weight[there]
                bound = table.max(axis=0) @ wants
                beat = best.to_beat[at:at + wants.shape[1]]
                alive = np.flatnonzero((bound > 0) & (bound >= beat - BOUND_SLACK))
                if not len(alive):
                    continue
                scores = (table @ wants[:, alive]).round(digits)
                least = beat[alive]
                if len(ids) > k:
                    least = np.maximum(least, np.partition(scores, len(ids) - k, axis=0)[len(ids) - k])
                i, p = np.nonzero((scores > 0) & (scores >= least))
                best.add(alive[p] + at, scores[i, p], ids[i])

        def blocks(table):
            """Whole documents of some rows, in blocks."""
            ids = table.column(id_col).to_numpy(zero_copy_only=False)
            row = np.cumsum(table.column("first").to_numpy(zero_copy_only=False)) - 1
            term = pc.fill_null(pc.index_in(table.column("term"), known), -1).to_numpy(zero_copy_only=False)
            tf = table.column("tf").to_numpy(zero_copy_only=False).astype(np.float64)
            norm = k1 * (1 - b + b * table.column("doc_len").to_numpy(zero_copy_only=False) / (avg_len or 1))
            starts = np.flatnonzero(table.column("first").to_numpy(zero_copy_only=False))
            named = term >= 0
            weight = np.zeros(len(term))
            weight[named] = rarity[term[named]] * (tf[named] * (k1 + 1)) / (tf[named] + norm[named])
            for at in range(0, len(starts), step):
                low = starts[at]
                high = starts[at + step] if at + step < len(starts) else len(term)
                use = np.flatnonzero(named[low:high]) + low
                block(ids[starts[at:at + step]], row[use] - at, term[use], weight[use])
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table.append_column("first", pc.is_null(table.column("term")))
            table = (pa.concat_tables([left, table]) if left is not None else table).combine_chunks()
            # The last document may go on in the next batch.
            last = int(np.flatnonzero(table.column("first").to_numpy(zero_copy_only=False))[-1])
            if last:
                blocks(table.slice(0, last).combine_chunks())
            left = table.slice(last)
        if left is not None:
            blocks(left.combine_chunks())
        yield pd.DataFrame({"profile_id": [profiles[int(p)] for p in best.kept["p"]], id_col: best.kept["id"].tolist(),
                            "bm25_score": best.kept["score"].tolist()})

    def run(batches):
        import pyarrow as pa
        for frame in score(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)
    return hits.select(id_col, "doc_len", "term", F.coalesce("tf", F.lit(0)).alias("tf")).mapInArrow(run, out)


def bm25_profiles(docs: DataFrame, queries: DataFrame, text: Column, k: int,
                  id_col: str = "doc_id") -> DataFrame:
    """Top ``k`` documents for every profile of ``queries(profile_id, term)``.

    One pass over the texts leaves the hits of any profile's terms, from which lengths,
    document frequencies and scores are taken. Every task scores its documents in blocks against
    the profiles, with upper bounds, and hands on its best ``k`` per profile. The
    profiles of a pass are a bounded number of pairs; more pairs take more passes over the hits.
    """
    queries = reliable(queries.select("profile_id", "term").distinct())
    hits = reliable(term_hits(docs.select(id_col, text.alias("__text")), F.col("__text"), queries, id_col))
    sizes = hits.filter("term is null").agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg")).first()
    pairs = queries.join(document_frequencies(hits.filter("term is not null")), "term")
    passes = max(1, -(-queries.count() // MOST_PAIRS))
    kind, parts = queries.schema["profile_id"].dataType, []
    for at in range(passes):
        share = pairs.filter(F.pmod(F.xxhash64("profile_id"), F.lit(passes)) == at).collect()
        parts.append(_local_best(hits, share, sizes["n"], sizes["avg"] or 0.0, k, id_col, kind))
    scored = reduce(DataFrame.unionByName, parts)
    return first_k_per_key(scored, ["profile_id"], [F.desc("bm25_score"), F.asc(id_col)], k)


def with_description(jobs: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Add ``description``, taken from the raw posting, which is parsed once."""
    return jobs.withColumn("description", description(F.col(raw)))


# --- features ---

def skill_overlap(haystack: Column, profile: Profile) -> Column:
    """Share of skills any token of which occurs as a substring."""
    skills = [tokenize_literal(s) for s in profile.skills]
    if not skills:
        return F.lit(0.0)
    hit = F.lit(0)
    for tokens in skills:
        test = F.lit(False)
        for t in tokens:
            test = test | haystack.contains(t)
        hit = hit + test.cast("int")
    return hit / F.lit(float(len(skills)))


def level_match(title_lower: Column, body_lower: Column) -> Column:
    """Title level, overridden by the first years requirement of the description."""
    base = (F.when(title_lower.rlike(rules.ascii_words(rules.JUNIOR_TITLE)), 1.0)
            .when(title_lower.rlike(rules.ascii_words(rules.SENIOR_TITLE)), 0.1)
            .when(title_lower.rlike(rules.ascii_words(rules.ENGINEER_TITLE)), 0.8).otherwise(0.7))
    digits = F.regexp_extract(body_lower, rules.YEARS_REQUIRED, 1)
    years = F.coalesce(digits.try_cast("bigint"), F.lit(99))
    return (F.when(digits == "", base)
            .when(years <= 3, F.greatest(base, F.lit(0.9)))
            .when(years <= 4, F.greatest(base, F.lit(0.6)))
            .otherwise(F.least(base, F.lit(0.1))))


def location_match(location: Column) -> Column:
    place = F.lower(F.coalesce(location, F.lit("")))
    return (F.when(place.contains("remote") | (place == ""), 1.0)
            .when(place.contains("new york") | place.contains("nyc"), 1.0)
            .when(place.contains("united states") | place.contains("us"), 0.8).otherwise(0.5))


def title_relevance(title_lower: Column) -> Column:
    return (F.when(title_lower.rlike(rules.ascii_words(rules.SOFTWARE_TITLE)), 1.0)
            .when(title_lower.contains("engineer"), 0.5).otherwise(0.0))


def has_description(body: Column) -> Column:
    return F.when(F.length(body) > 50, 1.0).otherwise(0.3)


FEATURES = ("skill_overlap", "level_match", "location_match", "title_relevance",
            "has_description")


def with_features(jobs: DataFrame, profile: Profile, body: str = "description") -> DataFrame:
    """Add the re-rank features that do not depend on the retrieval score."""
    tl, bl = F.lower("title"), F.lower(F.coalesce(F.col(body), F.lit("")))
    return jobs.select(
        "*", skill_overlap(F.concat_ws(" ", tl, bl), profile).alias("skill_overlap"),
        level_match(tl, bl).alias("level_match"),
        location_match(F.col("location")).alias("location_match"),
        title_relevance(tl).alias("title_relevance"), has_description(bl).alias("has_description"))


def with_combined(rows: DataFrame) -> DataFrame:
    """Add ``combined``: the weighted features with the score scaled by its maximum."""
    top = F.max("bm25_score").over(Window.partitionBy())      # over the top-k rows only
    norm = F.when(top > 0, F.col("bm25_score") / top).otherwise(0.0)
    named = rows.withColumn("bm25_norm", norm)
    total = F.lit(0.0)
    for name, weight in rules.FEATURE_WEIGHTS:
        total = total + F.col(name) * weight
    return named.withColumn("combined", F.round(total, SCORE_DIGITS)).drop("bm25_norm")


def best_first(id_col: str) -> tuple[Column, ...]:
    """The order of re-ranked postings."""
    return F.desc("combined"), F.desc("bm25_score"), F.asc(id_col)


def rerank(scored: DataFrame, k: int, n: int, id_col: str = "job_id") -> DataFrame:
    """The best ``n`` by combined features among the best ``k`` by score, on narrow rows."""
    best = top_k(scored, k, id_col)
    return with_combined(best).drop("hits", "doc_len").orderBy(*best_first(id_col)).limit(n)


def retrieve_and_rerank(jobs: DataFrame, profile: Profile, k: int = 200, n: int = 50,
                        id_col: str = "job_id", text: str = "raw_json",
                        body: str = "description", keep: tuple[str, ...] = ("title", "location"),
                        terms: list[str] | None = None, materialize: bool = True) -> DataFrame:
    """Eligible postings ranked for one profile: BM25 top ``k``, then features top ``n``.

    ``jobs`` has (id, title, location, department, body, text). Document
    frequencies are taken over the eligible postings only.
    """
    terms = terms or expand_query(profile)
    allowed = eligible(jobs, profile, text=text)
    words = search_text(F.col("title"), F.col("location"), F.col("department"), F.col(body))
    narrow = with_features(query_hits(allowed, terms, words), profile, body).select(
        id_col, "doc_len", "hits", *FEATURES)
    if materialize:
        narrow = reliable(narrow)
    chosen = rerank(score_hits(narrow, terms), k, n, id_col)
    order = best_first(id_col)
    # Only the winners fetch their texts; the corpus itself is never written out.
    return (chosen.join(jobs.select(id_col, *keep), id_col)
            .select(id_col, *keep, *FEATURES, "bm25_score", "combined").orderBy(*order))
