"""Substring dedup: paragraphs with MinHash banding, exact verification and components.

Repeated passages seldom keep to line ends, so a paragraph here is a
content-defined stretch of words: a text is cut where the hash of a word pair
is the smallest among its ``REACH`` neighbours on both sides. Cuts depend on
near words only, so a passage falls into the same paragraphs wherever it stands.

The five-word shingle sets of the paragraphs are MinHashed. The number of bands
is the least that reaches ``RECALL`` at the similarity threshold; equal
paragraphs always collide. Colliding paragraphs are compared by the exact
Jaccard similarity of their shingle sets and linked in spanning forests; the
components of the links are the clusters. Stretches of adjacent clustered
paragraphs of at least ``LEAST_WORDS`` words that also occur in another document
are reported, and all but the first occurrence is marked for removal. A shorter
stretch may be what whole paragraphs show of a longer match, so its paragraphs
are extended word by word against the occurrence that stays, over gaps of up to
``GAP`` words, and are reported if the match has that many words.

A bucket is streamed in sorted order with at most ``TILE`` paragraphs in memory.
Larger buckets are dealt out in tiles, and every pair of their tiles is
compared by some task, so nothing is dropped and no task gets a whole bucket.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.components import components
from vacancia.llm.texts import whole
from vacancia.session import reliable

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.95
REACH = 6
LEAST_WORDS = 20
TILE = 1024
#: Words on either side that a match may skip if ``WIDTH`` equal words follow.
GAP = 2
#: Paragraphs on both sides of one that its window holds, besides ``LEAST_WORDS`` words.
AROUND = 3
#: Windows of kept occurrences are joined by broadcast up to this number.
MOST_BROADCAST = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.array([c in b" \t\n\v\f\r" for c in range(256)])


def bands_for(similarity: float, recall: float) -> tuple[int, int]:
    """``(bands, rows)`` with the least hashes that reach the recall at the similarity."""
    found = []
    for rows in range(1, 9):
        hit = similarity ** rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - hit))
        found.append((bands * rows, rows, bands))
    _, rows, bands = min(found)
    return bands, rows


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: uniform 64-bit values from any integers."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03) & (2 ** 64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Cut:
    """The paragraphs of a text: word places, word hashes and paragraph bounds."""

    def __init__(self, text: str) -> None:
        from xxhash import xxh3_64_intdigest

        data = text.encode("utf-8")
        raw = np.frombuffer(data, np.uint8)
        solid = np.concatenate(([False], ~_BLANK[raw], [False]))
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(data) != len(text):
            place = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            self.starts, self.ends = place[starts], place[ends]
        else:
            self.starts, self.ends = starts, ends
        self.words = data.lower().split()
        self.hashes = np.fromiter(map(xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.bounds = self._bounds()

    def _bounds(self) -> np.ndarray:
        """Positions where paragraphs begin, with the number of words at the end."""
        n = len(self.hashes)
        if n == 0:
            return np.zeros(1, np.int64)
        pair = _mix(self.hashes[1:] + self.hashes[:-1] * _ODD)
        top = np.uint64(2 ** 64 - 1)
        padded = np.concatenate((np.full(REACH, top), pair, np.full(REACH, top)))
        # Minima of REACH consecutive values, from minima of as many as double at each step.
        least, width = padded, 1
        while width < REACH:
            step = min(width, REACH - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        # Strictly below all before and not above any behind: of equal neighbours the first may cut.
        cut = np.flatnonzero((pair < least[: len(pair)]) & (pair <= least[REACH + 1:][: len(pair)]))
        return np.concatenate(([0], cut + 1, [n]))

    def names(self) -> np.ndarray:
        """A 64-bit name of each paragraph's words."""
        from xxhash import xxh3_64_intdigest

        words, b = self.words, self.bounds.tolist()
        joined = [b" ".join(words[i:j]) for i, j in zip(b[:-1], b[1:], strict=True)]
        return np.fromiter(map(xxh3_64_intdigest, joined), np.uint64, len(joined))

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """All shingle hashes in order, and where each paragraph's begin (its own words only)."""
        h, b = self.hashes, self.bounds
        size = np.diff(b)
        count = np.maximum(size - WIDTH + 1, 1)
        firsts = np.repeat(b[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        stop = np.repeat(b[1:], count)
        total = np.zeros(len(firsts), np.uint64)
        for k in range(WIDTH):
            at = np.minimum(firsts + k, len(h) - 1)
            total = total * _ODD + np.where(firsts + k < stop, h[at], np.uint64(0))
        return _mix(total), np.concatenate(([0], np.cumsum(count)))


def _packed_sets(low: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The distinct values of consecutive stretches of ``low``, each sorted and packed."""
    held = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(32), sizes) | low
    held.sort()
    held = held[np.concatenate(([True], held[1:] != held[:-1]))]
    ends = np.cumsum(np.bincount((held >> np.uint64(32)).astype(np.int64), minlength=len(sizes))) * 4
    data = (held & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _band_rows(texts: list[str], bands: int, rows: int) -> tuple[list, list, list, list]:
    """``key, name, many, set`` of the distinct paragraphs of some texts, a row a band."""
    cuts = [cut for text in texts if len((cut := Cut(text)).words)]
    if not cuts:
        return [], [], [], []
    every = np.concatenate([cut.names() for cut in cuts])
    # Equal paragraphs of one batch are sent once, so a popular one does not travel with every copy.
    name, first, count = np.unique(every, return_index=True, return_counts=True)
    shingles = [cut.shingles() for cut in cuts]
    hashes = np.concatenate([h for h, _ in shingles])
    sizes = np.concatenate([np.diff(begins) for _, begins in shingles])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # Only the shingles of first occurrences are looked at, in the order of the names.
    sizes, begins = sizes[first], begins[first]
    at = np.repeat(begins - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    hashes, begins = hashes[at], np.concatenate(([0], np.cumsum(sizes)[:-1]))
    keys = np.zeros((bands, len(name)), np.uint64)
    for band in range(bands):
        for r in range(rows):
            keys[band] = _mix(keys[band] + np.minimum.reduceat(_mix(hashes, 1 + band * rows + r), begins), 101 + band)
    packed, many = _packed_sets(hashes & np.uint64(0xFFFFFFFF), sizes), count > 1
    return (keys.reshape(-1).view(np.int64), np.tile(name.view(np.int64), bands), np.tile(many, bands), packed * bands)


def bucket_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``key, name, many, members``: band keys of all paragraphs of ``docs``."""
    bands, rows = bands_for(SIMILARITY, RECALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                key, name, many, members = _band_rows(batch.column("t").slice(at, 1000).to_pylist(), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(name, pa.int64()), pa.array(many, pa.bool_()),
                     pa.array(members, pa.binary())], ["key", "name", "many", "members"])
    return docs.select(whole(docs[text]).alias("t")).mapInArrow(
        run, "key bigint, name bigint, many boolean, members binary")


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def _bitmaps(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) // 4 for s in sets])
    flat = np.frombuffer(b"".join(sets), "<u4")
    row = np.repeat(np.arange(len(sets)), sizes)
    maps = np.zeros(len(sets), np.uint64)
    np.bitwise_xor.at(maps, row, np.uint64(1) << (flat % 64).astype(np.uint64))
    return maps, sizes


def compare(names: list[int], sets: list[bytes], split: int = 0) -> Iterator[tuple[int, int]]:
    """Forest of the similar pairs of a bucket, or across ``split`` if it is given.

    The parity bitmaps of two sets differ in at most as many bits as the sets
    differ in members, and similar sets differ in at most a ninth of their joint
    size at 0.8; the pairs left by this exact test are verified one by one, and
    pairs that are connected already are not.
    """
    maps, sizes = _bitmaps(sets)
    limit = (1 - SIMILARITY) / (1 + SIMILARITY)
    label = np.arange(len(sets))
    for i in range(split or len(sets)):
        rest = np.arange(split or i + 1, len(sets))
        near = rest[np.bitwise_count(maps[i] ^ maps[rest]) <= limit * (sizes[i] + sizes[rest]) + 1e-9]
        for j in near:
            if label[i] != label[j] and _similar(sets[i], sets[j]):
                yield names[i], names[j]
                label[label == label[j]] = label[i]


def _bucket_pass(rows: DataFrame) -> DataFrame:
    """``kind, key, a, b, members`` of each sorted bucket.

    Kind 0 is a link between names (a name with itself: it occurs again), kind 1
    a member of a bucket that is too large for one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, large = None, {}, False
        out: list[tuple] = []

        def close() -> None:
            if len(members) > 1 and not large:
                out.extend((0, 0, a, b, None) for a, b in compare(list(members), list(members.values())))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                              ["kind", "key", "a", "b", "members"])
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, names = (batch.column(c).to_numpy() for c in ("key", "name"))
            many = batch.column("many").to_numpy(zero_copy_only=False)
            # Most buckets are one row; only rows with a neighbour of the same key need a closer look.
            again = np.concatenate(([False], keys[1:] == keys[:-1]))
            alone = ~again & ~np.append(again[1:], False)
            alone[[0, -1]] = False
            out.extend((0, 0, n, n, None) for n in names[many].tolist())
            for at in np.flatnonzero(~alone).tolist():
                if keys[at] != key:
                    close()
                    key, members, large = keys[at], {}, False
                name = int(names[at])
                if name in members:
                    out.append((0, 0, name, name, None))
                    continue
                held = batch.column("members")[at].as_py()
                if large:
                    out.append((1, int(key), name, 0, held))
                    continue
                members[name] = held
                if len(members) > TILE:
                    large = True
                    out.extend((1, int(key), n, 0, m) for n, m in members.items())
                if len(out) > 10_000:
                    yield batch_of(out)
                    out.clear()
        close()
        yield batch_of(out)
    return rows.mapInArrow(run, "kind int, key bigint, a bigint, b bigint, members binary")


def _tile_pass(rest: DataFrame) -> DataFrame:
    """Links ``a, b`` of the buckets that are compared in tiles."""
    sizes = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    tiles = reliable(
        rest.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
        .groupBy("key", "parts", "part").agg(F.collect_list(F.struct("a", "members")).alias("m")))
    left = tiles.select("key", F.col("part").alias("p1"), F.explode(F.expr("sequence(part, parts - 1)")).alias("part"),
                        F.col("m").alias("m1"))
    met = left.join(tiles.select("key", "part", F.col("m").alias("m2")), ["key", "part"]).select(
        (F.col("p1") == F.col("part")).alias("same"), "m1", "m2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same, m1, m2 = (batch.column(c)[i].as_py() for c in ("same", "m1", "m2"))
                every = m1 if same else m1 + m2
                found = list(compare([x["a"] for x in every], [x["members"] for x in every], 0 if same else len(m1)))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])
    return met.mapInArrow(run, "a bigint, b bigint")


def clusters(docs: DataFrame, text: str = "text") -> DataFrame:
    """``name, cluster`` of every paragraph name that occurs again or has a similar one."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = bucket_rows(docs, text).repartition(parts, "key").sortWithinPartitions("key")
    found = reliable(_bucket_pass(dealt))
    links = reliable(found.filter("kind = 0").select("a", "b")
                     .union(_tile_pass(found.filter("kind = 1"))).distinct())
    joined = components(links.filter("a != b")).select(F.col("node").alias("name"), F.col("component").alias("cluster"))
    alone = links.filter("a = b").select(F.col("a").alias("name")).join(joined, "name", "left_anti")
    return joined.union(alone.select("name", F.col("name").alias("cluster")))


def occurrences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, tag, seq, name, start, end, n_words`` of every paragraph, in code points, end exclusive."""
    t = whole(docs[text])
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(t).alias("tag"), t.alias("t"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                cuts = [c if len((c := Cut(t)).words) else None for t in part.column("t").to_pylist()]
                counts = [len(c.bounds) - 1 if c else 0 for c in cuts]
                cuts = [c for c in cuts if c]
                which = pa.array(np.repeat(np.arange(part.num_rows), counts))
                columns = [part.column("doc_id").take(which), part.column("tag").take(which)]
                made = [[np.arange(len(c.bounds) - 1) for c in cuts], [c.names().view(np.int64) for c in cuts],
                        [c.starts[c.bounds[:-1]] for c in cuts], [c.ends[c.bounds[1:] - 1] for c in cuts],
                        [np.diff(c.bounds) for c in cuts]]
                columns += [pa.array(np.concatenate([np.empty(0, np.int64), *m]).astype(np.int64)) for m in made]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "seq", "name", "start", "end", "n_words"])
    return rows.mapInArrow(run, f"doc_id {kind}, tag bigint, seq bigint, name bigint, start bigint, end bigint, n_words bigint")


def matched(x: list[int], y: list[int]) -> tuple[int, int]:
    """``(reach, equal)``: how far a match runs in ``x`` from its begin, and how many words of it are equal."""
    steps = sorted(((i, j) for i in range(GAP + 1) for j in range(GAP + 1) if i or j), key=lambda s: (max(s), sum(s)))
    i = j = equal = 0
    while True:
        while i < len(x) and j < len(y) and x[i] == y[j]:
            i, j, equal = i + 1, j + 1, equal + 1
        for a, b in steps:
            ahead = x[i + a: i + a + WIDTH]
            if len(ahead) == WIDTH and ahead == y[j + b: j + b + WIDTH]:
                i, j = i + a, j + b
                break
        else:
            return i, equal


def _windows(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The words around the paragraphs ``doc_id, tag, start, cluster, kept`` of ``wanted``, outwards from their bounds."""
    t = whole(docs[text])
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(t).alias("tag"), t.alias("t"))
    need = (wanted.groupBy(F.col("doc_id").alias("id"), F.col("tag").alias("of"))
            .agg(F.collect_set(F.struct("start", "cluster", "kept")).alias("need")))
    met = rows.join(need, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("of"))).select(
        "doc_id", "tag", "t", "need")
    kind = dict(rows.dtypes)["doc_id"]
    lists = ["left", "left_starts", "right", "right_ends"]

    def around(cut: Cut, start: int) -> list[list[int]]:
        b = cut.bounds
        k = int(np.searchsorted(cut.starts[b[:-1]], start))
        at, stop = int(b[k]), int(b[k + 1])
        low = min(int(b[max(k - AROUND, 0)]), max(at - LEAST_WORDS, 0))
        high = max(int(b[min(k + 1 + AROUND, len(b) - 1)]), min(stop + LEAST_WORDS, len(cut.words)))
        words = cut.hashes.view(np.int64)
        return [words[low:at][::-1].tolist(), cut.starts[low:at][::-1].tolist(),
                words[stop:high].tolist(), cut.ends[stop:high].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                which, made = [], []
                for i in range(part.num_rows):
                    cut = Cut(part.column("t")[i].as_py())
                    for n in part.column("need")[i].as_py():
                        which.append(i)
                        made.append([n["start"], n["cluster"], n["kept"], *around(cut, n["start"])])
                kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 4]
                columns = [part.column(c).take(pa.array(which, pa.int64())) for c in ("doc_id", "tag")]
                columns += [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "start", "cluster", "kept", *lists])
    return met.mapInArrow(run, f"doc_id {kind}, tag bigint, start bigint, cluster bigint, kept boolean, "
                               + ", ".join(f"{n} array<bigint>" for n in lists))


def _extended(docs: DataFrame, short: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``doc_id, tag, start, cluster, more, left_starts, right_ends`` of the removed paragraphs of ``short``.

    ``more`` counts the equal words beside the paragraph, and the lists have the
    places of all words that the match reaches.
    """
    removed = short.filter("removed")
    wanted = removed.select("doc_id", "tag", "start", "cluster", F.lit(False).alias("kept")).unionByName(
        removed.select("cluster", "first.*").select("doc_id", "tag", "start", "cluster", F.lit(True).alias("kept")))
    windows = reliable(_windows(docs, wanted, text, doc_id))
    # The checkpoint parts the join from the aggregate on its key, so a cluster of any size may be split.
    kept = reliable(windows.filter("kept").select("cluster", F.col("left").alias("their_left"), F.col("right").alias("their_right"))
                    .dropDuplicates(["cluster"]))
    if kept.count() <= MOST_BROADCAST:
        kept = F.broadcast(kept)
    pairs = windows.filter("not kept").join(kept, "cluster")
    names = ["doc_id", "tag", "start", "cluster", "more", "left_starts", "right_ends"]
    kind = dict(windows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more, starts, ends = [], [], []
            for i in range(batch.num_rows):
                left, left_starts, right, right_ends, their_left, their_right = (
                    batch.column(c)[i].as_py() for c in
                    ("left", "left_starts", "right", "right_ends", "their_left", "their_right"))
                (a, m), (b, n) = matched(left, their_left), matched(right, their_right)
                more.append(m + n)
                starts.append(left_starts[:a])
                ends.append(right_ends[:b])
            places = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names[:4]], pa.array(more, pa.int64()), pa.array(starts, places),
                 pa.array(ends, places)], names)
    return pairs.mapInArrow(run, f"doc_id {kind}, tag bigint, start bigint, cluster bigint, more bigint, "
                                 "left_starts array<bigint>, right_ends array<bigint>")


def repeated_paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                        least_words: int = LEAST_WORDS) -> DataFrame:
    """The repeated paragraphs: ``doc_id, start, end, n_words, cluster, kept_doc_id, removed``.

    One row per paragraph that has an equal or similar one in another document
    and stands in a stretch of such paragraphs of at least ``least_words`` words,
    or in a match of so many words with the occurrence that stays; rows of the
    latter kind also hold the words of the match up to the next row.
    ``kept_doc_id`` has the occurrence that stays (the smallest id, nulls last,
    then text hash and place). Texts without words have no paragraphs; null ids
    count as documents of their own text; repeated rows repeat all they hold; an
    empty table gives an empty result.
    """
    seen = reliable(occurrences(docs, text, doc_id).join(clusters(docs, text), "name"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("tag"), F.col("start"))
    document = F.struct(F.col("doc_id"), F.col("tag"))
    spread = seen.groupBy("cluster").agg(
        F.min(place).alias("first"), F.min(document).alias("lo"), F.max(document).alias("hi"))
    # The checkpoint parts the join from the aggregate on its key, so a cluster of any size may be split.
    across = reliable(spread.filter(~F.col("lo").eqNullSafe(F.col("hi"))).select("cluster", "first"))
    near = seen.join(across, "cluster")
    by_document = Window.partitionBy("doc_id", "tag").orderBy("seq")
    stretch = Window.partitionBy("doc_id", "tag", "stretch")
    rows = reliable(
        near.withColumn("stretch", F.col("seq") - F.dense_rank().over(by_document))
        .withColumn("words", F.sum("n_words").over(stretch))
        .select("doc_id", "tag", "start", "end", "n_words", "cluster", "first", "words",
                (~place.eqNullSafe(F.col("first"))).alias("removed")))
    short = rows.filter(F.col("words") < least_words)
    none = F.array().cast("array<bigint>")
    # Equal rows give equal extensions: one is enough for all of them.
    found = _extended(docs, short, text, doc_id).dropDuplicates(["doc_id", "tag", "start"]).select(
        F.col("doc_id").alias("id"), F.col("tag").alias("of"), F.col("start").alias("at"), "more", "left_starts", "right_ends")
    hits = reliable(
        short.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("of")) & (F.col("start") == F.col("at")))
        .filter(F.col("n_words") + F.col("more") >= least_words).select(*rows.columns, "left_starts", "right_ends"))
    stays = short.filter("not removed").join(hits.select("cluster").distinct(), "cluster", "left_semi")
    every = (rows.filter(F.col("words") >= least_words).unionByName(stays)
             .withColumns({"left_starts": none, "right_ends": none}).unionByName(hits))
    # Rows of one match reach over each other: the earlier takes the words between them.
    here = Window.partitionBy("doc_id", "tag").orderBy("start")
    after = F.min("start").over(here.rangeBetween(1, Window.unboundedFollowing))
    before = F.max("new_end").over(here.rangeBetween(Window.unboundedPreceding, -1))
    return (
        every.withColumn("after", after)
        .withColumn("right_ends", F.expr("filter(right_ends, x -> after is null or x <= after)"))
        .withColumn("new_end", F.coalesce(F.array_max("right_ends"), F.col("end")))
        .withColumn("before", before)
        .withColumn("left_starts", F.expr("filter(left_starts, x -> before is null or x >= before)"))
        .select("doc_id", F.coalesce(F.array_min("left_starts"), F.col("start")).alias("start"), F.col("new_end").alias("end"),
                (F.col("n_words") + F.size("left_starts") + F.size("right_ends")).alias("n_words"), "cluster",
                F.col("first.doc_id").alias("kept_doc_id"), "removed")
    )
