"""SimHash near-duplicates by tiled exact comparison of fingerprints.

A document's 64-bit fingerprint has a bit set where over half of its shingle
hashes have it. Distinct fingerprints are laid out in tiles by the population
counts of their four 16-bit quarters. Two fingerprints that differ in at most
``radius`` bits have quarter counts that differ by at most ``radius`` in sum,
so a tile meets only the tiles within that distance and all other tile pairs
are skipped unseen. Where tiles meet, numpy compares every pair with
exclusive-or and bit counts, so no link is lost. A tile pair gives the edges
of a spanning forest of its matches and never the matches themselves.

Only 8-byte fingerprints are compared and shuffled; one row stands for all
documents that share a fingerprint, however many there are.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.components import components
from vacancia.llm.texts import own_columns, whole
from vacancia.session import reliable

WIDTH = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a tile; a population class with more is cut into several tiles.
TILE = 2048


def _hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words of an ASCII-lower-cased text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()      # bytes: ASCII letters and blanks only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer; a text without words has zero."""
    hashes = _hashes(text or "", width, seed)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at: at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprint_column(text: Column, width: int = WIDTH, seed: int = SEED) -> Column:
    """``fingerprint`` as a signed bigint column."""
    def run(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint(t, width, seed) for t in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))
    return F.pandas_udf(run, "bigint")(text)


def _forest(i: np.ndarray, j: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the edges (i, j) over ``size`` nodes.

    In each round every label takes its first edge to another label, and the
    labels are merged by pointer jumping; the number of labels halves at least.
    """
    label = np.arange(size)
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        hi, lo = np.maximum(a, b), np.minimum(a, b)
        root, first = np.unique(hi, return_index=True)
        yield from zip(i[first].tolist(), j[first].tolist(), strict=True)
        parent = np.arange(size)
        parent[root] = lo[first]
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        label = parent[label]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """Forest of the pairs within ``radius`` bits between two tiles, or inside one."""
    other = left if right is None else right
    both = left if right is None else np.concatenate((left, right))
    shift = 0 if right is None else len(left)
    rows, cols = [], []
    for at in range(0, len(left), 256):
        near = np.bitwise_count(left[at: at + 256, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + at, j + shift
        keep = i < j
        edges = np.array(list(_forest(i[keep], j[keep], len(both))), np.int64).reshape(-1, 2)
        rows.append(edges[:, 0])
        cols.append(edges[:, 1])
    for i, j in _forest(np.concatenate(rows), np.concatenate(cols), len(both)):
        yield int(both[i].view(np.int64)), int(both[j].view(np.int64))


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts within the radius, one of each opposite pair."""
    steps = product(range(-radius, radius + 1), repeat=4)
    return [d for d in steps if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def _tiles(prints: DataFrame, tile: int) -> DataFrame:
    """``code, part, members``: the fingerprints of a population class, in tiles.

    A class is cut by a hash into as many parts as its count asks for, so that
    its most popular form, however large, is dealt to many tasks.
    """
    quarters = [F.bit_count(F.shiftrightunsigned("f", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    coded = prints.select("f", sum(n * 17 ** q for q, n in enumerate(quarters)).cast("int").alias("code"))
    parts = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    dealt = coded.join(parts, "code").withColumn("part", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int"))
    return dealt.groupBy("code", "part").agg(F.collect_list("f").alias("members"))


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``a, b`` that connect every two distinct fingerprints ``f`` within ``radius``.

    A tile is sent to the meeting place of each class pair that its class is
    part of; the meeting is keyed by both tiles, so a large class is compared by
    many tasks.
    """
    tiles = reliable(_tiles(prints, tile))
    moves = F.array(*[F.struct(F.lit(sum(n * 17 ** q for q, n in enumerate(d))).alias("by"),
                               *[F.lit(n).alias(f"d{q}") for q, n in enumerate(d)]) for d in _offsets(radius)])
    homes = tiles.select("code", F.col("part").alias("p"))
    sent = (
        homes.withColumn("move", F.explode(moves))
        .filter(" and ".join(f"code div {17 ** q} % 17 + move.d{q} between 0 and 16" for q in range(4)))
        .select(F.col("code").alias("c1"), F.col("p").alias("p1"), (F.col("code") + F.col("move.by")).alias("c2"))
    )
    pairs = (
        sent.join(homes.select(F.col("code").alias("c2"), F.col("p").alias("p2")), "c2")
        .filter((F.col("c1") != F.col("c2")) | (F.col("p1") <= F.col("p2")))
    )
    met = (
        pairs.join(tiles.select(F.col("code").alias("c1"), F.col("part").alias("p1"),
                                F.col("members").alias("m1")), ["c1", "p1"])
        .join(tiles.select(F.col("code").alias("c2"), F.col("part").alias("p2"),
                           F.col("members").alias("m2")), ["c2", "p2"])
        .select((F.struct("c1", "p1") == F.struct("c2", "p2")).alias("same"), "m1", "m2")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for same, m1, m2 in zip(batch["same"], batch["m1"], batch["m2"], strict=True):
                left = np.asarray(m1, np.int64).view(np.uint64)
                right = None if same else np.asarray(m2, np.int64).view(np.uint64)
                found.extend(tile_links(left, right, radius))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return met.mapInPandas(compare, "a bigint, b bigint")


def _keyed(docs: DataFrame, text: str, doc_id: str, width: int, seed: int) -> DataFrame:
    """``id, tag, f``: a hash of the text and the fingerprint, kept in the shared folder."""
    t = whole(docs[text])
    return reliable(docs.select(docs[doc_id].alias("id"), F.xxhash64(t).alias("tag"),
                                fingerprint_column(t, width, seed).alias("f")))


def _grouped(keyed: DataFrame, radius: int) -> DataFrame:
    """``f, group``: the component of each distinct fingerprint, named by a fingerprint."""
    prints = keyed.groupBy("f").agg(F.lit(1).alias("one")).select("f")
    # The tiles are compared once, though the components look at the links more than once.
    found = components(reliable(links(prints, radius))).select(F.col("node").alias("f"), F.col("component").alias("group"))
    return prints.join(found, "f", "left").select("f", F.coalesce("group", "f").alias("group"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS,
                    width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that is reachable over links, the own
    one included. Null and wordless texts have fingerprint zero and are linked
    like any other; rows without an id get the smallest id of their component,
    null if none has one; repeated rows are repeated in the result.
    """
    keyed = _keyed(docs, text, doc_id, width, seed)
    group = reliable(_grouped(keyed, radius))
    least = keyed.groupBy("f").agg(F.min("id").alias("least")).join(group, "f")
    # The checkpoint parts the join from the aggregate on its key, so a group of any size may be split.
    smallest = reliable(least.groupBy("group").agg(F.min("least").alias("component_id")))
    return (
        keyed.join(group.join(smallest, "group").select("f", "component_id"), "f")
        .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
                "component_id")
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS,
                         width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One document of each component: that with the smallest id, then the smallest text hash.

    A document without an id stays only where its component has no other. All
    columns of ``docs`` are returned unchanged.
    """
    keyed = _keyed(docs, text, doc_id, width, seed)
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("tag"))
    first = keyed.groupBy("f").agg(F.min(order).alias("first"))
    stay = first.join(_grouped(keyed, radius), "f").groupBy("group").agg(F.min("first").alias("first"))
    key, turn = own_columns(docs, "key", "turn")

    def named(i: Column, tag: Column) -> Column:
        return F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), tag.cast("string"))

    kept = stay.select(named(F.col("first.id"), F.col("first.tag")).alias(key))
    same = Window.partitionBy(key).orderBy(key)
    return (
        docs.withColumn(key, named(docs[doc_id], F.xxhash64(whole(docs[text])))).join(kept, key)
        .withColumn(turn, F.row_number().over(same)).filter(F.col(turn) == 1).select(*[docs[c] for c in docs.columns])
    )
