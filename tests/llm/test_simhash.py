import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tests.llm.conftest import prose
from vacancia.llm.components import components
from vacancia.llm.simhash import drop_near_duplicates, fingerprint, links, near_duplicates, tile_links


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.translate({c: 32 for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def key(rows):
    return sorted(rows, key=str)


def test_fingerprints(awkward):
    for r in awkward.select("text").collect():
        assert fingerprint(r["text"]) == slow_fingerprint(r["text"])


def test_awkward_rows(awkward):
    rows = awkward.select("doc_id", "text").collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    want = [(r["doc_id"], f"{p:016x}", c) for r, p, c in zip(
        rows, prints, slow_components([r["doc_id"] for r in rows], prints), strict=True)]
    assert key(tuple(r) for r in near_duplicates(awkward).collect()) == key(want)


def test_query_against_brute_force(spark, sf_dir):
    import __spark_entry__ as entry
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    want = [(r["doc_id"], f"{p:016x}", c) for r, p, c in zip(
        rows, prints, slow_components([r["doc_id"] for r in rows], prints), strict=True)]
    assert key(tuple(r) for r in entry.queries()["op8_simhash_components"](spark, sf_dir).collect()) == key(want)


@pytest.mark.parametrize("tile", [4, 64])
def test_no_link_is_lost_between_tiles(spark, tile):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    found = set(map(int, seeds))
    for s in seeds:                                   # chains of fingerprints that drift apart
        x = int(s)
        for _ in range(6):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            found.add(x)
    values = sorted(found | {0, 2 ** 64 - 1})
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "f long")
    got = {r["node"]: r["component"] for r in components(links(df, tile=tile)).collect()}
    group = slow_components(list(range(len(values))), values)
    label = [got.get(int(np.uint64(v).view(np.int64)), i) for i, v in enumerate(values)]
    assert len(set(zip(group, label))) == len(set(group)) == len(set(label))


def test_a_tile_gives_a_forest():
    near = np.array([1 << b for b in range(40)], np.uint64)
    assert len(list(tile_links(near, None, 4))) == 39
    assert len(list(tile_links(near[:20], near[20:], 4))) == 39


def test_one_of_each_group_stays(spark, awkward, nothing):
    text = prose(7, 400)
    df = spark.createDataFrame([(3, text), (2, text + " end"), (2, text + " end"), (9, prose(8, 400)), (None, text)],
                               "doc_id long, text string")
    assert sorted(r["doc_id"] for r in drop_near_duplicates(df).collect()) == [2, 9]
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    groups = near_duplicates(awkward).select("component_id").distinct().count()
    assert kept.count() >= groups
    assert drop_near_duplicates(nothing).count() == 0 and near_duplicates(nothing).count() == 0


def test_components_of_a_star_a_path_and_loops(spark):
    edges = [(0, k) for k in range(1, 500)] + [(k, k + 1) for k in range(1000, 1200)] + [(7000, 7000), (5, 0)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(500)}, **{k: 1000 for k in range(1000, 1201)}, 7000: 7000}
