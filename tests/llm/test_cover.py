import math

import numpy as np
import pytest
from pyspark.sql import types as T

from vacancia.llm import cover
from vacancia.llm.cover import CoverTree, Meeting, Side, embedding_links, exact_cosine, units


def crowd(seed, singles, groups, dim=16, spread=0.15):
    """Single random vectors and groups around a centre, of unlike sizes, tightness and length."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(singles)]
    for k, size in enumerate(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        wide = spread * (k % 4) / 2
        out += [(centre + rng.normal(size=dim) * wide / math.sqrt(dim)) * rng.uniform(0.1, 50) for _ in range(size)]
    return np.array(out, np.float32)


def brute(rows, threshold=0.9):
    """n_links, component_id, kept of (id, vector) rows, one by one."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v) else None for _, v in rows]
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(n):
        for j in range(i):
            if unit[i] is None or unit[j] is None or len(unit[i]) != len(unit[j]):
                continue
            if unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i))
        out.append((d, links[i], c, d is not None and d == c))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows],
                                 "vec_id long, embedding array<float>").repartition(5)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cover_tree_invariants(seed):
    x = crowd(seed, 150, [1, 5, 40, 80, 120])
    x = np.concatenate([x, x[:3] * 2])
    unit = units([v.tobytes() for v in x], "<f4")
    tree = CoverTree(unit)
    unit = unit[tree.order]
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    assert tree.start[0] == 0 and tree.end[0] == len(x)
    for k in range(len(tree.start)):
        inside = unit[tree.start[k]:tree.end[k]]
        apart = np.sqrt(np.maximum(2 - 2 * inside @ unit[tree.centre[k]], 0))
        assert tree.start[k] <= tree.centre[k] < tree.end[k]                       # nesting: the centre is its own descendant
        assert abs(apart.max() - tree.radius[k]) < 1e-6 and tree.radius[k] <= tree.level[k] + 1e-6
        kids = np.arange(tree.child[k], tree.child[k] + tree.children[k])
        if not len(kids):
            assert tree.end[k] - tree.start[k] == 1 or tree.radius[k] <= cover.SLACK
            continue
        assert tree.centre[k] in tree.centre[kids]                                 # levels are nested
        assert tree.start[kids].tolist() == [tree.start[k], *tree.end[kids][:-1]] and tree.end[kids][-1] == tree.end[k]
        assert (tree.radius[kids] <= tree.level[k] / 2 + 1e-6).all()               # covering, with halved radii
        centres = unit[tree.centre[kids]]
        gaps = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0)) + 9 * np.eye(len(kids))
        assert (gaps > tree.level[k] / 2 - 1e-6).all()                             # separation


def sides(x, points, weights):
    return Side.built(points, weights, [v.tobytes() for v in x], "<f4")


@pytest.mark.parametrize("few", [1, 64, 1024])
def test_a_meeting_is_exact_and_prunes(monkeypatch, few):
    monkeypatch.setattr(cover, "FEW_PAIRS", few)
    monkeypatch.setattr(cover, "FEW_POINTS", min(few, 64))
    x = crowd(5, 60, [3, 30, 90, 200, 150])
    rng = np.random.default_rng(1)
    x = x[rng.permutation(len(x))]
    w = rng.integers(1, 4, len(x)).tolist()
    unit = units([v.tobytes() for v in x], "<f4")
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    half = len(x) // 2
    a = sides(x[:half], list(range(half)), w[:half])
    b = sides(x[half:], list(range(half, len(x))), w[half:])
    got = np.zeros(len(x), int)
    label = np.arange(len(x))
    compared = 0
    for one, two in ((a, None), (b, None), (a, b)):
        one, two = (Side.read(s.stored(), "<f4") if s else None for s in (one, two))
        meeting = Meeting(one, two, 0.9)
        compared += meeting.compared
        for what, p, q in meeting.rows():
            if what == 0:
                got[p] += q
            else:
                assert p != q
                label[label == label[p]] = label[q]
    assert got.tolist() == (linked @ np.array(w)).tolist()
    want = np.arange(len(x))
    for i, j in zip(*np.nonzero(linked), strict=True):
        want[want == want[i]] = want[j]
    assert len(set(zip(want.tolist(), label.tolist()))) == len(set(want.tolist())) == len(set(label.tolist()))
    if few == 1:
        assert compared < len(x) ** 2 / 2 * 0.8


def test_query_against_brute_force(spark, sf_dir):
    import __spark_entry__ as entry
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(entry.queries()["op13_cover_tree_links"](spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("cell, fan", [(32, 4), (60, 64)])
def test_many_levels_of_nodes(spark, monkeypatch, cell, fan):
    """Small cells, so that a few hundred vectors take several splits, with a hot group and vectors that no pivot parts."""
    monkeypatch.setattr(cover, "CELL", cell)
    monkeypatch.setattr(cover, "FAN", fan)
    monkeypatch.setattr(cover, "DEALT", 50)
    x = crowd(8, 120, [200, 3, 60, 30])
    same = [x[0] * np.float32(2.0 ** (k % 100 - 50)) * (1 + k // 100) for k in range(300)]
    rows = [(1000 - k, v) for k, v in enumerate([*x, *same])]
    rows += [(2000 + k, x[130]) for k in range(50)]
    assert found(embedding_links(frame(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0] + [0.0] * 7, [9.0, 3.0, 3.0, 1.0, 0, 0, 0, 0]                     # cosine 0.9 to the bit
    rows = [(1, a), (2, b), (3, None), (4, []), (5, [0.0] * 8), (6, [nan] + [1.0] * 7), (7, [inf] + [1.0] * 7),
            (8, a), (8, a), (None, [2.0] + [0.0] * 7), (None, None), (9, [1.0]), (10, [3.0]), (11, [-3.0]),
            (12, [1e-45] + [0.0] * 7), (13, [3e38] + [-0.0] * 7), (14, [-0.0] + [0.0] * 7), (None, [0, 1.0, 0, 0, 0, 0, 0, 0]),
            (15, [0.0, 1.0, 0.0, 0.0, -0.0, 0, 0, 0]), (-2 ** 62, [0, 0, 5.0, 0, 0, 0, 0, 0])]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("label", T.IntegerType()), T.StructField("p", T.StringType()),
                           T.StructField("cell", T.StringType()), T.StructField("vec", T.LongType())])
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], None, "p", "c", 1)
                                for i, v in [*rows, (16, [None] + [1.0] * 7)]], schema)
    tiny = np.array([1e-45] + [0] * 7, np.float32)
    want = brute([(i, list(tiny * 1e30) if i == 12 else v) for i, v in rows] + [(16, None)])
    assert found(embedding_links(df)) == want
    assert embedding_links(df.limit(0)).count() == 0
    assert found(embedding_links(df.select("vec_id", df["embedding"].cast("array<double>").alias("embedding")))) == want


def test_the_threshold_is_decided_by_the_exact_cosine():
    x = np.array([[1, 0, 0, 0], [9, 3, 3, 1]], np.float32)
    assert exact_cosine(x[0].tobytes(), x[1].tobytes(), "<f4") == 0.9
    assert exact_cosine(np.array([1e308, 0]).tobytes(), np.array([1e-308, 0]).tobytes(), "<f8") == pytest.approx(1)


@pytest.mark.parametrize("threshold", [0.5])
def test_other_thresholds(spark, monkeypatch, threshold):
    monkeypatch.setattr(cover, "CELL", 40)
    rows = list(enumerate(crowd(4, 80, [50, 20, 50])))
    assert found(embedding_links(frame(spark, rows), threshold=threshold)) == brute(rows, threshold)


def test_small_pairs_of_a_node_are_compared_at_once(monkeypatch):
    """Spread vectors, where bounds drop little: comparisons by node, not by pair of nodes."""
    x = np.random.default_rng(4).normal(size=(800, 32)).astype("<f4")
    x[400:600] = x[:200] + 0.05 * x[200:400]
    a, b = (sides(part, list(range(at, at + 400)), [1] * 400) for at, part in ((0, x[:400]), (400, x[400:])))
    calls, pairs = [], Meeting._pairs
    monkeypatch.setattr(Meeting, "_pairs", lambda self, *args: (calls.append(1), pairs(self, *args)))
    meeting = Meeting(a, b, 0.9)
    assert meeting.count_a.sum() == 200 and len(calls) <= len(a.start) + len(b.start)


def test_estimates_do_not_grow_with_the_levels(spark, monkeypatch):
    """The driver multiplies the planner's estimates: their digits are bounded, however many levels of nodes there are."""
    monkeypatch.setattr(cover, "CELL", 24)
    monkeypatch.setattr(cover, "FAN", 3)
    rows = list(enumerate(crowd(9, 250, [150])))
    levels, bits, assigned, descended = [], [], cover._assigned, cover._descended

    def estimate(df):
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()

    def assign(rest, number, kind):
        moved, centres = assigned(rest, number, kind)
        levels.append(number)
        bits.append(estimate(moved))
        return moved, centres

    def descend(*args):
        pairs, whole = descended(*args)
        bits.append(estimate(pairs))
        return pairs, whole
    monkeypatch.setattr(cover, "_assigned", assign)
    monkeypatch.setattr(cover, "_descended", descend)
    assert found(embedding_links(frame(spark, rows))) == brute(rows)
    assert len(levels) >= 4 and max(bits) < 512


def test_cells_are_sent_once_a_block(spark):
    """All cells meet all: each is sent once for each block, and each meeting is made in one tile that holds both."""
    names = [f"8.{k}" for k in range(40)]
    pairs = [(names[i], names[j]) for i in range(40) for j in range(i + 1)]
    sent = cover._tiles(spark.createDataFrame(pairs, "a string, b string"), 5).collect()
    assert len(sent) <= 40 * (5 + 1) and {r["tile"] for r in sent} == set(range(15))
    held = {(r["tile"], r["cell"]) for r in sent if r["role"] == 0}
    met = [(r["tile"], p, r["cell"]) for r in sent if r["role"] == 1 for p in r["partners"]]
    assert all((tile, p) in held for tile, p, _ in met)
    assert sorted(tuple(sorted(m[1:])) for m in met) == sorted(tuple(sorted(p)) for p in pairs)


@pytest.mark.parametrize("block, tiles", [(2_000, 4), (40_000, 1), (16_000_000, 1)])
def test_blocks_of_any_size(spark, monkeypatch, block, tiles):
    monkeypatch.setattr(cover, "CELL", 40)
    monkeypatch.setattr(cover, "BLOCK", block)
    monkeypatch.setattr(cover, "TILES", tiles)
    monkeypatch.setattr(cover, "MOST_TASKS", 7)
    monkeypatch.setattr(cover, "PAIRS", 3)
    rows = list(enumerate(crowd(6, 90, [60, 30])))
    assert found(embedding_links(frame(spark, rows))) == brute(rows)
