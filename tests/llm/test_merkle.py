import zlib
from hashlib import sha256

import numpy as np
import pytest

from vacancia.llm import merkle
from vacancia.llm.merkle import Block, address, build_manifest, document_leaves, fold, height_of, manifest_report, nodes_in
from vacancia.llm.merkle import proofs, read_manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def brute(rows):
    trees = {}
    for d, t, lang, s, n in rows:
        given = t
        if d is not None and t is not None and zlib.crc32(str(d).encode()) % 5 == 0:
            given = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        trees.setdefault(s, []).append((d, leaf_of(d, s, lang, n, t), leaf_of(d, s, lang, n, given)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[s] = levels_of([r[1] for r in trees[s]])
    top = levels_of([built[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for p, (d, leaf, given) in enumerate(trees[s]):
            proof, cur = "", given
            for levels, at in ((built[s], p), (top, k)):
                for nodes in levels[:-1]:
                    run = at // 16 * 16
                    left, right = "".join(nodes[run:at]), "".join(nodes[at + 1:run + 16])
                    proof, cur, at = proof + left + right, h(left, cur, right), at // 16
            root = top[-1][0]
            out.append((d, leaf, built[s][-1][0], root, h(proof), cur, cur == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("levels", [1, 2, 3, 4])
def test_addresses_are_one_place_per_node_and_subtrees_are_contiguous(levels):
    places = [address(d, np.arange(16 ** d), levels).tolist() for d in range(levels)]
    assert sorted(p for depth in places for p in depth) == list(range(nodes_in(levels)))
    upper = levels // 2
    if upper:
        assert sorted(p for d in range(upper) for p in places[d]) == list(range(nodes_in(upper)))
        below = levels - upper
        for k in range(16 ** upper):                      # each lower subtree is one stretch
            own = [p for d in range(below) for p in places[upper + d][k * 16 ** d:(k + 1) * 16 ** d]]
            start = nodes_in(upper) + k * nodes_in(below)
            assert sorted(own) == list(range(start, start + nodes_in(below)))
            assert [p - start for d in range(below) for p in places[upper + d][k * 16 ** d:(k + 1) * 16 ** d]] == [
                int(a) for d in range(below) for a in address(d, np.arange(16 ** d), below)]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33, 256, 257, 300, 4096])
def test_a_block_is_the_plain_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    want = levels_of(leaves)
    height = height_of(n)
    assert height == len(want) - 1
    block = Block.built(height, [bytes.fromhex(x) for x in leaves])
    again = Block.stored(height, n, block.slots.tobytes())
    for level, nodes in enumerate(want):
        assert [again.node(level, i) for i in range(len(nodes))] == nodes
    paths = list(again.paths())
    assert len(paths) == n and all(fold(x, p) == want[-1][0] for x, p in zip(leaves, paths, strict=True))
    if n > 1:
        assert fold(h("other"), paths[n // 2]) != want[-1][0]


def test_against_brute_force(spark, sf_dir):
    import __spark_entry__ as entry
    rows = rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = found(entry.queries()["op11_merkle_manifest"](spark, sf_dir))
    assert got == brute(rows) and 0 < sum(not r[-1] for r in got) < len(got)


def test_awkward_rows(awkward, nothing):
    assert found(manifest_report(awkward)) == brute(rows_of(awkward))
    empty = manifest_report(nothing)
    assert empty.columns == COLUMNS and empty.count() == 0


def test_one_row(spark):
    row = [(5, "Text", "en", None, 4)]
    df = spark.createDataFrame(row, "doc_id long, text string, lang string, source string, n_chars long")
    got = found(manifest_report(df))
    assert got == brute(row) and got[0][4] == h() and got[0][1] == got[0][2] == got[0][3]


@pytest.mark.parametrize("sizes", [{"hot": 4200, "b": 257, None: 40, "": 1, "é": 17, "z": 16}, {f"s{k}": 1 for k in range(300)}])
def test_many_tiers(spark, monkeypatch, sizes):
    """Blocks of one level, so that a few thousand rows take several tiers."""
    monkeypatch.setattr(merkle, "TIER", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((at * 7 % 10007, f"Text {at % 50}", "en", source, None))
            at += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert found(manifest_report(df)) == brute(rows)


def test_the_last_block_of_a_tier_keeps_the_tier_height(spark):
    rows = [(k, "t", "en", "s", 1) for k in range(4097)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(manifest_report(df)) == brute(rows)


def test_written_and_read_again(spark, awkward, tmp_path):
    leaves = document_leaves(awkward)
    build_manifest(leaves.select("tree", "rank", "size", "digest")).write(f"file://{tmp_path}/m")
    assert found(proofs(read_manifest(spark, f"file://{tmp_path}/m"), leaves)) == brute(rows_of(awkward))
