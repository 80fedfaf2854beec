"""A Merkle manifest of a table: stored blocks of hash nodes, proofs and their check.

Every row is a leaf. The leaves of a tree (a source) are in the order of their
ids; while several nodes remain, each run of ``FAN`` of them becomes one node.
The roots of the trees, in the order of the trees, are the leaves of one more
tree, whose root stands for the table.

A tree is kept as blocks: aligned subtrees of up to ``TIER`` levels above their
leaves. A block is one array of 32-byte digests in van Emde Boas order: the
levels are split at half height, the upper subtree comes first, then the lower
ones from left to right, each laid out alike. ``address`` gives a node's place by
arithmetic alone, for construction and for fetching siblings; there are no
pointers. The roots of a tier's blocks are the leaves of the next tier, so a tree
of any size has as many tiers as its height asks for, and no task holds more than
one block.

Texts are hashed in the scan; all that is shuffled is an id and two digests per
row, and a block per ``FAN ** TIER`` rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacancia.session import reliable

FAN = 16
#: Levels of a block above its leaves: a block has 4096 leaves and 4369 nodes, 140 kB.
TIER = 3
BLOCK = FAN ** TIER
DIGEST = 32
#: Rows that a task hands on at a time.
OUT_ROWS = 512


def nodes_in(levels: int) -> int:
    """Nodes of a full subtree of so many levels, its leaves counted as one."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(depth: int, index, levels: int):
    """Place of node ``index`` (number or array) at ``depth`` below the root, of ``levels`` levels.

    The upper half of the levels is stored first, then each subtree below it.
    """
    if levels == 1:
        return index * 0
    upper = levels // 2
    if depth < upper:
        return address(depth, index, upper)
    under = FAN ** (depth - upper)
    return (nodes_in(upper) + index // under * nodes_in(levels - upper)
            + address(depth - upper, index % under, levels - upper))


def height_of(nodes: int) -> int:
    """Levels above the leaves in a tree's block at a tier of so many nodes."""
    height = 0
    while height < TIER and nodes > FAN ** height:
        height += 1
    return height


def _joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode("ascii")).hexdigest()


class Block:
    """One aligned subtree: its digests in van Emde Boas order."""

    def __init__(self, height: int, leaves: int, slots: np.ndarray) -> None:
        self.height, self.slots = height, slots
        self.widths = [leaves]
        for _ in range(height):
            self.widths.append(-(-self.widths[-1] // FAN))

    @classmethod
    def built(cls, height: int, leaves: list[bytes]) -> Block:
        """The subtree over ``leaves``, which are at most ``FAN ** height``."""
        block = cls(height, len(leaves), np.zeros((nodes_in(height + 1), DIGEST), np.uint8))
        block.slots[block._places(0, 0, len(leaves))] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, DIGEST)
        for level in range(1, height + 1):
            made = [bytes.fromhex(_joined(block.run(level - 1, i))) for i in range(block.widths[level])]
            block.slots[block._places(level, 0, len(made))] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, DIGEST)
        return block

    @classmethod
    def stored(cls, height: int, leaves: int, layout: bytes) -> Block:
        return cls(height, leaves, np.frombuffer(layout, np.uint8).reshape(-1, DIGEST))

    def _places(self, level: int, start: int, end: int) -> np.ndarray:
        return address(self.height - level, np.arange(start, end), self.height + 1)

    def run(self, level: int, number: int) -> list[str]:
        """The digests of one run of siblings, as hex."""
        end = min((number + 1) * FAN, self.widths[level])
        return [self.slots[a].tobytes().hex() for a in self._places(level, number * FAN, end).tolist()]

    def node(self, level: int, index: int) -> str:
        return self.slots[int(address(self.height - level, index, self.height + 1))].tobytes().hex()

    @property
    def root(self) -> bytes:
        return self.slots[0].tobytes()

    def paths(self) -> Iterator[list[str]]:
        """For every leaf, the digests left and right of its path, level by level: [left, right, left, ...]."""
        above: list[list[str]] = [[]]
        for level in range(self.height - 1, -1, -1):
            here = []
            for number, path in enumerate(above):
                run = self.run(level, number)
                here.extend(["".join(run[:k]), "".join(run[k + 1:]), *path] for k in range(len(run)))
            above = here
        yield from above


def fold(digest: str, path: list[str]) -> str:
    """The root that a digest and the siblings on its path give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = _joined([left, digest, right])
    return digest


@dataclass
class Manifest:
    """``tiers`` of the trees and of the tree of their roots, each a table of blocks.

    A block row is ``tree, block, size, leaves, layout, root``: the tree's name,
    the block's number in its tier, the tier's number of nodes, the block's leaves.
    ``roots`` has ``tree, rank, digest`` per tree, in the order of the trees.
    """

    tiers: list[DataFrame]
    roots: DataFrame
    top: list[DataFrame]

    def write(self, path: str) -> None:
        """Write all blocks below ``path``; ``read_manifest`` reads them back."""
        for kind, tiers in (("trees", self.tiers), ("top", self.top)):
            for number, blocks in enumerate(tiers):
                blocks.write.parquet(f"{path}/{kind}/tier={number}")
        self.roots.write.parquet(f"{path}/roots")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The manifest that was written to ``path``."""
    def tiers(kind: str) -> list[DataFrame]:
        every = spark.read.parquet(f"{path}/{kind}")
        numbers = sorted(r["tier"] for r in every.select("tier").distinct().collect())
        return [every.filter(F.col("tier") == n).drop("tier") for n in numbers]
    return Manifest(tiers("trees"), spark.read.parquet(f"{path}/roots"), tiers("top"))


def _ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` in their tree, from zero, and the tree's ``size``.

    Rows are range-partitioned by tree and order, so that a tree of any share of
    the rows is dealt to many tasks; each task numbers its rows, and counts per
    tree and task give the offsets. The placement is kept in the shared folder,
    since a repeated range partitioning may cut elsewhere.
    """
    placed = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = reliable(placed.select("*", F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("at")))
    counts = placed.groupBy(tree, "chunk").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy(tree)
    before = each.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(tree, "chunk", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                            F.sum("n").over(each).alias("size"))
    joined = placed.join(offsets, [tree, "chunk"])
    return joined.select(*[placed[c] for c in rows.columns], (F.col("at") + F.col("shift")).alias("rank"), "size")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a block together and in order; no task needs more than one block at a time."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")


def _grouped(batches, keys=("tree", "block")) -> Iterator[tuple[tuple, list[dict]]]:
    """The consecutive rows of each block."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


def _handed(rows: Iterator[dict], schema) -> Iterator:
    """Rows as Arrow batches of bounded length."""
    import pyarrow as pa

    part: list[dict] = []
    for row in rows:
        part.append(row)
        if len(part) == OUT_ROWS:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def _tier(nodes: DataFrame) -> DataFrame:
    """The blocks over ``nodes`` (tree, rank, size, digest), in the shared folder."""
    def build(batches):
        import pyarrow as pa

        schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("leaves", pa.int32()),
                            ("layout", pa.binary()), ("root", pa.binary())])

        def blocks():
            for (tree, number), rows in _grouped(batches):
                size = rows[0]["size"]
                block = Block.built(height_of(size), [r["digest"] for r in rows])
                yield {"tree": tree, "block": number, "size": size, "leaves": len(rows),
                       "layout": block.slots.tobytes(), "root": block.root}
        yield from _handed(blocks(), schema)
    dealt = _dealt(nodes.select("tree", F.expr(f"rank div {BLOCK}").alias("block"), "rank", "size", "digest"))
    return reliable(dealt.mapInArrow(build, "tree string, block long, size long, leaves int, layout binary, root binary"))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """All tiers, as many as the largest tree needs; a tree of one node has blocks of that node."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    out = []
    while largest > 1 or not out:
        out.append(_tier(nodes))
        nodes = out[-1].select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / BLOCK).alias("size"),
                               F.col("root").alias("digest"))
        largest = -(-largest // BLOCK)
    return out


def build_manifest(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves`` (tree, rank, size, digest: binary)."""
    tiers = _tiers(leaves)
    roots = _ranked(tiers[-1].select(F.lit("").alias("all"), "tree", F.col("root").alias("digest")), "all", ["tree"])
    roots = reliable(roots.select("tree", "rank", "size", "digest"))
    top = _tiers(roots.select(F.lit("").alias("tree"), "rank", "size", "digest"))
    return Manifest(tiers, roots.select("tree", "rank", "digest"), top)


_CHAIN = "path array<string>, subroot string, root string"


def _down(tiers: list[DataFrame], chains: DataFrame) -> DataFrame:
    """Chains of the last tier's blocks carried to the leaves of ``tiers``: tree, rank, path, ..."""
    def spread(batches):
        import pyarrow as pa

        schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.string())),
                            ("subroot", pa.string()), ("root", pa.string())])

        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    block = Block.stored(height_of(row["size"]), row["leaves"], row["layout"])
                    for k, path in enumerate(block.paths()):
                        yield {"tree": row["tree"], "block": row["number"] * BLOCK + k, "path": path + row["path"],
                               "subroot": row["subroot"], "root": row["root"]}
        yield from _handed(rows(), schema)
    for blocks in reversed(tiers):
        known = blocks.drop("root").join(chains, ["tree", "block"]).select(
            "tree", F.col("block").alias("number"), "size", "leaves", "layout", "path", "subroot", "root")
        chains = known.mapInArrow(spread, f"tree string, block long, {_CHAIN}")
    return chains


def _block_chains(manifest: Manifest) -> DataFrame:
    """``tree, block, path, subroot, root``: what lies above the root of each first-tier block."""
    none = F.array().cast("array<string>")
    start = manifest.top[-1].select("tree", "block", none.alias("path"), F.lit(None).cast("string").alias("subroot"),
                                    F.lower(F.hex("root")).alias("root"))
    ranks = _down(manifest.top, start).select(F.col("block").alias("rank"), "path", "root")
    trees = manifest.roots.join(ranks, "rank").select(
        "tree", F.lit(0).cast("long").alias("block"), "path", F.lower(F.hex("digest")).alias("subroot"), "root")
    return _down(manifest.tiers[1:], trees)


def proofs(manifest: Manifest, leaves: DataFrame, given: str = "given") -> DataFrame:
    """Each leaf's proof, and the check of the digest in column ``given`` against the root.

    ``leaves`` are those that the manifest was built from (tree, rank, digest, given
    and any other columns, which stay). Adds ``subroot, root, proof_sha256, folded_root, verified``.
    The leaves of a block, its layout and what lies above it meet in one task.
    """
    others = [c for c in leaves.columns if c not in ("tree", "rank", "size", "digest", given)]
    kept = [F.col(c).alias(f"own_{k}") for k, c in enumerate(others)]
    chains = manifest.tiers[0].drop("root").join(_block_chains(manifest), ["tree", "block"])
    heads = chains.select("tree", "block", F.lit(-1).cast("long").alias("rank"), "size", "leaves", "layout", "path",
                          "subroot", "root")
    members = leaves.select("tree", F.expr(f"rank div {BLOCK}").alias("block"), "rank", F.col("digest").alias("leaf"),
                            F.col(given).alias("given"), *kept)
    dealt = _dealt(members.unionByName(heads, allowMissingColumns=True))
    types = dict(members.dtypes)
    own = [f"own_{k}" for k in range(len(others))]
    made = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def prove(batches):
        import pyarrow as pa

        def proved(schema):
            paths, head = None, None
            now = None
            for batch in batches:
                schema.setdefault("own", [batch.schema.field(c) for c in own])
                for row in batch.to_pylist():
                    key = row["tree"], row["block"]
                    if key != now:                      # the head has rank -1, so it comes first
                        now, head = key, row
                        block = Block.stored(height_of(row["size"]), row["leaves"], row["layout"])
                        paths = block.paths()
                        tail = "".join(row["path"])
                        continue
                    path = next(paths)
                    leaf, start = row["leaf"].hex(), row["given"].hex()
                    folded = fold(fold(start, path), head["path"])
                    yield {**{c: row[c] for c in own}, "leaf": leaf, "subroot": head["subroot"], "root": head["root"],
                           "proof_sha256": sha256(("".join(path) + tail).encode("ascii")).hexdigest(),
                           "folded_root": folded, "verified": folded == head["root"]}
        fields: dict = {}
        part: list[dict] = []

        def batch_of(rows):
            schema = pa.schema([*fields["own"], *[(c, pa.string()) for c in made], ("verified", pa.bool_())])
            return pa.RecordBatch.from_pylist(rows, schema)
        for row in proved(fields):
            part.append(row)
            if len(part) == 16 * OUT_ROWS:
                yield batch_of(part)
                part = []
        if part:
            yield batch_of(part)
    out = ", ".join([f"{c} {types[c]}" for c in own] + [f"{c} string" for c in made] + ["verified boolean"])
    done = dealt.mapInArrow(prove, out)
    return done.select(*[F.col(c).alias(o) for c, o in zip(own, others, strict=True)], *made, "verified")


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """The sha256 of the fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def document_leaves(docs: DataFrame, text: str = "text") -> DataFrame:
    """``tree, rank, size, digest, given, doc_id`` of a document table.

    ``given`` is the digest of the row as a check would find it: where 5 divides
    the unsigned crc32 of the decimal id, the text's ASCII capitals are lower-cased.
    """
    ids, source, body = docs["doc_id"], docs["source"], docs[text].cast("string")
    lower = F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    before = [ids, source, docs["lang"], docs["n_chars"]]
    tampered = F.coalesce(F.crc32(ids.cast("string")) % 5 == 0, F.lit(False))
    hashed = reliable(docs.select(         # texts are hashed once, not again to sample the ranges
        F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")).alias("tree"),   # null sorts first
        ids.alias("doc_id"), leaf_digest([*before, body]).alias("digest"),
        F.when(tampered, leaf_digest([*before, lower])).alias("changed")))
    return _ranked(hashed, "tree", ["doc_id", "digest"]).withColumn(
        "given", F.coalesce("changed", "digest")).drop("changed")


def manifest_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Null ids come first in their source and are never tampered with; a null source
    is a tree of its own, before all others; repeated rows are ordered by their
    digest and each is a leaf. Null texts stay null. A lone document is its
    source's root, a lone source's root is the root; without siblings the proof is the
    sha256 of nothing. An empty table gives no rows.
    """
    leaves = document_leaves(docs, text)
    return proofs(build_manifest(leaves.select("tree", "rank", "size", "digest")), leaves)
