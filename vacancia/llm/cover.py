"""Exact embedding near-duplicates by dual traversal of cover trees.

Vectors are compared on the unit sphere, where the chord between two of them is
a metric and a cosine of ``threshold`` is a chord of sqrt(2 - 2 threshold). Equal
vectors are one point that stands for all of them.

Points are dealt into cells of bounded size by repeated splits around pivots, so
the cells are the lowest of a few levels of nodes, each with a centre and a
covering radius. Within a cell the points form a cover tree: nested levels whose
radii halve, where the points of a level are further apart than its radius and
every point lies within the radius of its parent.

Both parts are traversed in pairs, from the root down. Two nodes with centres at
distance d and covering radii r and s are dropped if d - r - s exceeds the chord,
and linked as a whole, unseen, if d + r + s does not; else their children meet. The
upper levels are one join a level, the cover trees of two cells meet in one task.
A meeting returns counts per point and a spanning forest, never its pairs, so
a group of near copies of any size costs rows in proportion to its points.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.components import components
from vacancia.session import reliable, unsized

THRESHOLD = 0.9
#: Points of a cell, children of a node above it, and points dealt to their pivots at a time.
CELL, FAN, DEALT = 2048, 64, 8192
#: Bytes of cover trees that a task holds, to meet others one after the other; tiles of meetings a core; tasks at most.
BLOCK, TILES, MOST_TASKS = 16_000_000, 4, 10_000
#: Pairs of nodes whose children meet in one task.
PAIRS = 512
#: Bounds on chords are used only beyond this distance, well above their rounding errors.
SLACK = 1e-6
#: Cosines this close to the threshold are worked out again, component by component.
CLOSE = 1e-9
#: Subtrees of so few pairs are compared point by point, and so few points of a subtree with single points.
FEW_PAIRS, FEW_POINTS = 1024, 64
#: Narrow rows that are broadcast at most, a few MB.
MOST_BROADCAST = 50_000
#: A split that leaves this share of a node together is followed by splits by hash.
STUCK = 0.95


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; nothing is rounded."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def units(vectors: list[bytes], kind: str) -> np.ndarray:
    """Stored vectors as rows of length one, in double precision."""
    x = _scaled(np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosine(a: bytes, b: bytes, kind: str) -> float:
    """The cosine of two stored vectors from correctly rounded sums of their products."""
    x, y = (_scaled(np.frombuffer(v, kind).astype(np.float64)) for v in (a, b))
    return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y)))


class CoverTree:
    """A cover tree over a few thousand points, as flat arrays.

    ``order`` has the points so that each node's are consecutive; node k covers
    ``start[k]:end[k]`` of it, around point ``centre[k]``, within ``radius[k]``; its
    children are the nodes ``child[k]`` to ``child[k] + children[k]``, single points
    first. ``level[k]`` bounds the radius, is halved from a node to its children, and
    is less than the distance between any two children's centres.
    """

    def __init__(self, x: np.ndarray) -> None:
        chords = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0))
        n = len(x)
        first = int(chords.max(axis=1).argmin()) if n else 0
        order = np.arange(n)
        centre, start, end, radius, level, child, children = [], [], [], [], [], [], []

        def add(c: int, s: int, e: int, bound: float) -> None:
            centre.append(c)
            start.append(s)
            end.append(e)
            radius.append(float(chords[c, order[s:e]].max()))
            level.append(bound)
            child.append(0)
            children.append(0)
        add(first, 0, n, 2.0)
        at = 0
        while at < len(centre):
            c, s, e = centre[at], start[at], end[at]
            if e - s > 1 and radius[at] > SLACK:
                while level[at] / 2 >= radius[at]:
                    level[at] /= 2
                bound = level[at] / 2
                rest, net = order[s:e].copy(), []
                q = c
                while True:                       # the node's own centre comes first: the levels are nested
                    near = chords[q, rest] <= bound
                    net.append((q, rest[near]))
                    rest = rest[~near]
                    if not len(rest):
                        break
                    q = int(rest[0])
                net.sort(key=lambda m: len(m[1]) > 1)
                child[at], children[at] = len(centre), len(net)
                place = s
                for q, members in net:
                    order[place:place + len(members)] = members
                    add(q, place, place + len(members), bound)
                    place += len(members)
            at += 1
        place_of = np.empty(n, np.int64)
        place_of[order] = np.arange(n)
        self.order = order
        self.centre = place_of[np.array(centre, np.int64)]
        self.start, self.end = np.array(start, np.int64), np.array(end, np.int64)
        self.radius, self.level = np.array(radius), np.array(level)
        self.child, self.children = np.array(child, np.int64), np.array(children, np.int64)


class Side:
    """A cell's tree with its points: what one side of a traversal needs."""

    _INTS = ("centre", "start", "end", "child", "children")

    def __init__(self, tree, points: np.ndarray, weights: np.ndarray, vectors: list[bytes], kind: str) -> None:
        self.points, self.weights, self.vectors, self.kind = points, weights, vectors, kind
        self.x = units(vectors, kind)
        for name in (*self._INTS, "radius"):
            setattr(self, name, getattr(tree, name))

    @classmethod
    def built(cls, points: list[int], weights: list[int], vectors: list[bytes], kind: str) -> Side:
        tree = CoverTree(units(vectors, kind))
        order = tree.order.tolist()
        return cls(tree, np.array(points, np.int64)[order], np.array(weights, np.int64)[order],
                   [vectors[i] for i in order], kind)

    def stored(self) -> dict[str, bytes]:
        ints = np.concatenate([getattr(self, name) for name in self._INTS])
        return {"points": self.points.tobytes(), "weights": self.weights.tobytes(), "vectors": b"".join(self.vectors),
                "nodes": ints.tobytes(), "radii": self.radius.tobytes()}

    @classmethod
    def read(cls, row: dict, kind: str) -> Side:
        class Tree:
            pass
        tree = Tree()
        for name, values in zip(cls._INTS, np.frombuffer(row["nodes"], np.int64).reshape(len(cls._INTS), -1), strict=True):
            setattr(tree, name, values)
        tree.radius = np.frombuffer(row["radii"])
        points = np.frombuffer(row["points"], np.int64)
        size = len(row["vectors"]) // len(points)
        vectors = [row["vectors"][i * size:(i + 1) * size] for i in range(len(points))]
        return cls(tree, points, np.frombuffer(row["weights"], np.int64), vectors, kind)

    def kids(self, k: int) -> np.ndarray:
        return np.arange(self.child[k], self.child[k] + self.children[k]) if self.children[k] else np.array([k])


class Meeting:
    """The links between two cells, or inside one: ``counts`` per point and a forest."""

    def __init__(self, a: Side, b: Side | None, threshold: float) -> None:
        self.a, self.b, self.same = a, (a if b is None else b), b is None
        self.threshold, self.chord = threshold, math.sqrt(2 - 2 * threshold)
        self.count_a = np.zeros(len(a.points), np.int64)
        self.count_b = self.count_a if self.same else np.zeros(len(self.b.points), np.int64)
        self.shift = 0 if self.same else len(a.points)
        self.label = np.arange(self.shift + len(self.b.points))
        self.compared = 0
        self._traverse()

    def _merge(self, x: np.ndarray, y: np.ndarray) -> None:
        """Give the ends of each link one label, the smallest of what they join."""
        while True:
            p, q = self.label[x], self.label[y]
            apart = p != q
            if not apart.any():
                return
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.label = parent[self.label]

    def _linked(self, cosines: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of a matrix of cosines that are linked; ``rows`` and ``cols`` are its points."""
        self.compared += cosines.size
        i, j = np.nonzero(cosines >= self.threshold - CLOSE)
        keep = np.ones(len(i), bool)
        for k in np.flatnonzero(cosines[i, j] < self.threshold + CLOSE):
            keep[k] = exact_cosine(self.a.vectors[rows[i[k]]], self.b.vectors[cols[j[k]]], self.a.kind) >= self.threshold
        if self.same:
            keep &= rows[i] != cols[j]
        return i[keep], j[keep]

    def _pairs(self, rows: np.ndarray, cols: np.ndarray, cosines: np.ndarray, both: bool) -> None:
        """Count and join the linked pairs; ``both`` if a pair inside a cell is seen once."""
        i, j = self._linked(cosines, rows, cols)
        if not len(i):
            return
        x, y = rows[i], cols[j]
        np.add.at(self.count_a, x, self.b.weights[y])
        if both:
            np.add.at(self.count_b, y, self.a.weights[x])
        self._merge(x, y + self.shift)

    def _points(self, i: int, j: int) -> None:
        """Compare all points of two nodes."""
        a, b = self.a, self.b
        rows, cols = np.arange(a.start[i], a.end[i]), np.arange(b.start[j], b.end[j])
        self._pairs(rows, cols, a.x[rows] @ b.x[cols].T, not (self.same and i == j))

    def _whole(self, i: int, j: int) -> None:
        """Link all points of one node with all of another, or a node's with each other."""
        a, b = self.a, self.b
        rows, cols = np.arange(a.start[i], a.end[i]), np.arange(b.start[j], b.end[j])
        self.count_a[rows] += b.weights[cols].sum()
        if self.same and i == j:
            self.count_a[rows] -= a.weights[rows]
        else:
            self.count_b[cols] += a.weights[rows].sum()
        self._merge(np.concatenate([rows, np.full(len(cols), rows[0])]),
                    np.concatenate([np.full(len(rows), cols[0]), cols]) + self.shift)

    def _traverse(self) -> None:
        a, b, stack = self.a, self.b, [(0, 0)]
        queries: list[tuple[int, np.ndarray, bool]] = []
        while stack or queries:
            if queries:
                self._query(*queries.pop(), queries)
                continue
            i, j = stack.pop()
            within = self.same and i == j
            if within and a.end[i] - a.start[i] == 1:
                continue
            pairs = (a.end[i] - a.start[i]) * (b.end[j] - b.start[j])
            if pairs <= FEW_PAIRS or not (a.children[i] or b.children[j]):
                self._points(i, j)
                continue
            left, right = a.kids(i), b.kids(j)
            cosines = a.x[a.centre[left]] @ b.x[b.centre[right]].T
            one_a = int((a.end[left] - a.start[left] == 1).sum())       # single points come first
            one_b = int((b.end[right] - b.start[right] == 1).sum())
            rows, cols = a.start[left[:one_a]], b.start[right[:one_b]]
            # Inside one node, each pair of single points shows twice, on both sides.
            self._pairs(rows, cols, cosines[:one_a, :one_b], not within)
            self._near(a, left[one_a:], cols, cosines[one_a:, :one_b], True, queries)
            if not within:
                self._near(b, right[one_b:], rows, cosines[:one_a, one_b:].T, False, queries)
            self._meet(left[one_a:], right[one_b:], cosines[one_a:, one_b:], within, stack)

    def _near(self, side: Side, nodes: np.ndarray, points: np.ndarray, cosines: np.ndarray, left: bool, queries: list) -> None:
        """Nodes of more than one point with single points of the other side: all of those in reach go on together."""
        if not cosines.size:
            return
        self.compared += cosines.size
        near = np.sqrt(np.maximum(2 - 2 * cosines, 0)) <= side.radius[nodes][:, None] + self.chord + SLACK
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            queries.append((int(nodes[k]), points[near[k]], left))

    def _query(self, k: int, points: np.ndarray, left: bool, queries: list) -> None:
        """One node of the left (or right) side with some points of the other."""
        side, other = (self.a, self.b) if left else (self.b, self.a)

        def pairs(own: np.ndarray, cosines: np.ndarray) -> None:
            if left:
                self._pairs(own, points, cosines, True)
            else:
                self._pairs(points, own, cosines.T, True)
        if side.end[k] - side.start[k] <= FEW_POINTS or not side.children[k]:
            own = np.arange(side.start[k], side.end[k])
            pairs(own, side.x[own] @ other.x[points].T)
            return
        kids = side.kids(k)
        cosines = side.x[side.centre[kids]] @ other.x[points].T
        ones = int((side.end[kids] - side.start[kids] == 1).sum())
        pairs(side.start[kids[:ones]], cosines[:ones])
        self._near(side, kids[ones:], points, cosines[ones:], left, queries)

    def _meet(self, left: np.ndarray, right: np.ndarray, cosines: np.ndarray, within: bool, stack: list) -> None:
        """Nodes of more than one point with each other: drop, link as a whole, or go on below."""
        if not cosines.size:
            return
        self.compared += cosines.size
        apart = np.sqrt(np.maximum(2 - 2 * cosines, 0))
        reach = self.a.radius[left][:, None] + self.b.radius[right][None, :]
        near = apart <= reach + self.chord + SLACK
        if within:
            near &= left[:, None] <= right[None, :]
        whole = near & (apart + reach <= self.chord - SLACK)
        for i, j in zip(*np.nonzero(whole), strict=True):
            self._whole(int(left[i]), int(right[j]))
        near &= ~whole
        # Small pairs are compared point by point: all those of a node at once.
        sizes = (self.a.end[left] - self.a.start[left])[:, None] * (self.b.end[right] - self.b.start[right])[None, :]
        few = near & (sizes <= FEW_PAIRS)
        if within:
            few &= left[:, None] != right[None, :]
        for i in np.flatnonzero(few.any(axis=1)).tolist():
            rows = np.arange(self.a.start[left[i]], self.a.end[left[i]])
            cols = np.concatenate([np.arange(self.b.start[j], self.b.end[j]) for j in right[few[i]].tolist()])
            self._pairs(rows, cols, self.a.x[rows] @ self.b.x[cols].T, True)
        stack.extend((int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(near & ~few), strict=True))

    def rows(self) -> Iterator[tuple[int, int, int]]:
        """``(0, point, count)`` of linked points and ``(1, point, point)`` of the forest."""
        sides = [(self.a, self.count_a)] if self.same else [(self.a, self.count_a), (self.b, self.count_b)]
        for side, count in sides:
            some = np.flatnonzero(count)
            yield from ((0, p, c) for p, c in zip(side.points[some].tolist(), count[some].tolist(), strict=True))
        points = self.a.points if self.same else np.concatenate([self.a.points, self.b.points])
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        yield from ((1, p, q) for p, q in zip(points[moved].tolist(), points[self.label[moved]].tolist(), strict=True))


def _packed(rows: DataFrame, vector: str, vec_id: str) -> tuple[DataFrame, str]:
    """``id, vec`` per row, and how a component is stored; vec is null where nothing can be linked."""
    real = rows.schema[vector].dataType.elementType.simpleString() == "float"
    kind = "<f4" if real else "<f8"
    plain = rows.select(rows[vec_id].cast("long").alias("id"),
                        rows[vector].cast("array<float>" if real else "array<double>").alias("v"))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("v")
            values = lists.values.to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)   # no negative zero
            offsets, known = lists.offsets.to_pylist(), lists.is_valid().to_pylist()
            out = []
            for k, there in enumerate(known):
                v = values[offsets[k]:offsets[k + 1]]
                out.append(v.tobytes() if there and v.any() and np.isfinite(v).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "vec"])
    return reliable(plain.mapInArrow(pack, "id long, vec binary")), kind


def _segments(batches, keys: tuple[str, ...]) -> Iterator[tuple[tuple, object]]:
    """Stretches of equal keys of sorted batches; a key may come in several stretches."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or any(c[i] != c[start] for c in columns):
                yield tuple(c[start] for c in columns), batch.slice(start, i - start)
                start = i


def _assigned(rest: DataFrame, number: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Points of large nodes (p, n, vec, cell, size, hashed) dealt to children around pivots.

    Returns ``p, n, vec, cell, dist`` with the child as cell, and the pivots: cell
    (the child), centre. A node's pivots are the points with the smallest number in each of its
    hash buckets, at most ``FAN``. A node's points are dealt to as many tasks as its size asks for.
    """
    fan = F.least(F.lit(FAN), F.ceil(F.col("size") * 2 / CELL)).cast("int")
    rest = rest.withColumn("bucket", F.pmod(F.xxhash64("p", F.lit(number)), fan).cast("int"))
    chosen = rest.groupBy("cell", "bucket").agg(F.min("p").alias("p"))
    pivots = unsized(rest.select("p", "vec", "size", "hashed").join(chosen, "p"))
    stretches = F.ceil(F.col("size") / DEALT).cast("int")
    heads = pivots.groupBy("cell").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "vec"))).alias("pivots"), F.first("hashed").alias("hashed"),
        F.first("size").alias("size"))
    heads = heads.select("cell", F.explode(F.sequence(F.lit(0), stretches - 1)).alias("stretch"), F.lit(0).alias("role"),
                         "pivots", "hashed")
    members = rest.select("cell", F.pmod(F.xxhash64(F.lit(number), "p"), stretches).cast("int").alias("stretch"),
                          F.lit(1).alias("role"), "p", "n", "vec", "bucket")
    dealt = (members.unionByName(heads, allowMissingColumns=True)
             .repartition("cell", "stretch").sortWithinPartitions("cell", "stretch", "role"))

    def assign(batches):
        import pyarrow as pa

        now, buckets, centres, hashed = None, None, None, False
        for key, part in _segments(batches, ("cell", "stretch")):
            if key != now:
                now, head = key, part.column("pivots")[0].as_py()
                hashed = part.column("hashed")[0].as_py()
                buckets = np.array([h["bucket"] for h in head])
                centres = units([h["vec"] for h in head], kind)
                part = part.slice(1)
            if not part.num_rows:
                continue
            cosines = units(part.column("vec").to_pylist(), kind) @ centres.T
            if hashed:
                pick = np.searchsorted(buckets, np.array(part.column("bucket").to_pylist()))
            else:
                pick = cosines.argmax(axis=1)
            dist = np.sqrt(np.maximum(2 - 2 * cosines[np.arange(len(pick)), pick], 0))
            names = [f"{now[0]}.{b}" for b in buckets[pick].tolist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("p"), part.column("n"), part.column("vec"), pa.array(names), pa.array(dist)],
                ["p", "n", "vec", "cell", "dist"])
    moved = unsized(dealt.mapInArrow(assign, "p long, n long, vec binary, cell string, dist double"))
    centres = pivots.select(F.concat_ws(".", "cell", F.col("bucket").cast("string")).alias("cell"), F.col("vec").alias("centre"))
    return moved, centres


def _sent(small: DataFrame) -> DataFrame:
    """A narrow table for a join: broadcast if its rows are counted to be few."""
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def _parent(cell: Column) -> Column:
    return F.regexp_replace(cell, r"\.[0-9]+$", "")


def _cells(points: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """``p, n, vec, cell`` in cells of at most ``CELL`` points, and the nodes above and at them.

    A node row has ``cell, centre, radius, size, weight, rep``: covering radius, points,
    rows that they stand for, and one of its points. The roots, one per vector length, have no centre.
    """
    now = points.select("p", "n", "vec", F.octet_length("vec").cast("string").alias("cell"), F.lit(2.0).alias("dist"))
    done, nodes, before = [], [], None
    number = 0
    while True:
        sizes = now.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("p").alias("rep"),
                                        F.max("dist").alias("radius"))
        if before is None:
            sizes = unsized(sizes.withColumn("hashed", F.lit(False)))
            nodes.append(sizes.select("cell", F.lit(None).cast("binary").alias("centre"), "radius", "size", "weight", "rep"))
        else:
            above = before.select(F.col("cell").alias("up"), F.col("size").alias("above"), F.col("hashed").alias("was"))
            sizes = sizes.join(above, _parent(F.col("cell")) == F.col("up"))
            sizes = unsized(sizes.withColumn("hashed", F.col("was") | (F.col("size") > STUCK * F.col("above")))
                            .drop("up", "above", "was"))
            nodes.append(sizes.join(centres, "cell").select("cell", "centre", "radius", "size", "weight", "rep"))
        marked = now.join(_sent(sizes.select("cell", "size", "hashed")), "cell")
        done.append(marked.filter(F.col("size") <= CELL).select("p", "n", "vec", "cell"))
        if sizes.filter(F.col("size") > CELL).isEmpty():
            break
        now, centres = _assigned(marked.filter(F.col("size") > CELL), number, kind)
        before, number = sizes, number + 1
    every, cells = nodes[0], done[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    for more in done[1:]:
        cells = cells.unionByName(more)
    return cells, reliable(every)


def _descended(nodes: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of cells that have to meet, and pairs of nodes that are linked as a whole.

    ``a, b`` and ``a, b, wa, wb, ra, rb``: weights and representatives. Each step joins
    the pairs that are left with the children of both nodes.
    """
    fields = ["cell", "centre", "radius", "size", "weight", "rep"]
    below = (nodes.filter(F.col("centre").isNotNull()).groupBy(_parent(F.col("cell")).alias("name"))
             .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("kids")))
    own = nodes.filter(F.col("size") <= CELL).select(F.col("cell").alias("name"), F.array(F.struct(*fields)).alias("kids"))
    lists = reliable(below.unionByName(own))
    chord = math.sqrt(2 - 2 * threshold)
    schema = "a string, b string, whole boolean, inner boolean, wa long, wb long, ra long, rb long"

    def step(batches):
        import pyarrow as pa

        for batch in batches:
            sides = [(column.offsets.to_pylist(), column.values) for column in (batch.column("left"), batch.column("right"))]
            radii = [values.field("radius").to_numpy(zero_copy_only=False) for _, values in sides]
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            met, whole = ([np.empty(0, np.int64)], [np.empty(0, np.int64)]), [np.empty(0, bool)]
            for k in range(batch.num_rows):
                (s, e), (u, v) = ((at[k], at[k + 1]) for at, _ in sides)
                x, y = (units(values.field("centre")[at[k]:at[k + 1]].to_pylist(), kind) for at, values in sides)
                apart = np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))
                reach = radii[0][s:e][:, None] + radii[1][u:v][None, :]
                near = apart <= reach + chord + SLACK
                if a[k] == b[k]:
                    near = np.triu(near)
                i, j = np.nonzero(near)
                met[0].append(i + s)
                met[1].append(j + u)
                whole.append((apart + reach <= chord - SLACK)[i, j])
            p, q = (values.take(pa.array(np.concatenate(m))) for (_, values), m in zip(sides, met, strict=True))
            inner = np.maximum(*(m.field("size").to_numpy(zero_copy_only=False) for m in (p, q))) > CELL
            yield pa.RecordBatch.from_arrays(
                [p.field("cell"), q.field("cell"), pa.array(np.concatenate(whole)), pa.array(inner),
                 p.field("weight"), q.field("weight"), p.field("rep"), q.field("rep")],
                ["a", "b", "whole", "inner", "wa", "wb", "ra", "rb"])
    roots = nodes.filter(F.col("centre").isNull())
    ready = roots.filter(F.col("size") <= CELL).select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    whole = None
    front = roots.filter(F.col("size") > CELL).select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    while pairs := front.count():
        met = (front.join(lists.select(F.col("name").alias("a"), F.col("kids").alias("left")), "a")
               .join(lists.select(F.col("name").alias("b"), F.col("kids").alias("right")), "b"))
        met = met.select("a", "b", "left", "right").repartition(math.ceil(pairs / PAIRS))
        met = unsized(met.mapInArrow(step, schema))
        all_linked = met.filter("whole").select("a", "b", "wa", "wb", "ra", "rb")
        whole = all_linked if whole is None else whole.unionByName(all_linked)
        ready = ready.unionByName(met.filter("not whole and not inner").select("a", "b"))
        front = met.filter("not whole and inner").select("a", "b")
    if whole is None:
        whole = ready.limit(0).select("a", "b", *[F.lit(0).cast("long").alias(c) for c in ("wa", "wb", "ra", "rb")])
    return ready, whole


def _trees(cells: DataFrame, kind: str) -> DataFrame:
    """The cover tree of each cell, as one row of arrays."""
    def build(batches):
        import pyarrow as pa

        names = ["points", "weights", "vectors", "nodes", "radii"]
        schema = pa.schema([("cell", pa.string()), *[(n, pa.binary()) for n in names]])

        def row(cell, parts):
            columns = [[v for part in parts for v in part.column(c).to_pylist()] for c in ("p", "n", "vec")]
            return pa.RecordBatch.from_pylist([{"cell": cell, **Side.built(*columns, kind).stored()}], schema)
        now, parts = None, []
        for (cell,), part in _segments(batches, ("cell",)):
            if cell != now and parts:
                yield row(now, parts)
                parts = []
            now = cell
            parts.append(part)
        if parts:
            yield row(now, parts)
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "p")
    return reliable(dealt.mapInArrow(build, "cell string, points binary, weights binary, vectors binary, nodes binary, radii binary"))


def _tiles(pairs: DataFrame, blocks: int) -> DataFrame:
    """What each task gets to make the meetings ``a, b``: ``tile, role, cell, partners``.

    Cells are dealt to blocks, and the meetings between two blocks are a tile. It needs the cells of one
    block (role 0), to hold, and then those of the other (role 1), each with the held cells that it meets.
    """
    numbered = pairs.select("a", "b", *[F.pmod(F.xxhash64(c), F.lit(blocks)).alias(f"of_{c}") for c in ("a", "b")])
    low, high, turned = F.least("of_a", "of_b"), F.greatest("of_a", "of_b"), F.col("of_a") > F.col("of_b")
    dealt = numbered.select((F.floor(high * (high + 1) / 2) + low).alias("tile"),
                            F.when(turned, F.col("b")).otherwise(F.col("a")).alias("held"),
                            F.when(turned, F.col("a")).otherwise(F.col("b")).alias("cell"))
    held = dealt.select("tile", F.lit(0).alias("role"), F.col("held").alias("cell"),
                        F.lit(None).cast("array<string>").alias("partners")).distinct()
    return held.unionByName(dealt.groupBy("tile", "cell").agg(F.collect_list("held").alias("partners"))
                            .select("tile", F.lit(1).alias("role"), "cell", "partners"))


def _met(pairs: DataFrame, trees: DataFrame, kind: str, threshold: float) -> DataFrame:
    """The rows of all meetings: ``what, x, y``.

    A cell's tree is sent once per block of bounded size that it has to meet, not once per cell. There are a
    few tiles a core at least, where there are as many cells.
    """
    stored = trees.agg(F.count(F.lit(1)).alias("cells"), F.sum(sum(
        F.octet_length(c) for c in ("points", "weights", "vectors", "nodes", "radii"))).alias("bytes")).first()
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil((stored["bytes"] or 0) / BLOCK), math.isqrt(2 * TILES * cores))
    blocks = max(1, min(blocks, stored["cells"]))
    tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    # The levels have left many small parts: a tile's share of the pairs is read at once.
    rows = (_tiles(pairs.coalesce(tasks), blocks).join(trees, "cell").repartitionById(tasks, F.pmod("tile", F.lit(tasks)).cast("int"))
            .sortWithinPartitions("tile", "role", "cell"))

    def meet(batches):
        import pyarrow as pa

        schema = pa.schema([("what", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])
        now, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if row["tile"] != now:
                    now, held = row["tile"], {}
                if row["partners"] is None:
                    held[row["cell"]] = Side.read(row, kind)
                    continue
                other = Side.read(row, kind)
                found = [r for name in row["partners"]
                         for r in Meeting(held[name], None if name == row["cell"] else other, threshold).rows()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(
                        zip(*found, strict=True), schema, strict=True)], schema=schema)
    return reliable(rows.mapInArrow(meet, "what int, x long, y long"))


def embedding_links(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Per vector: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows with a cosine of ``threshold`` or more, equal
    vectors included; ``component_id`` is the smallest id that is reachable over links; ``kept`` says
    whether that is the row's own id. Vectors that are null, empty, zero, or hold
    null or non-finite components have no links, nor do vectors of unlike length with
    each other. Rows without an id get the smallest id of their component, null if none
    has one, and are not kept; repeated rows are rows of their own. An empty table gives no rows.
    Threshold: above 0, at most 1.
    """
    keyed, kind = _packed(rows, vector, vec_id)
    alike = keyed.filter(F.col("vec").isNotNull()).groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    # Numbers in the order of the least ids: the smallest number of a component stands for its smallest id.
    ordered = alike.repartitionByRange(F.asc_nulls_last("least"), F.xxhash64("vec")).sortWithinPartitions(
        F.asc_nulls_last("least"), F.xxhash64("vec"))
    points = reliable(ordered.withColumn("p", F.monotonically_increasing_id()))
    cells, nodes = _cells(points, kind)
    cells = reliable(cells)
    pairs, whole = _descended(nodes, kind, threshold)
    found = _met(pairs, _trees(cells, kind), kind, threshold)

    # Nodes that are linked as a whole: what each of their points gains, and a star around a point of theirs.
    apart = F.col("a") != F.col("b")
    gains = whole.select(F.col("a").alias("node"), F.col("ra").alias("rep"), F.col("wb").alias("gain"),
                         F.when(apart, 0).otherwise(1).alias("own")).unionByName(
        whole.filter(apart).select(F.col("b").alias("node"), F.col("rb").alias("rep"), F.col("wa").alias("gain"),
                                   F.lit(0).alias("own")))
    gains = reliable(gains.groupBy("node").agg(F.min("rep").alias("rep"), F.sum("gain").alias("gain"),
                                               F.max("own").alias("own")))
    steps = F.split("cell", r"\.")
    paths = cells.select("p", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "."))).alias("node"))
    gained = reliable(paths.join(_sent(gains), "node").select("p", "rep", (F.col("gain") - F.col("own") * F.col("n")).alias("more")))
    counts = found.filter("what = 0").select(F.col("x").alias("p"), F.col("y").alias("more")).unionByName(
        gained.select("p", "more")).groupBy("p").agg(F.sum("more").alias("more"))
    edges = found.filter("what = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(
        gained.select(F.col("p").alias("a"), F.col("rep").alias("b"))).unionByName(
        whole.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    groups = components(reliable(edges.filter("a <> b")))

    heads = points.select(F.col("p").alias("component"), F.col("least").alias("component_id"))
    named = groups.join(heads, "component").select(F.col("node").alias("p"), "component_id")
    told = points.join(counts, "p", "left").join(named, "p", "left").select(
        "vec", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"))
    out = keyed.join(told, "vec", "left")
    component = F.when(F.col("vec").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
