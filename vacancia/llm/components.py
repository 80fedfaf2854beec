"""Connected components of an edge table that may hold very popular nodes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.session import reliable

#: Alternations after which a graph that has not settled is reported as an error.
MAX_ROUNDS = 60


def _arrows(edges: DataFrame) -> DataFrame:
    """Every undirected edge as (larger, smaller), once."""
    return (edges.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: the neighbours of each node are linked to its smallest one.

    The large form moves a node's larger neighbours, the small form its smaller
    ones. The minimum per node is an aggregate that is folded map-side, and the
    join that brings it to the node's edges can be split by the optimiser, so no
    task gets all edges of a popular node.
    """
    near = edges.select("a", "b")
    if large:
        near = near.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = near.join(least, "a")
    if large:
        moved = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return _arrows(moved)
    own = least.select("a", F.col("m").alias("b"))
    return _arrows(moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (columns a, b: comparable ids).

    The component is its smallest node. Alternating large and small stars
    (Kiveris et al., 2014) until the edge set is a set of stars, which is seen
    from the count and an order-free hash; each round is checkpointed, so a lost
    executor costs a round at most. Self-loops, repeated and reversed edges are
    allowed; an empty table has no nodes.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = reliable(_arrows(edges))
    last = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == last or mark[0] == 0:
            break
        last = tuple(mark)
        now = reliable(_star(_star(now, large=True), large=False))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return (nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))
