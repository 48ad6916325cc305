"""Connected components of an edge table in logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def flattened(up: DataFrame) -> DataFrame:
    """(node, to) where to is the root of node's tree, from a forest (node, to) in which roots point to themselves.

    Pointer jumping: each step makes every node point to where its target points, which halves all depths.
    """
    while True:
        far = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = stored(up.join(far, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        up = step.select("node", "to")
        if step.filter("moved").isEmpty():
            return up


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) with an edge to another node: root is the same, and a node, within a component only.

    In each round nodes point to their smallest neighbour, or themselves, and are renamed to the root of the tree that
    this makes; edges follow, and those within one name vanish. A name that stays takes in another one at least every other
    round, so rounds grow with the logarithm of a component's size; a chain of rising nodes is one tree, however long,
    and is flat after as many jumps as its length has bits. Only whether rows are left comes to the driver; all that is
    used twice is written to the shared folder. Null nodes have no edges; repeated edges and loops change nothing.
    """
    edges = stored(edges.filter("a <> b").select("a", "b").distinct())
    names = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = flattened(stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node")))
        if names is None:
            names = to.withColumnRenamed("to", "root")
        else:
            names = stored(names.join(to.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        x, y = to.toDF("a", "x"), to.toDF("b", "y")
        moved = edges.join(x, "a").join(y, "b").filter("x <> y")
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return names if names is not None else edges.toDF("node", "root")
