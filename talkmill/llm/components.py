"""Connected components of an edge table, by repeated contraction on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import hot_keys, join_split, materialise, shuffled


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) longs. Returns (node, component); component is the smallest node.

    Every round sends each vertex to its smallest neighbour (or itself), follows
    that pointer once more, and contracts the edges. The smallest vertex of a
    component always stays, so it names the component in the end. Self loops,
    repeated edges, either direction and an empty table are fine.
    """
    left = materialise(_normal(edges), "edges")
    mapping = None
    while edges_left := left.count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p"), F.count("*").alias("n")).withColumn("p", F.least("node", "p"))
        parent = materialise(parent, "parents")
        # Hubs, such as the leaders of large groups, have very many edges and children.
        hubs = hot_keys(parent.select(F.col("node").alias("key"), "n"), 2 * edges_left)
        above = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        jump = materialise(join_split(parent.select("node", "p"), above, "p", "node", hubs).select("node", F.col("pp").alias("component")), "jumps")
        if mapping is None:
            mapping = jump
        else:
            step = jump.select(F.col("node").alias("component"), F.col("component").alias("next"))
            mapping = materialise(mapping.join(shuffled(step), "component", "left").select("node", F.coalesce("next", "component").alias("component")), "mapping")
        to_a = jump.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        to_b = jump.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        left = materialise(_normal(join_split(join_split(left, to_a, "a", "b", hubs), to_b, "b", "a", hubs).select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "edges")
    if mapping is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping


def _normal(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
