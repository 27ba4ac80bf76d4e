"""Adjacency graphs: neighbour expansion, weights and edge clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relations import checkpointer


def undirected(edges: DataFrame) -> DataFrame:
    """One edge for each pair, ends in order; the least weight where both directions differ."""
    ends = edges.withColumns({"a": F.least("from", "to"), "b": F.greatest("from", "to")}).where(F.col("a") != F.col("b"))
    return ends.groupBy("a", "b").agg(F.min("weight").alias("weight")).select(F.col("a").alias("from"), F.col("b").alias("to"), "weight")


def spatial_graph(
    relations: DataFrame, nodes: DataFrame, compute: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], keep: Callable[[Callable[[str], Column]], Column] | None = None
) -> DataFrame:
    """Weighted edges between all nodes that meet. ``compute(a, b)`` and ``keep(node)`` get functions
    from a column's name to its expression for either end."""
    keep = keep or (lambda node: F.lit(True))
    kept = nodes.where(keep(F.col))
    a = kept.select(*[F.col(c).alias(f"a_{c}") for c in nodes.columns])
    b = kept.select(*[F.col(c).alias(f"b_{c}") for c in nodes.columns])
    meets = relations.where(F.col("relation") == "SPATIAL_MEETS").select(F.col("subject").alias("a_object_id"), F.col("object").alias("b_object_id"))
    weight = compute(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    joined = meets.join(a, "a_object_id").join(b, "b_object_id")
    return undirected(joined.select(F.col("a_object_id").alias("from"), F.col("b_object_id").alias("to"), weight.alias("weight")))


def reachable(edges: DataFrame, start: DataFrame, max_hops: int = 1) -> DataFrame:
    """``node, hops``: what a breadth-first search from all rows of ``start`` (node) finds within
    max_hops. Each round joins only the nodes found last and is checkpointed."""
    keep = checkpointer(edges.sparkSession)
    both = edges.select("from", "to").unionByName(edges.select(F.col("to").alias("from"), F.col("from").alias("to"))).distinct()
    seen = keep(start.select("node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, max_hops + 1):
        found = both.join(front.select(F.col("node").alias("from")), "from").select(F.col("to").alias("node")).distinct()
        front = keep(found.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def neighbourhood(edges: DataFrame, start: DataFrame, max_hops: int = 1) -> DataFrame:
    """Edges among the nodes within max_hops that touch a node nearer than max_hops."""
    near = reachable(edges, start, max_hops)
    a = near.select(F.col("node").alias("from"), F.col("hops").alias("_a"))
    b = near.select(F.col("node").alias("to"), F.col("hops").alias("_b"))
    return edges.join(a, "from").join(b, "to").where(F.least("_a", "_b") < max_hops).select("from", "to", "weight")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest by Boruvka's rounds: each component takes its lightest outgoing edge
    (ties by ends), then components merge, until no edge leads out of one. Components at least halve in every round."""
    keep = checkpointer(edges.sparkSession)
    edges = keep(undirected(edges))
    label = keep(edges.select(F.col("from").alias("node")).unionByName(edges.select(F.col("to").alias("node"))).distinct().withColumn("part", F.col("node")))
    chosen = None
    while True:
        a = label.select(F.col("node").alias("from"), F.col("part").alias("pa"))
        b = label.select(F.col("node").alias("to"), F.col("part").alias("pb"))
        crossing = edges.join(a, "from").join(b, "to").where(F.col("pa") != F.col("pb"))
        ends = crossing.select("pa", "pb", "weight", "from", "to").unionByName(crossing.select(F.col("pb").alias("pa"), F.col("pa").alias("pb"), "weight", "from", "to"))
        lightest = keep(ends.groupBy("pa").agg(F.min(F.struct("weight", "from", "to", "pb")).alias("e")).select("pa", "e.*"))
        if lightest.isEmpty():
            break
        own = lightest.select("from", "to", "weight").distinct()
        chosen = keep(own if chosen is None else chosen.unionByName(own).distinct())
        root = component_labels(lightest.select(F.col("pa").alias("from"), F.col("pb").alias("to")), keep)
        label = keep(label.join(root, label["part"] == root["node_"], "left").select("node", F.coalesce("least", "part").alias("part")))
    return edges.limit(0) if chosen is None else chosen


def component_labels(edges: DataFrame, keep) -> DataFrame:
    """``node_, least``: the least node of each component, by passing the least along edges and
    jumping to the label's label, until nothing changes."""
    both = keep(edges.unionByName(edges.select(F.col("to").alias("from"), F.col("from").alias("to"))).distinct())
    label = keep(both.groupBy(F.col("from").alias("node_")).agg(F.least(F.min("to"), F.first("from")).alias("least")))
    while True:
        near = both.join(label, both["to"] == label["node_"]).groupBy(F.col("from").alias("n")).agg(F.min("least").alias("m"))
        jump = label.select(F.col("node_").alias("j"), F.col("least").alias("jl"))
        moved = label.join(near, label["node_"] == near["n"], "left").join(jump, label["least"] == jump["j"], "left")
        new = keep(moved.select("node_", F.least("least", "m", "jl").alias("least"), F.col("least").alias("_old")))
        done = new.where(F.col("least") != F.col("_old")).isEmpty()
        label = new.drop("_old")
        if done:
            return label


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Edges of each node by weight, lightest first."""
    w = Window.partitionBy("from").orderBy("weight", "to")
    return edges.withColumn("rank", F.row_number().over(w))
