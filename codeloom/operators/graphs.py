"""Breadth-first levels and connected components by iterated joins with cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.plans.durable import forget, persist_table


def bfs_levels(edges: DataFrame, start: DataFrame, most: int = 1000) -> DataFrame:
    """(node, level) of all nodes that ``start`` (node) reaches over directed (src, dst) edges."""
    frontier = persist_table(start.distinct().withColumn("level", F.lit(0).cast("long")), "bfs")
    seen = frontier
    for level in range(1, most + 1):
        reached = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        before = frontier, seen
        frontier = persist_table(reached.join(seen, "node", "left_anti").withColumn("level", F.lit(level).cast("long")), "bfs")
        if frontier.isEmpty():
            return seen
        seen = persist_table(seen.unionByName(frontier), "bfs-seen")
        forget(*before)
    raise ValueError(f"more than {most} levels")


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component): the least node that each node is connected to.

    Labels of neighbours spread and label chains are halved in every round, so rounds grow
    with the logarithm of a component's diameter.
    """
    both = persist_table(
        edges.select("src", "dst").where("src <> dst").union(edges.select("dst", "src").where("src <> dst")).distinct(), "edges"
    )
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = last = persist_table(nodes.withColumn("label", F.col("node")), "labels")
    for _ in range(most):
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        new = persist_table(spread.join(jump, "next").select("node", F.least("next", "further").alias("label"), F.col("label").alias("old")), "labels")
        forget(last)
        if new.where("label <> old").isEmpty():
            forget(both)
            return new.select("node", F.col("label").alias("component"))
        labels, last = new.select("node", "label"), new
    raise ValueError(f"no fixed point after {most} rounds")


def shortest_paths(edges: DataFrame, start: DataFrame, most: int = 1000) -> DataFrame:
    """(node, distance) of all nodes that ``start`` (node) reaches over (src, dst, weight) edges of weights >= 0.

    Rounds of relaxation: only nodes whose distance fell in the last round send on, and distances
    are kept in tables with their lineage cut.
    """
    best = persist_table(start.distinct().withColumn("distance", F.lit(0.0)), "paths")
    changed = last = best
    for _ in range(most):
        offers = changed.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.col("distance") + F.col("weight")).alias("offer"))
        both = best.join(offers, F.col("node") == F.col("dst"), "full")
        fell = F.coalesce(F.col("offer") < F.col("distance"), F.col("distance").isNull())
        new = persist_table(both.select(F.coalesce("node", "dst").alias("node"), F.least("distance", "offer").alias("distance"), fell.alias("fell")), "paths")
        forget(last)
        best, changed, last = new.select("node", "distance"), new.where("fell").select("node", "distance"), new
        if changed.isEmpty():
            return best
    raise ValueError(f"no fixed point after {most} rounds")


def islands(cells: DataFrame) -> DataFrame:
    """(component, n) of the cells (x, y) that touch side by side."""
    name = lambda x, y: F.concat_ws(",", x.cast("string"), y.cast("string"))
    own = cells.select("x", "y").distinct()
    near = own.select("x", "y", F.explode(F.array(F.struct((F.col("x") + 1).alias("u"), F.col("y").alias("v")), F.struct(F.col("x").alias("u"), (F.col("y") + 1).alias("v")))).alias("o"))
    edges = near.select(name(F.col("x"), F.col("y")).alias("src"), F.col("o.u").alias("x"), F.col("o.v").alias("y")).join(own, ["x", "y"])
    edges = edges.select("src", name(F.col("x"), F.col("y")).alias("dst"))
    alone = own.select(name(F.col("x"), F.col("y")).alias("src"), name(F.col("x"), F.col("y")).alias("dst"))
    return components(edges.unionByName(alone)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
