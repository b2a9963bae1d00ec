"""Connected components of a graph of links, by rounds of hooking and contraction over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkplane.llm.common import stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of links(a, b), longs; all nodes of a component, and only they, share a root.

    Each round hooks every node to the neighbour, or itself, that a hash puts first, follows the hooks a few steps, and
    replaces the links by links between where the hooks lead. As the order is that of a hash, chains of hooks are
    short whatever the graph, and the links left shrink by a constant factor. Each round ends in written tables, so a
    lost executor costs one round at most. Links that are null or loops are ignored; no links give no rows.
    """
    edges = stored(links.select("a", "b").filter("a != b").distinct(), f"{name}-links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = stored(nodes.withColumn("root", F.col("node")), f"{name}-roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        first = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("v"))
        hooks = both.groupBy("a").agg(F.min(first(F.col("b"))).alias("near")).select(F.col("a").alias("node"), F.least("near", first(F.col("a")))["v"].alias("up"))
        hooks = stored(hooks, f"{name}-hooks")
        for _ in range(2):
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("over"))
            hooks = stored(hooks.join(above, "up").select("node", F.col("over").alias("up")), f"{name}-hooks")
        roots = stored(roots.join(hooks, roots["root"] == hooks["node"], "left").select(roots["node"], F.coalesce("up", "root").alias("root")), f"{name}-roots")
        at_a, at_b = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua")), hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = edges.join(at_a, "a").join(at_b, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).filter("a != b").distinct()
        edges = stored(edges, f"{name}-links")
    return roots
