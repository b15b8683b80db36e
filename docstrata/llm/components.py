"""Connected components of an edge table, by rounds of hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, discard, sized


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of the nodes in edges (a, b bigint, none null).

    In each round a root hooks to its smallest neighbour, chains of hooks are shortened by jumping, and
    the edges are contracted; every round at least halves the roots that still have neighbours. Only
    joins and pre-aggregated groups are used, so a node with very many edges is no bottleneck. Tables that
    contraction has made small enough by their counted bytes are broadcast. Tables of earlier rounds are deleted."""
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = cut(nodes.withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(hooks.join(sized(up, "merge"), "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")))
            done = jumped.where("moved").isEmpty()
            discard(hooks)
            hooks = jumped.drop("moved")
            hooks.written_to = jumped.written_to
            if done:
                break
        to = hooks.withColumnRenamed("node", "component")
        after = cut(labels.join(sized(to, "merge"), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        a, b = hooks.toDF("a", "x"), hooks.toDF("b", "y")
        left = cut(edges.join(sized(a, "merge"), "a").join(sized(b, "merge"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
        discard(labels, edges, hooks)
        labels, edges = after, left
    discard(edges)
    return labels


def extend_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """node, component as connected_components gives them, after links (a, b) are added to those of known (node,
    component), a written table. Only links between different components are walked again; nodes that known
    lacks may occur in links."""
    a, b = known.toDF("a", "x"), known.toDF("b", "y")
    between = links.join(sized(a, "merge"), "a", "left").join(sized(b, "merge"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    over = connected_components(between)
    if over.isEmpty():
        return known
    moved = known.join(sized(over.toDF("component", "to"), "merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = over.join(sized(known.select("node"), "merge"), "node", "left_anti")
    return cut(moved.unionByName(new))
