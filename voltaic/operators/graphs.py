"""Graphs of any size as tables of edges: components by contraction, longest paths by levels. Every round is written, so a lost executor costs one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.operators import steps


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of undirected edges (a, b): root is the smallest node of the component.

    In each round every node that has a smaller neighbour hangs on its smallest; chains are shortened by following two
    links at a time, and edges are contracted to what remains. Each edge has a node that hangs, so at least half of a
    component's nodes go in a round.
    """
    undirected = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    known = steps.cut(undirected.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    left = steps.cut(undirected.filter("a <> b").distinct())
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = steps.cut(both.groupBy("a").agg(F.min("b").alias("b")).filter("b < a"))
        while True:
            further = hung.alias("x").join(hung.alias("y"), F.col("x.b") == F.col("y.a"), "left")
            longer = steps.cut(further.select("x.a", F.coalesce("y.b", "x.b").alias("b"), F.col("y.b").isNotNull().alias("moved")))
            hung = longer.select("a", "b")
            if longer.filter("moved").isEmpty():
                break
        to = lambda c: hung.select(F.col("a").alias(c), F.col("b").alias(f"new_{c}"))
        known = steps.cut(known.join(to("root"), "root", "left").select("node", F.coalesce("new_root", "root").alias("root")))
        moved = left.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"))
        left = steps.cut(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    least = known.groupBy("root").agg(F.min("node").alias("least"))
    return known.join(least, "root").select("node", F.col("least").alias("root"))


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth) of the nodes of directed edges (a, b): the number of edges of the longest path that ends there, null
    for what lies on a cycle or behind one, as no path there is longest.

    Level by level: a node whose predecessors all have their depth gets one more than the deepest of them. What is left
    when no node is ready lies on or behind a cycle. One round a level.
    """
    edges = steps.cut(edges.select("a", "b").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    waiting = steps.cut(edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("open")))
    found = steps.cut(nodes.join(waiting, "node", "left_anti").withColumn("depth", F.lit(0)))
    parts, level = [found], 0
    while not found.isEmpty():
        level += 1
        done = edges.join(found.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("met"))
        now = steps.cut(waiting.join(done, "node", "left").select("node", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")))
        found = steps.cut(now.filter("open = 0").select("node").withColumn("depth", F.lit(level)))
        waiting = steps.cut(now.filter("open > 0"))
        parts.append(found)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.union(waiting.select("node", F.lit(None).cast("int").alias("depth")))
