"""Connected components of a graph given by its edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm._common import cut, drop_cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node of the component.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest of them; the rounds, few
    in number, end when the edges no longer change. They are written after each half, so nothing is computed twice
    and a lost executor costs one half at most. Smallest neighbours are pre-aggregated, and the join that follows
    reads them from a table of their own, so that Spark can broadcast them if small and split hot nodes if not.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = cut(both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        smallest = cut(large.groupBy("a").agg(F.min("b").alias("m")), "smallest")
        hung = large.join(smallest, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        small = cut(hung.union(smallest.select("a", F.col("m").alias("b"))).distinct(), "small")
        for old in (edges, least, large, smallest):
            drop_cut(old)
        edges, after = small, _mark(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
