"""Connected components by alternating stars, with joins only; no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.skew import salted_join
from tickloom.session import cut_lineage


def _star(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v), u > v: every u's smaller neighbours and u itself hang on its smallest neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    both = salted_join(edges, least, "u", "degree", total, "inner")
    return both.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u hangs on the smallest of u and its neighbours."""
    turned = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = turned.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count("*").alias("degree"))
    moved = salted_join(turned.where("v > u"), least, "u", "degree", 2 * total, "inner")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node. Input columns u and v, long.

    A node with many neighbours, such as the centre of a large star, is salted in every join.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = cut_lineage(edges), None
    total = edges.count()
    while True:
        edges = cut_lineage(_large_star(edges, total))
        edges = cut_lineage(_star(edges, total))
        # a star forest maps onto itself; the sum of hashes tells two edge sets apart
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, total = state, state[0]
    hubs = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs.select("node", F.col("node").alias("component")))
