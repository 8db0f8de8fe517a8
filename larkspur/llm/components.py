"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); a component is named by its least node.

    Large-star and small-star steps take turns until the edges are stars around the least
    nodes, which takes about as many rounds as the logarithm of the longest path. Every step
    is a grouped minimum and an equi-join on the node, so Spark can split a node with many
    neighbours; nothing is collected. Each round is checkpointed. Edges with a null end are
    dropped and edges from a node to itself only name the node.
    """
    edges = cut_lineage(edges.select("u", "v").dropna().distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    state = None
    for _ in range(max_rounds):
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if (found["n"], found["h"]) == state or not found["n"]:
            break
        state = (found["n"], found["h"])
        both = now.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(now.select("lo", "hi"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x AND y <> m").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut_lineage(small.union(least).distinct())
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    return nodes.join(now.select(F.col("hi").alias("node"), F.col("lo").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
