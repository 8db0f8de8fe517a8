"""Traversal, paths, closures and ranking over edge DataFrames (s, t, rel, conf)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.files import cut_lineage


def undirected(edges: DataFrame) -> DataFrame:
    """Edges in both directions."""
    return edges.unionByName(edges.withColumns({"s": F.col("t"), "t": F.col("s")}))


def traverse(edges: DataFrame, seeds: DataFrame, hops: int, least: float = 0.0, relations: Sequence[str] | None = None) -> DataFrame:
    """(s, t, rel, conf, hop): edges reached from ``seeds`` (column node) within ``hops`` steps, each with its least hop.

    One join a step; the frontier holds distinct nodes only and never the seeds again. Edges
    and frontiers are checkpointed, so that no step repeats the ones before it.
    """
    edges = edges.where(F.col("conf") >= least)
    if relations is not None:
        edges = edges.where(F.col("rel").isin(*relations))
    edges = cut_lineage(edges.select("s", "t", "rel", "conf"))
    frontier, found = seeds.select("node").distinct(), None
    for hop in range(1, hops + 1):
        step = edges.join(frontier.withColumnRenamed("node", "s"), "s", "left_semi").withColumn("hop", F.lit(hop))
        found = step if found is None else found.unionByName(step)
        if hop < hops:
            frontier = cut_lineage(step.select(F.col("t").alias("node")).distinct().join(seeds, "node", "left_anti"))
    return found.groupBy("s", "t", "rel").agg(F.max("conf").alias("conf"), F.min("hop").alias("hop"))


def typed_path(edges: DataFrame, starts: DataFrame, chain: Sequence[str]) -> DataFrame:
    """(start, node) pairs joined by edges whose relations are ``chain`` in order, with the number of such paths."""
    now = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("paths", F.lit(1).cast("long"))
    for rel in chain:
        step = edges.where(F.col("rel") == rel).select(F.col("s").alias("node"), F.col("t").alias("next")).distinct()
        now = now.join(step, "node").groupBy("start", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
    return now


def closure(parents: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, distance) over a child-parent table (node, parent) of up to ``depth`` levels, by doubling; each round is checkpointed."""
    now = cut_lineage(parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    reach = 1
    while reach < depth:
        up = now.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("a2"), F.col("distance").alias("d2"))
        longer = now.join(up, "ancestor").select("node", F.col("a2").alias("ancestor"), (F.col("distance") + F.col("d2")).alias("distance"))
        now = cut_lineage(now.union(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        reach *= 2
    return now.where(F.col("distance") <= depth)


def edge_rank(relevance: Column, conf: Column, hop: Column) -> Column:
    """0.6 relevance, 0.2 confidence and 0.2 of 0.7 to the power of the hop."""
    return 0.6 * relevance + 0.2 * conf + 0.2 * F.pow(F.lit(0.7), hop)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree), counted in one grouping."""
    ends = edges.select(F.col("s").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("t", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def cooccurrence_star(members: DataFrame, group: str, item: str, center: object, most: int) -> DataFrame:
    """(item, together, size): what shares groups with ``center``, most often first; size is 10 and one for each, 18 at most."""
    pairs = members.select(group, item).distinct()
    mine = pairs.where(F.col(item) == center).select(group)
    counts = pairs.where(F.col(item) != center).join(mine, group).groupBy(item).agg(F.count("*").alias("together"))
    return counts.withColumn("size", F.least(F.lit(10) + F.col("together"), F.lit(18))).orderBy(F.desc("together"), item).limit(most)


def resolve(names: DataFrame, asked: str) -> DataFrame:
    """The best match of a name (columns node, aliases, first_seen): same, alias, word at an end, large part, inside the question, part of an alias."""
    q = asked.lower()
    node = F.lower("node")
    share = F.least(F.length(node), F.lit(len(q))) / F.greatest(F.length(node), F.lit(len(q)))
    alias = F.transform("aliases", lambda a: F.lower(a))
    rank = (
        F.when(node == q, 0).when(F.array_contains(alias, q), 1).when(node.startswith(q + " ") | node.endswith(" " + q), 2)
        .when((node.contains(q) | F.lit(q).contains(node)) & (share > 0.3), 3).when(F.lit(q).contains(node), 4)
        .when(F.exists(alias, lambda a: a.contains(q)), 5)
    )
    return names.withColumn("tier", rank).where("tier IS NOT NULL").orderBy("tier", "first_seen").limit(1).select("node", "tier")


def sequence_edges(steps: DataFrame, group: str, order: str, node: str) -> DataFrame:
    """(s, t): neighbouring steps of each group."""
    nxt = F.lead(node).over(Window.partitionBy(group).orderBy(order))
    return steps.select(F.col(node).alias("s"), nxt.alias("t")).where("t IS NOT NULL").distinct()


def nodes_of(relations: DataFrame) -> DataFrame:
    """(node, mentions, relations): every end of a relation with how often and in which relations it occurs."""
    ends = relations.select(F.col("s").alias("node"), "rel").union(relations.select("t", "rel"))
    return ends.groupBy("node").agg(F.count("*").alias("mentions"), F.array_sort(F.collect_set("rel")).alias("relations"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the ends of edges (s, t): the least node that can be reached.

    In each round a node takes the least name of its neighbours, and then the name that
    this name has, so names travel twice as far each time. All steps are grouped minima and
    equi-joins, and each round is checkpointed.
    """
    both = cut_lineage(undirected(edges.select("s", "t")).distinct())
    names = cut_lineage(both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("t"), F.col("node")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(names.select(F.col("node").alias("t"), "component"), "t").groupBy(F.col("s").alias("node")).agg(F.min("component").alias("near"))
        best = names.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = names.select(F.col("node").alias("component"), F.col("component").alias("far"))
        now = cut_lineage(best.join(jump, "component").select("node", F.least("component", "far").alias("component"), "old"))
        names = now.select("node", "component")
        if now.where("component <> old").isEmpty():
            return names
    raise RuntimeError(f"components are not stable after {most_rounds} rounds")


def display_graph(edges: DataFrame, kind: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as (id, data) with JSON for a graph view: nodes with label, kind and degree, edges with source, target and relation."""
    ends = edges.select(F.col("s").alias("node")).union(edges.select("t")).groupBy("node").agg(F.count("*").alias("degree"))
    nodes = ends.select(F.col("node").alias("id"), F.to_json(F.struct(F.col("node").alias("id"), F.col("node").alias("label"), kind.alias("type"), "degree")).alias("data"))
    name = F.concat_ws("-", "s", "rel", "t")
    lines = edges.select(name.alias("id"), F.to_json(F.struct(name.alias("id"), F.col("s").alias("source"), F.col("t").alias("target"), F.col("rel").alias("label"))).alias("data"))
    return nodes, lines
