"""Queries of graph operators, on edges between suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import graph as ops
from larkspur.operators import relational, retrieval
from larkspur.plans.registry import query, table

_E = """e AS (SELECT 'S' || l_suppkey AS s, 'P' || l_partkey AS t, l_returnflag AS rel, max(l_discount) * 10 AS conf FROM lineitem GROUP BY 1, 2, 3
    UNION ALL SELECT 'P' || l_partkey, 'S' || l_suppkey, l_linestatus, max(l_tax) * 12 FROM lineitem GROUP BY 1, 2, 3)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part by return flag, part to supplier by line status, from all lines."""
    lines = table(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey")
    out = lines.groupBy(s.alias("s"), p.alias("t"), F.col("l_returnflag").alias("rel")).agg((F.max("l_discount") * 10).alias("conf"))
    back = lines.groupBy(p.alias("s"), s.alias("t"), F.col("l_linestatus").alias("rel")).agg((F.max("l_tax") * 12).alias("conf"))
    return out.unionByName(back)


def seeds(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


_HOPS = f"""
    WITH {_E}, g AS (SELECT * FROM e WHERE conf >= 0.5), h1 AS (SELECT *, 1 AS hop FROM g WHERE s IN ('S1', 'S2')),
    h2 AS (SELECT *, 2 AS hop FROM g WHERE s IN (SELECT t FROM h1) AND s NOT IN ('S1', 'S2')), h3 AS (SELECT *, 3 AS hop FROM g WHERE s IN (SELECT t FROM h2) AND s NOT IN ('S1', 'S2'))"""


@query(f"{_HOPS} SELECT s, t, rel, max(conf) AS conf, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1, 2, 3")
def khop_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.traverse(edges(spark, sf_dir), seeds(spark, "S1", "S2"), 3, 0.5)


@query(f"""
    WITH {_E}, g AS (SELECT s, t, rel, conf FROM e WHERE rel IN ('R', 'F')), u AS (SELECT * FROM g UNION ALL SELECT t, s, rel, conf FROM g), h1 AS (SELECT *, 1 AS hop FROM u WHERE s = 'P7'),
    h2 AS (SELECT *, 2 AS hop FROM u WHERE s IN (SELECT t FROM h1) AND s <> 'P7')
    SELECT s, t, rel, max(conf) AS conf, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2, 3""")
def entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.traverse(ops.undirected(edges(spark, sf_dir)), seeds(spark, "P7"), 2, 0.0, ["R", "F"])


@query(f"""
    WITH {_E}, a AS (SELECT DISTINCT s, t FROM e WHERE rel = 'R'), b AS (SELECT DISTINCT s, t FROM e WHERE rel = 'O'), c AS (SELECT DISTINCT s, t FROM e WHERE rel = 'N')
    SELECT a.s AS start, c.t AS node, count(*) AS paths FROM a JOIN b ON b.s = a.t JOIN c ON c.s = b.t WHERE a.s IN ('S1', 'S2', 'S3') GROUP BY 1, 2""")
def typed_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.typed_path(edges(spark, sf_dir), seeds(spark, "S1", "S2", "S3"), ["R", "O", "N"])


_TREE = """p AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
    UNION ALL SELECT 'r' || r_regionkey, NULL FROM region)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as (node, parent)."""
    node = lambda prefix, c: F.concat(F.lit(prefix), c)
    n = table(spark, sf_dir, "nation").select(node("n", "n_nationkey").alias("node"), node("r", "n_regionkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(node("c", "c_custkey"), node("n", "c_nationkey"))
    o = table(spark, sf_dir, "orders").select(node("o", "o_orderkey"), node("c", "o_custkey"))
    r = table(spark, sf_dir, "region").select(node("r", "r_regionkey"), F.lit(None).cast("string"))
    return n.union(c).union(o).union(r)


@query(f"""
    WITH RECURSIVE {_TREE}, a AS (SELECT node, parent AS ancestor, 1 AS distance FROM p WHERE parent IS NOT NULL UNION ALL SELECT a.node, p.parent, distance + 1 FROM a JOIN p ON p.node = a.ancestor WHERE p.parent IS NOT NULL)
    SELECT node, ancestor, distance FROM a""")
def taxonomy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.closure(tree(spark, sf_dir), 4)


@query(f"""
    WITH RECURSIVE {_TREE}, d AS (SELECT node, 0 AS depth FROM p WHERE node = 'r1' UNION ALL SELECT p.node, depth + 1 FROM p JOIN d ON p.parent = d.node) SELECT node, depth FROM d""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = ops.closure(tree(spark, sf_dir), 4).where("ancestor = 'r1'").select("node", F.col("distance").alias("depth"))
    return down.union(seeds(spark, "r1").select("node", F.lit(0)))


@query(f"WITH {_TREE} SELECT parent, count(*) AS children, list_sort(list(node)) AS nodes FROM p WHERE parent LIKE 'r%' GROUP BY 1")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir).where(F.col("parent").startswith("r")).groupBy("parent")
    return t.agg(F.count("*").alias("children"), F.array_sort(F.collect_list("node")).alias("nodes"))


@query(f"""
    {_HOPS}, a AS (SELECT s, t, rel, max(conf) AS conf, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2, 3),
    r AS (SELECT *, (CAST(substr(t, 2) AS INTEGER) % 10) / 10.0::DOUBLE AS relevance FROM a)
    SELECT s, t, rel, round(0.6::DOUBLE * relevance + 0.2::DOUBLE * conf + 0.2::DOUBLE * pow(0.7::DOUBLE, hop), 6) AS score FROM r WHERE relevance >= 0.3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 10""")
def edge_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.traverse(edges(spark, sf_dir), seeds(spark, "S1", "S2"), 2, 0.5)
    found = found.withColumn("relevance", (F.substring("t", 2, 9).cast("int") % 10) / 10.0).where("relevance >= 0.3")
    score = F.round(ops.edge_rank(F.col("relevance"), F.col("conf"), F.col("hop")), 6)
    return found.select("s", "t", "rel", score.alias("score")).orderBy(F.desc("score"), "s", "t", "rel").limit(10)


@query(f"WITH {_E}, d AS (SELECT s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM d GROUP BY 1")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.degrees(edges(spark, sf_dir))


@query("""
    WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), c AS (SELECT b.l_suppkey, count(*) AS together FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey WHERE a.l_suppkey = 5 AND b.l_suppkey <> 5 GROUP BY 1)
    SELECT l_suppkey, together, least(10 + together, 18) AS size FROM c ORDER BY together DESC, l_suppkey LIMIT 20""")
def cooccurrence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cooccurrence_star(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 5, 20)


@query(f"WITH {_E}, n AS (SELECT s AS node, rel FROM e UNION ALL SELECT t, rel FROM e) SELECT node, count(*) AS mentions, list_sort(list(DISTINCT rel)) AS relations FROM n GROUP BY 1")
def relation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.nodes_of(edges(spark, sf_dir))


@query("""
    SELECT DISTINCT s, t FROM (SELECT p_type AS s, lead(p_type) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE t IS NOT NULL""")
def sequence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return ops.sequence_edges(lines.withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), "l_orderkey", "at", "p_type")


@query(f"WITH {_E} SELECT CASE WHEN s = 'S3' THEN 'out' ELSE 'in' END AS direction, CASE WHEN s = 'S3' THEN t ELSE s END AS neighbour, rel, conf FROM e WHERE s = 'S3' OR t = 'S3'")
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("s") == "S3"
    e = edges(spark, sf_dir).where(out | (F.col("t") == "S3"))
    return e.select(F.when(out, "out").otherwise("in").alias("direction"), F.when(out, F.col("t")).otherwise(F.col("s")).alias("neighbour"), "rel", "conf")


@query(f"WITH {_E} SELECT rel, count(*) AS n, round(avg(conf), 8) AS mean FROM e GROUP BY 1")
def relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("rel").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 8).alias("mean"))


@query("SELECT node, tier FROM (SELECT p_name AS node, CASE WHEN lower(p_name) = 'gear' THEN 0 WHEN starts_with(lower(p_name), 'gear ') OR ends_with(lower(p_name), ' gear') THEN 2 END AS tier FROM part GROUP BY 1, 2) WHERE tier IS NOT NULL ORDER BY tier, node LIMIT 1")
def resolve_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("node")).agg(F.min("p_name").alias("first_seen"))
    return ops.resolve(names.withColumn("aliases", F.array().cast("array<string>")), "gear")


@query(f"""
    WITH {_E}, n AS (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM e UNION ALL SELECT t FROM e) GROUP BY 1)
    SELECT node AS id, '{{"id":"' || node || '","label":"' || node || '","type":"' || substr(node, 1, 1) || '","degree":' || degree || '}}' AS data FROM n
    UNION ALL SELECT s || '-' || rel || '-' || t, '{{"id":"' || s || '-' || rel || '-' || t || '","source":"' || s || '","target":"' || t || '","label":"' || rel || '"}}' FROM e""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, lines = ops.display_graph(edges(spark, sf_dir), F.substring("node", 1, 1))
    return nodes.union(lines)


@query()
def diverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen diverse edges of each supplier's fifty most certain ones; parts have the vectors of their numbers."""
    e = edges(spark, sf_dir).where(F.col("s").startswith("S"))
    near = relational.top_per_key(e, ["s"], [F.desc("conf"), F.col("t"), F.col("rel")], 50, "place")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    size = vectors.count()
    met = near.withColumn("_v", F.substring("t", 2, 9).cast("long") % size).join(vectors, "_v")
    return retrieval.diverse_edges(met.withColumn("score", ops.edge_rank((F.col("_v") % 10) / 10.0, F.col("conf").cast("double"), F.lit(1))), "s", "place", "score", "embedding", 15)
