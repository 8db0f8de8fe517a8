"""Queries of entities, links and array columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import entities as ops
from larkspur.plans.registry import query, table


@query("""
    WITH l AS (SELECT 'P' || l_partkey AS chunk, 'S' || l_suppkey AS image, l_discount AS score, l_orderkey * 10 + l_linenumber AS pos FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size >= 10 AND s_acctbal > 0),
    m AS (SELECT md5(chunk) AS chunk_id, md5(image) AS image_id, score, pos FROM l)
    SELECT chunk_id, image_id, arg_max(score, (pos, score)) AS score, max(pos) AS pos FROM m GROUP BY 1, 2""")
def link_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    links = lines.select(F.concat(F.lit("P"), "l_partkey").alias("chunk"), F.concat(F.lit("S"), "l_suppkey").alias("image"), F.col("l_discount").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    parts = table(spark, sf_dir, "part").where("p_size >= 10").select(F.concat(F.lit("P"), "p_partkey").alias("outer"))
    sellers = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), "s_suppkey").alias("outer"))
    mapped = ops.map_ids(links, parts.withColumn("id", F.md5("outer")), sellers.withColumn("id", F.md5("outer")))
    return ops.upsert_links(mapped.where("pos % 2 = 0"), mapped.where("pos % 2 = 1"), ["pos", "score"])


@query("""
    WITH m AS (SELECT DISTINCT lower(trim(p_name)) AS name FROM part) SELECT md5(name) AS id, name FROM m WHERE name NOT IN (SELECT lower(p_name) FROM part WHERE p_retailprice < 902)""")
def missing_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_retailprice", F.col("p_name").alias("name"))
    return ops.missing_entities(p.where("p_retailprice < 902"), p)


@query("""
    WITH c AS (SELECT o_orderkey, ['c' || o_custkey % 50] AS cuis, [' ' || o_orderpriority, upper(o_orderpriority), o_orderstatus] AS texts FROM orders),
    e AS (SELECT unnest(cuis) AS cui FROM c UNION ALL SELECT 'REGEX_' || substr(md5(t), 1, 8) FROM (SELECT unnest(list_distinct(list_transform(texts, lambda x: lower(trim(x))))) AS t FROM c)) SELECT cui, count(*) AS chunks FROM e GROUP BY 1""")
def entity_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(F.concat(F.lit(" "), "o_orderpriority"), F.upper("o_orderpriority"), F.col("o_orderstatus"))
    chunks = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.concat(F.lit("c"), F.col("o_custkey") % 50)).alias("cuis"), texts.alias("texts"))
    return ops.populate(chunks, "o_orderkey")


@query("""
    WITH c AS (SELECT user_id AS document, unnest(['c' || event_id % 5, 'd' || event_id % 3]) AS cui FROM events) SELECT document, cui, count(*) AS n FROM c WHERE cui IN ('c1', 'c2', 'd0') GROUP BY 1, 2""")
def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuis = F.array(F.concat(F.lit("c"), F.col("event_id") % 5), F.concat(F.lit("d"), F.col("event_id") % 3))
    chunks = table(spark, sf_dir, "events").select(F.col("user_id").alias("document"), cuis.alias("cuis"))
    known = spark.createDataFrame([("c1",), ("c2",), ("d0",)], "cui string")
    return ops.mention_counts(chunks, "document", "cuis", known)


@query("""
    WITH l AS (SELECT l_orderkey AS relation, list_distinct(list(l_partkey)) AS ids FROM lineitem GROUP BY 1), e AS (SELECT relation, unnest(ids) AS p_partkey FROM l)
    SELECT p.p_partkey, e.relation FROM part p LEFT JOIN e ON e.p_partkey = p.p_partkey""")
def array_membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("relation")).agg(F.collect_set("l_partkey").alias("ids"))
    return ops.members_left(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", lists, "ids", ["relation"])


@query("""
    SELECT o_custkey, len(list_filter(list({'p': o_orderpriority, 's': o_orderstatus}), lambda x: x.p = '1-URGENT' AND x.s = 'F')) > 0 AS has_urgent,
      len(list_filter(list(o_orderpriority), lambda x: contains(lower(x), 'spec'))) > 0 AS any_like FROM orders GROUP BY 1""")
def struct_array_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))).alias("e"))
    urgent = F.exists("e", lambda x: (x["p"] == "1-URGENT") & (x["s"] == "F"))
    return o.select("o_custkey", urgent.alias("has_urgent"), F.exists("e", lambda x: F.lower(x["p"]).contains("spec")).alias("any_like"))


@query("SELECT p_partkey FROM part WHERE list_contains(list_transform(string_split(p_name, ' '), lambda x: lower(x)), 'bolt')")
def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = F.transform(F.split("p_name", " "), F.lower)
    return table(spark, sf_dir, "part").where(F.array_contains(aliases, "bolt")).select("p_partkey")


@query("""
    SELECT vec_id, regexp_replace(coalesce(nullif(CASE vec_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'output/images/s' || vec_id END, ''), 'f/' || vec_id), '^output/images/', '') AS path, 'img_' || vec_id AS virtual_id FROM embeddings""")
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    storage = F.when(v % 3 == 0, "").when(v % 3 == 1, F.concat(F.lit("output/images/s"), v))
    return table(spark, sf_dir, "embeddings").select("vec_id", ops.clean_path(storage, F.concat(F.lit("f/"), v)).alias("path"), F.concat(F.lit("img_"), v).alias("virtual_id"))


@query("""
    WITH f AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER) AS id, l_returnflag AS unit, l_quantity AS v, l_partkey AS p, l_suppkey % 10 AS s, l_linestatus AS t, s_acctbal > 0 AS inside FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
    SELECT DISTINCT a.id AS a, b.id AS b FROM f a JOIN f b ON a.unit = b.unit AND a.p = b.p AND a.s = b.s AND a.t = b.t WHERE a.inside AND NOT b.inside AND abs(a.v - b.v) > 0.15 * greatest(a.v, b.v)""")
def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), F.col("l_suppkey") % 10), F.col("l_linestatus"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 0).alias("inside"))
    f = table(spark, sf_dir, "lineitem").join(sellers, "l_suppkey").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("id"), F.col("l_returnflag").alias("unit"), F.col("l_quantity").alias("value"), words.alias("words"), "inside").dropDuplicates(["id"])
    return ops.fact_conflicts(f.where("inside"), f.where("NOT inside"))
