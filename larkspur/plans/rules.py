"""Queries of rule tables on text and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import exact_search, relational
from larkspur.operators import rules as ops
from larkspur.plans.learning import _REVIEWS, reviews
from larkspur.plans.registry import query, table


@query("""
    WITH a AS (SELECT p_partkey, regexp_replace(p_name || ' ' || p_type, '(?i)\\b(eco|red)\\b', '\\1 ruddy', 'g') AS t FROM part)
    SELECT p_partkey, t || CASE WHEN contains(lower(t), 'bolt') AND NOT contains(lower(t), 'screw') THEN ' screw' ELSE '' END || CASE WHEN contains(lower(t), 'bolt') AND NOT contains(lower(t), 'pin') THEN ' pin' ELSE '' END AS expanded FROM a""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", ops.expand(text, {"eco|red": "ruddy"}, {"bolt": ["screw", "pin", "rivet"]}).alias("expanded"))


@query("SELECT p_partkey, list_sort(list_filter([CASE WHEN contains(lower(p_name), 'bolt') THEN 'C1' END, CASE WHEN contains(lower(p_name), 'red') THEN 'C2' END, CASE WHEN contains(lower(p_name), 'gear') THEN 'C3' END], lambda x: x IS NOT NULL)) AS cuis FROM part")
def query_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ops.concepts(F.col("p_name"), {"bolt": "C1", "red": "C2", "gear": "C3"}).alias("cuis"))


@query("""
    SELECT doc_id, 'ip' AS kind, unnest(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) AS found FROM documents
    UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\\+1 \\([0-9]{3}\\) [0-9-]{8}')) FROM documents UNION ALL SELECT doc_id, 'license', unnest(regexp_extract_all(text, 'licensed under the ([A-Za-z ]+)', 1)) FROM documents""")
def pattern_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0), ("phone", r"\+1 \([0-9]{3}\) [0-9-]{8}", 0), ("license", "licensed under the ([A-Za-z ]+)", 1)]
    return ops.extract(table(spark, sf_dir, "documents"), ["doc_id"], "text", patterns)


@query("""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]+) of ([a-z]+)', 1)) AS s, unnest(regexp_extract_all(lower(text), '([a-z]+) of ([a-z]+)', 2)) AS t FROM documents),
    e AS (SELECT * FROM (VALUES ('the', 0.9), ('and', 0.8), ('are', 0.7), ('that', 0.6)) v(name, conf))
    SELECT doc_id, s, 'part_of' AS rel, t, max(least(a.conf, b.conf))::DOUBLE AS conf FROM m JOIN e a ON a.name = s JOIN e b ON b.name = t GROUP BY 1, 2, 3, 4""")
def pattern_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = spark.createDataFrame([("the", 0.9), ("and", 0.8), ("are", 0.7), ("That", 0.6)], "name string, conf double")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return ops.relations(docs, ["doc_id"], "text", [("part_of", "([a-z]+) of ([a-z]+)")], entities)


@query("""
    WITH r AS (SELECT * FROM (VALUES ('optic the nerve', 'common'), ('thonly vein', 'rare'), ('ab token', 'common')) v(zone, frequency))
    SELECT doc_id, zone, CASE frequency WHEN 'common' THEN 'CRITICAL' ELSE 'HIGH' END AS priority FROM documents, r
    WHERE len(list_filter(string_split(zone, ' '), lambda w: length(w) > 3 AND contains(lower(text), w))) = 0 AND NOT contains(lower(text), zone)""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("optic the nerve", "common"), ("thonly vein", "rare"), ("ab token", "common")], "zone string, frequency string")
    return ops.coverage_gaps(table(spark, sf_dir, "documents"), ["doc_id"], "text", rules)


@query("""
    SELECT doc_id, 'that with' AS term FROM documents WHERE lang = 'en' AND contains(lower(text), 'that') AND contains(lower(text), 'with') AND regexp_matches(lower(text), '(?s)was.*that')
    UNION ALL SELECT doc_id, 'avec' FROM documents WHERE lang = 'fr' AND contains(lower(text), 'avec') AND regexp_matches(lower(text), '(?s)pour.*avec')""")
def stage_inappropriate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("en", "that with", "was"), ("fr", "avec", "pour")]
    return ops.inappropriate(table(spark, sf_dir, "documents"), ["doc_id"], "text", "lang", rules)


@query("""
    WITH i AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 100), t AS (SELECT * FROM (VALUES ('click', 'error', 'high'), ('purchase', 'signup', 'low')) v(a, b, severity))
    SELECT x.user_id, t.a, t.b, t.severity FROM t JOIN i x ON x.event_type = t.a JOIN i y ON y.event_type = t.b AND y.user_id = x.user_id""")
def pair_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([("error", "click", "high"), ("purchase", "signup", "low")], "a string, b string, severity string")
    return ops.interactions(table(spark, sf_dir, "events").where("value > 100"), "user_id", "event_type", listed)


@query("""
    WITH c AS (SELECT user_id, list_distinct(list(event_type)) AS w, CASE WHEN max(value) > 150 THEN 'high' ELSE 'low' END AS state FROM events WHERE value > 100 GROUP BY 1),
    r AS (SELECT * FROM (VALUES ('r1', 'HIGH', ['click', 'view'], ['signup'], 'high'), ('r2', 'LOW', ['error'], ['none'], 'low')) v(rule, severity, triggers, exceptions, escalates))
    SELECT user_id, rule, CASE WHEN state = escalates THEN 'CRITICAL' ELSE severity END AS severity FROM c, r WHERE list_has_any(w, triggers) AND NOT list_has_any(w, exceptions)""")
def rule_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 100").groupBy("user_id")
    cases = e.agg(F.collect_set("event_type").alias("words"), F.when(F.max("value") > 150, "high").otherwise("low").alias("state"))
    rules = spark.createDataFrame([("r1", "HIGH", ["click", "view"], ["signup"], "high"), ("r2", "LOW", ["error"], ["none"], "low")], "rule string, severity string, triggers array<string>, exceptions array<string>, escalates string")
    return ops.triggered(cases, "user_id", "words", rules)


@query("""
    WITH s AS (SELECT o_custkey, count(*)::DOUBLE AS n, sum(o_totalprice) / 1000 AS w, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS done, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1),
    p AS (SELECT o_custkey, (least(1, n / 12) * 0.5::DOUBLE + least(1, w / 2000) * 0.5::DOUBLE - CASE WHEN w > 9600 THEN 0.1 ELSE 0 END) * 0.40::DOUBLE + 0.9::DOUBLE * 0.25::DOUBLE + done / n * 0.10::DOUBLE + CASE WHEN done > 0 THEN 0.05 ELSE 0 END
      + greatest(0, 0.20::DOUBLE - least(0.15::DOUBLE, urgent * 0.03::DOUBLE) - least(0.10::DOUBLE, 0 * 0.05::DOUBLE)) AS score FROM s)
    SELECT o_custkey, round(score, 6) AS score, CASE WHEN score >= 0.85 THEN 'A' WHEN score >= 0.70 THEN 'B' WHEN score >= 0.55 THEN 'C' ELSE 'D' END AS grade FROM p""")
def synthesis_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey")
    s = o.agg(F.count("*").alias("n"), (F.sum("o_totalprice") / 1000).alias("w"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    score, grade = ops.synthesis_score(F.col("n"), F.lit(12), F.col("w"), 2000, 8000, F.lit(0.9), F.col("n"), F.col("done"), F.col("done"), F.col("urgent"), F.lit(0))
    return s.select("o_custkey", F.round(score, 6).alias("score"), grade.alias("grade"))


@query("""
    WITH r AS (SELECT n_regionkey, list('| ' || n_name || ' | ' || n_nationkey || ' |' ORDER BY n_nationkey) AS lines FROM nation GROUP BY 1)
    SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(lines, chr(10)) AS markdown FROM r""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string")).alias("cells"))
    r = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    rows = F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), F.transform("rows", lambda x: x["cells"]))
    return r.select("n_regionkey", ops.markdown_table(rows).alias("markdown"))


@query("SELECT conv_id, string_agg('[' || n || '] ' || role || chr(10) || text || chr(10), chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1")
def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.format_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role")


@query("""
    WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9_]+')) AS w FROM part), q AS (SELECT p_partkey AS query_id, w AS q FROM t WHERE p_partkey % 100 = 0),
    s AS (SELECT query_id, p_partkey, round(100.0::DOUBLE * len(list_intersect(w, q)) / least(len(w), len(q)), 4) AS ratio FROM t, q)
    SELECT * FROM s WHERE ratio >= 60 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ratio DESC, p_partkey) <= 100""")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred parts with the most words in common for each whose id is divisible by 100."""
    p = table(spark, sf_dir, "part").select("p_partkey", tx.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("members"))
    asked = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("members").alias("q"))
    return exact_search.set_search(p, asked, "p_partkey", 100, 60.0, "overlap", 4, 100.0, name="ratio")


@query("SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'gear') OR contains(lower(p_type), 'gear')) AND p_brand = 'Brand#2' AND p_size >= 5 AND p_retailprice <= 1000 ORDER BY p_retailprice DESC, p_partkey")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.search_catalog(table(spark, sf_dir, "part"), ["p_name", "p_type"], "GEAR", {"p_brand": "Brand#2"}, {"p_size": 5}, {"p_retailprice": 1000})
    return found.orderBy(F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_name")


@query("""
    WITH s AS (SELECT doc_id, source, lang AS section, (0.5::DOUBLE + doc_id % 5 / 10.0::DOUBLE) * (n_chars / 5000.0::DOUBLE) AS score, n_chars FROM documents WHERE n_chars / 5000.0::DOUBLE >= 0.4),
    r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) SELECT section, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def context_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.col("n_chars") / 5000.0
    score = F.round((0.5 + F.col("doc_id") % 5 / 10.0) * quality, 6)
    d = table(spark, sf_dir, "documents").where(quality >= 0.4).select(F.col("lang").alias("section"), "doc_id", score.alias("score"))
    return relational.top_per_key(d, ["section"], [F.desc("score"), F.col("doc_id")], 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
    WITH {_REVIEWS}, d AS (SELECT event_id, stability AS s, 5.0::DOUBLE AS d0, x.g AS rating FROM r, (SELECT unnest([1, 2, 3, 4]) AS g) x),
    n AS (SELECT *, least(10, greatest(1, d0 + (rating - 3) * 0.2909::DOUBLE + 0.2909::DOUBLE * (2.2271::DOUBLE - d0))) AS dn, 0.9::DOUBLE AS q FROM d),
    k AS (SELECT *, CASE WHEN rating = 1 THEN greatest(0.1::DOUBLE, s * exp(1.0507::DOUBLE) * pow(dn, -0.0028::DOUBLE) * (pow(s + 1, 2.4028::DOUBLE) - 1) * exp(0.1131::DOUBLE * (1 - q)))
      ELSE s * (1 + exp(1.0651::DOUBLE) * (11 - dn) * pow(s, -0.5316::DOUBLE) * exp(0.1192::DOUBLE * (1 - q)) * CASE rating WHEN 2 THEN 0.0046::DOUBLE WHEN 4 THEN 1.5352::DOUBLE ELSE 1 END * exp(-0.0272::DOUBLE * 1)) END AS sn FROM n)
    SELECT event_id, rating, round(dn, 6) AS difficulty, round(greatest(1, least(180, sn * (ln(0.92::DOUBLE) / ln(0.9::DOUBLE)))), 4) AS days FROM k""")
def tracked_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ops.preview(reviews(spark, sf_dir).select("event_id", "stability"))
    r = r.withColumn("d", ops.tracked_difficulty(F.lit(5.0), F.col("rating")))
    after = ops.tracked_stability(F.col("stability"), F.col("d"), F.lit(0.9), F.col("rating"), F.lit(1))
    return r.select("event_id", "rating", F.round("d", 6).alias("difficulty"), F.round(ops.tracked_interval(after, "factual"), 4).alias("days"))


@query("""
    SELECT source, round(sum(n_chars) FILTER (WHERE lang = 'en')::DOUBLE / sum(n_chars), 6) AS internal_share, count(*) FILTER (WHERE contains(lower(text), 'token')) AS routed FROM documents GROUP BY 1""")
def internal_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.sum(F.when(F.col("lang") == "en", F.col("n_chars")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.try_divide(inside, F.sum("n_chars")), 6).alias("internal_share"), F.count_if(F.lower("text").contains("token")).alias("routed"))
