"""Queries of lookups, filters, merges and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import exact_search
from larkspur.operators import relational as ops
from larkspur.plans.registry import query, table


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey = 7").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 20")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.paged(table(spark, sf_dir, "orders"), "o_totalprice DESC", "o_orderkey", "o_orderkey", 25, 20).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return ops.lookup(table(spark, sf_dir, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) > 0 AS any_debt FROM customer GROUP BY c_mktsegment")
def exists_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), (F.count_if(F.col("c_acctbal") < 0) > 0).alias("any_debt"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def find_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.find_by(table(spark, sf_dir, "orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": "1-URGENT"})
    return ops.paged(found, "o_totalprice DESC", "o_orderkey", "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_acctbal < 0 AS changed FROM customer")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    debt = F.col("c_acctbal") < 0
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(debt, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"), debt.alias("changed"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return ops.without(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("""
    WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone) GROUP BY l_returnflag""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    _, lines = ops.cascade_delete(orders, orders.where("o_orderstatus = 'P'"), "o_orderkey", [(table(spark, sf_dir, "lineitem"), "l_orderkey")])
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
    WITH o AS (SELECT user_id, min(event_type) AS name, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
    w AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE max(event_type) END AS name, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
    SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(nullif(w.name, ''), o.name) AS name, coalesce(o.n, 0) + coalesce(w.n, 0) AS n
    FROM o FULL JOIN w ON o.user_id = w.user_id""")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    old = e.where("ts < '2024-01-16'").groupBy("user_id").agg(F.min("event_type").alias("name"), F.count("*").alias("n"))
    new = e.where("ts >= '2024-01-16'").groupBy("user_id").agg(F.max("event_type").alias("name"), F.count("*").alias("n"))
    new = new.withColumn("name", F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("name")))
    return ops.upsert(old, new, ["user_id"], {"name": "named_or_old", "n": "sum"})


@query("""
    WITH a AS (SELECT user_id, event_type, max(value) AS confidence, list_sort(list(event_id)) AS ids, CAST(NULL AS VARCHAR) AS context FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2),
    b AS (SELECT user_id, event_type, max(value) AS confidence, list_sort(list(event_id)) AS ids, CASE WHEN user_id % 2 = 0 THEN max(props) END AS context FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, greatest(a.confidence, b.confidence) AS confidence,
        list_concat(coalesce(a.ids, []), coalesce(b.ids, [])) AS ids, coalesce(b.context, a.context) AS context
    FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def relation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, key = table(spark, sf_dir, "events"), ["user_id", "event_type"]
    both = [F.max("value").alias("confidence"), F.array_sort(F.collect_list("event_id")).alias("ids")]
    old = e.where("ts < '2024-01-16'").groupBy(*key).agg(*both).withColumn("context", F.lit(None).cast("string"))
    new = e.where("ts >= '2024-01-16'").groupBy(*key).agg(*both, F.max("props").alias("context"))
    new = new.withColumn("context", F.when(F.col("user_id") % 2 == 0, F.col("context")))
    return ops.upsert(old, new, key, {"confidence": "greatest", "ids": "concat", "context": "new_or_old"})


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return ops.latest(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""
    SELECT n.doc_id, coalesce(h.first_seen, p.first_seen) AS first_seen, h.k IS NULL AND p.k IS NULL AS is_new
    FROM (SELECT doc_id, sha256(text) AS k, source || '/' || CAST(n_chars AS VARCHAR) AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) n
    LEFT JOIN (SELECT sha256(text) AS k, min(doc_id) AS first_seen FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) h ON h.k = n.k
    LEFT JOIN (SELECT source || '/' || CAST(n_chars AS VARCHAR) AS k, min(doc_id) AS first_seen FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) p ON p.k = n.path""")
def merge_new_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.concat_ws("/", "source", "n_chars").alias("path"))
    known = table(spark, sf_dir, "labels")
    before = ops.lookup(d, known, "doc_id").withColumnRenamed("doc_id", "first_seen")
    return ops.carry_previous(ops.without(d, known, "doc_id"), before, "hash", "path", ["first_seen"]).select("doc_id", "first_seen", "is_new")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


@query("""
    WITH items AS (SELECT o_custkey, p, row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS position FROM (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F')),
    fresh AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, p FROM items),
    ends AS (SELECT o_custkey, max(position) AS e FROM items GROUP BY 1)
    SELECT o_custkey, p AS item, CAST(position AS BIGINT) AS position FROM items UNION ALL
    SELECT f.o_custkey, f.p, CAST(coalesce(e, 0) + row_number() OVER (PARTITION BY f.o_custkey ORDER BY f.p) AS BIGINT) FROM fresh f LEFT JOIN ends USING (o_custkey)""")
def append_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", F.col("o_orderpriority").alias("item")).distinct()
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("item"))
    items = pairs.where("o_orderstatus = 'F'").select("o_custkey", "item", rank.alias("position"))
    new = pairs.where("o_orderstatus = 'O'").select("o_custkey", "item")
    return ops.append_to_list(items, new, "o_custkey", "item", [F.col("item")]).withColumn("position", F.col("position").cast("long"))


@query("""
    SELECT d.doc_id, d.lang, d.n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    WHERE d.lang IN ('en', 'fr') AND d.n_chars BETWEEN 500 AND 3000 AND coalesce(l.quality, 0) >= 1""")
def filter_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ops.enrich(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels"), "doc_id", ["quality"], "left")
    return d.where(F.col("lang").isin("en", "fr") & F.col("n_chars").between(500, 3000) & (F.coalesce("quality", F.lit(0)) >= 1)).select("doc_id", "lang", "n_chars")


@query("""
    WITH t AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS tags FROM orders GROUP BY 1)
    SELECT o_custkey, list_has_any(tags, ['1-URGENT', '5-LOW']) AS any_tag, list_has_all(tags, ['1-URGENT', '5-LOW']) AS all_tags, list_contains(tags, '3-MEDIUM') AS has_one FROM t""")
def array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("tags"))
    asked = F.array(F.lit("1-URGENT"), F.lit("5-LOW"))
    return tags.select("o_custkey", F.arrays_overlap("tags", asked).alias("any_tag"), (F.size(F.array_except(asked, "tags")) == 0).alias("all_tags"), F.array_contains("tags", "3-MEDIUM").alias("has_one"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90")
def json_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 90")


@query("""
    SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red bolt' THEN 1.0 WHEN starts_with(lower(p_name), 'red bolt') THEN 0.8 WHEN contains(lower(p_name), 'red bolt') THEN 0.5 ELSE 0.0 END::DOUBLE AS score
    FROM part WHERE contains(lower(p_name), 'red') ORDER BY score DESC, p_retailprice DESC, p_partkey LIMIT 60""")
def name_tier_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.lower("p_name").contains("red")).withColumn("score", tx.tier(F.col("p_name"), "red bolt"))
    return p.orderBy(F.desc("score"), F.desc("p_retailprice"), "p_partkey").limit(60).select("p_partkey", "p_name", "score")


_TRIGRAMS = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, len(w) + 2)] for w in regexp_extract_all(lower({}), '[a-z0-9]+')]))"


@query(f"""
    WITH t AS (SELECT c_custkey, {_TRIGRAMS.format("c_name || ' ' || c_mktsegment")} AS a FROM customer), q AS (SELECT c_custkey AS query_id, a AS b FROM t WHERE c_custkey % 100 = 0),
    s AS (SELECT query_id, c_custkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM t, q)
    SELECT * FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, c_custkey) <= 50""")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty customers with the most similar names for each whose id is divisible by 100."""
    grams = table(spark, sf_dir, "customer").select("c_custkey", tx.trigrams(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("members"))
    asked = grams.where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), F.col("members").alias("q"))
    return exact_search.set_search(grams, asked, "c_custkey", 50, 0.3)


@query("""
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 40""")
def case_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE (l.quality = 1 OR l.quality IS NULL) AND d.doc_id NOT IN (1, 2, 3)")
def nullable_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").where(~F.col("doc_id").isin(1, 2, 3))
    return ops.enrich(d, table(spark, sf_dir, "labels"), "doc_id", ["quality"], "left").where((F.col("quality") == 1) | F.col("quality").isNull())


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(0.0, least(1.0, l_discount * 12 - 0.1)) AS quality FROM lineitem")
def clamp_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("l_discount") * 12 - 0.1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", quality.alias("quality"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents")
def truncate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncated(F.col("text"), 200).alias("snippet"))


@query("""
    SELECT event_id, event_type, value FROM events
    WHERE (event_type LIKE '%view%' OR event_type LIKE '%purch%') AND (user_id % 2 = 0 OR value < 50)
      AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY""")
def related_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("as_of"))
    recent = e.join(F.broadcast(last), F.col("ts") >= F.col("as_of") - F.expr("INTERVAL 10 DAYS"))
    return recent.where(F.col("event_type").rlike("view|purch") & ((F.col("user_id") % 2 == 0) | (F.col("value") < 50))).select("event_id", "event_type", "value")


@query("""
    WITH f AS (SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size >= 45)
    SELECT *, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 40 AS has_more FROM f ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20""")
def list_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").where("p_size >= 45").select("p_partkey", "p_name", "p_retailprice")
    total = found.agg(F.count("*").alias("total"))
    page = ops.paged(found, "p_retailprice DESC", "p_partkey", "p_partkey", 20, 20)
    return page.join(F.broadcast(total)).withColumn("has_more", F.col("total") > 40)


@query("""
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, c.c_name, n.n_name, l.l_extendedprice * (1 - l.l_discount) AS revenue
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
    WHERE o.o_orderdate >= TIMESTAMP '1998-06-01' AND l.l_returnflag = 'R'""")
def join_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= '1998-06-01'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    joined = lines.join(orders, "l_orderkey").join(table(spark, sf_dir, "customer"), "c_custkey").withColumnRenamed("c_nationkey", "n_nationkey")
    joined = joined.join(table(spark, sf_dir, "nation"), "n_nationkey")
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c_name", "n_name", revenue)


@query("""
    SELECT n.n_nationkey, n.n_name, r.r_name AS parent, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, s.n IS NOT NULL AS has_suppliers
    FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
    LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c.c_nationkey = n.n_nationkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey""")
def parent_with_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("parent")), "n_regionkey", "left")
    n = ops.with_counts(n, table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", "customers")
    n = ops.with_counts(n, table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", "suppliers")
    return n.select("n_nationkey", "n_name", "parent", "customers", "suppliers", (F.col("suppliers") > 0).alias("has_suppliers"))


@query("SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def left_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return ops.with_counts(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "n_orders")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(returned, "o_orderkey", "left").select("o_orderkey", F.col("hit").isNotNull().alias("returned"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lookup(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("""
    SELECT b.l_partkey AS other, count(DISTINCT a.l_orderkey) AS together FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
    WHERE a.l_partkey = 10 AND b.l_partkey <> 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def self_join_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    center = pairs.where("l_partkey = 10").select("l_orderkey")
    counts = pairs.where("l_partkey <> 10").join(center, "l_orderkey").groupBy(F.col("l_partkey").alias("other")).agg(F.count("*").alias("together"))
    return counts.orderBy(F.desc("together"), "other").limit(10)


@query("""
    WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS word FROM documents)
    SELECT word, count(*) AS docs FROM w GROUP BY 1 HAVING count(*) >= 5""")
def lateral_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))
    w = table(spark, sf_dir, "documents").select(F.explode(found).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("docs")).where("docs >= 5")


@query("""
    SELECT v.event_id AS view_id, p.event_id AS purchase_id, round(date_diff('second', v.ts, p.ts) / 60.0, 4) AS minutes
    FROM events v JOIN events p ON v.user_id = p.user_id AND abs(epoch(p.ts) - epoch(v.ts)) <= 3600
    WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    view = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.unix_micros("ts").alias("a"))
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.unix_micros("ts").alias("b"))
    pairs = ops.band_join(view, bought, "user_id", "a", "b", 3600 * 1_000_000)
    seconds = F.floor(F.col("b") / 1_000_000) - F.floor(F.col("a") / 1_000_000)
    return pairs.select("view_id", "purchase_id", F.round(seconds / 60.0, 4).alias("minutes"))


_PATHS = """
    paths AS (SELECT 'r' || r_regionkey AS path, r_name AS name FROM region
      UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey, n_name FROM nation
      UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer as a tree of materialised paths."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("path"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").withColumn("path", F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("path", F.lit("/c"), "c_custkey").alias("path"), F.col("c_name").alias("name"))
    return r.union(n.select("path", F.col("n_name").alias("name"))).union(c)


@query(f"WITH {_PATHS} SELECT a.path AS ancestor, count(*) AS descendants FROM paths a JOIN paths d ON d.path LIKE a.path || '/%' GROUP BY 1")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    up = p.select("path", F.explode(ops.prefixes(F.col("path"))).alias("ancestor")).where("ancestor <> path")
    return up.join(p.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").groupBy("ancestor").agg(F.count("*").alias("descendants"))


@query("""
    WITH e AS (SELECT n_nationkey AS source, n_regionkey AS target FROM nation)
    SELECT node, count(*) AS n, list_sort(list(neighbour)) AS neighbours FROM
      (SELECT 'n' || source AS node, 'r' || target AS neighbour FROM e UNION ALL SELECT 'r' || target, 'n' || source FROM e) GROUP BY 1""")
def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("neighbour"))
    both = e.unionByName(e.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour")))
    return both.groupBy("node").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("neighbour")).alias("neighbours"))


@query("""
    SELECT DISTINCT o.o_custkey, l.l_suppkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
    WHERE o.o_custkey IN (SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building') AND l.l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    buyers = table(spark, sf_dir, "customer").where(F.lower("c_mktsegment") == "building").select(F.col("c_custkey").alias("o_custkey"))
    sellers = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return ops.lookup(ops.lookup(edges, buyers, "o_custkey"), sellers, "l_suppkey").distinct()


@query("""
    WITH f AS (SELECT user_id, list_distinct(list(event_type)) AS factors FROM events GROUP BY 1),
    r AS (SELECT * FROM (VALUES ('all', ['click', 'view', 'purchase'], 'HIGH'), ('two', ['error', 'signup'], 'LOW'), ('critical', ['error', 'purchase', 'signup'], 'CRITICAL')) t(rule, needs, severity))
    SELECT user_id, rule, CASE WHEN list_has_all(factors, needs) THEN severity ELSE 'MODERATE' END AS severity FROM f, r
    WHERE list_has_all(factors, needs) OR (severity IN ('CRITICAL', 'HIGH') AND len(list_intersect(factors, needs)) >= 2)""")
def subset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("factors"))
    rules = spark.createDataFrame([("all", ["click", "view", "purchase"], "HIGH"), ("two", ["error", "signup"], "LOW"), ("critical", ["error", "purchase", "signup"], "CRITICAL")], "rule string, needs array<string>, severity string")
    exploded = factors.select("user_id", F.explode("factors").alias("need"))
    needs = rules.select("rule", F.size("needs").alias("wanted"), "severity", F.explode("needs").alias("need"))
    met = exploded.join(F.broadcast(needs), "need").groupBy("user_id", "rule", "severity", "wanted").agg(F.count("*").alias("n"))
    full = F.col("n") == F.col("wanted")
    return met.where(full | (F.col("severity").isin("CRITICAL", "HIGH") & (F.col("n") >= 2))).select("user_id", "rule", F.when(full, F.col("severity")).otherwise("MODERATE").alias("severity"))


@query("""
    SELECT c.c_mktsegment, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderkey END) AS finished,
        count(DISTINCT CASE WHEN l.l_returnflag = 'R' THEN l.l_orderkey END) AS with_returns
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1""")
def fanout_safe_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("r", F.lit(1))
    per = table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("r").alias("r"))
    joined = table(spark, sf_dir, "customer").join(per, "c_custkey", "left").groupBy("c_mktsegment")
    return joined.agg(F.count("*").alias("customers"), F.coalesce(F.sum("f"), F.lit(0)).alias("finished"), F.coalesce(F.sum("r"), F.lit(0)).alias("with_returns"))


@query("""
    SELECT o.o_orderpriority, round(avg(CASE WHEN l.l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS return_rate, count(*) AS lines
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1""")
def accuracy_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    joined = table(spark, sf_dir, "orders").join(lines, "o_orderkey").groupBy("o_orderpriority")
    return joined.agg(F.round(F.sum("r") / F.sum("n"), 6).alias("return_rate"), F.sum("n").alias("lines"))


@query("""
    WITH w AS (SELECT 'document' AS kind, doc_id AS id, source AS side, unnest(list_distinct(regexp_extract_all(text, '([0-9]{1,3})%', 1))) AS value FROM documents
      UNION ALL SELECT 'customer', c_custkey, c_nationkey::VARCHAR, c_mktsegment || ':' || floor(c_acctbal)::BIGINT FROM customer),
    g AS (SELECT *, min(id) OVER (PARTITION BY kind, value) AS class, count(*) OVER (PARTITION BY kind, value) - count(*) OVER (PARTITION BY kind, value, side) AS conflicts FROM w)
    SELECT kind, id, value, class, conflicts FROM g WHERE conflicts > 0""")
def pair_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of different sides with one value: the least of them and how many each conflicts with, from counts and never as pairs."""
    values = F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{1,3})%"), F.lit(1)))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("side"), F.explode(values).alias("value"))
    whole = F.concat_ws(":", "c_mktsegment", F.floor("c_acctbal").cast("string"))
    rows = docs.union(table(spark, sf_dir, "customer").select(F.lit("customer"), "c_custkey", F.col("c_nationkey").cast("string"), whole))
    sides = rows.groupBy("kind", "value", "side").agg(F.count("*").alias("own"), F.min("id").alias("first"))
    groups = sides.groupBy("kind", "value").agg(F.sum("own").alias("n"), F.min("first").alias("class"))
    met = rows.join(sides.drop("first"), ["kind", "value", "side"]).join(groups, ["kind", "value"])
    return met.select("kind", "id", "value", "class", (F.col("n") - F.col("own")).alias("conflicts")).where("conflicts > 0")


@query("SELECT doc_id AS id, 'document' AS kind, n_chars AS size FROM documents UNION ALL SELECT page_id, 'page', length(html) FROM pages UNION ALL SELECT item_id, 'benchmark', length(text) FROM benchmark")
def union_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.col("n_chars").alias("size"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.length("html").cast("long").alias("size"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind"), F.length("text").cast("long").alias("size"))
    return d.unionByName(p).unionByName(b)


@query("SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-25'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ops.without(e.where("event_type = 'view'").select("user_id").distinct(), e.where("event_type = 'purchase' AND ts >= '2024-01-25'"), "user_id")


@query("""
    WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM benchmark)
    SELECT a.item_id, len(list_intersect(a.w, b.w)) AS shared, len(list_distinct(list_concat(a.w, b.w))) AS either, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 6) AS similarity
    FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def jaccard_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each item shares with the next one."""
    t = table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("w"))
    both = t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v")), "item_id")
    sizes = [F.size(f("w", "v")).cast("long") for f in (F.array_intersect, F.array_union)]
    return both.select("item_id", sizes[0].alias("shared"), sizes[1].alias("either"), F.round(tx.jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


@query("""
    WITH t AS (SELECT user_id, event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16')::DOUBLE AS a, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16')::DOUBLE AS b FROM events GROUP BY 1, 2)
    SELECT user_id, round(2 * sum(CASE WHEN a > 0 AND b > 0 THEN greatest(a, b) ELSE 0 END) / sum(a + b), 6) AS overlap FROM t GROUP BY 1""")
def weighted_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("ts") < "2024-01-16"
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(early).cast("double").alias("a"), F.count_if(~early).cast("double").alias("b"))
    shared = F.when((F.col("a") > 0) & (F.col("b") > 0), F.greatest("a", "b")).otherwise(0.0)
    return t.groupBy("user_id").agg(F.round(2 * F.sum(shared) / F.sum(F.col("a") + F.col("b")), 6).alias("overlap"))


@query("SELECT d.doc_id, l.quality, d.n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality DESC NULLS LAST, d.n_chars, d.doc_id LIMIT 450")
def nulls_last_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ops.enrich(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id", ["quality"], "left")
    return d.orderBy(F.desc_nulls_last("quality"), "n_chars", "doc_id").limit(450).select("doc_id", "quality", "n_chars")


@query("""
    WITH b AS (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY n_chars DESC, doc_id) AS r FROM documents)
    SELECT doc_id, n_chars FROM b WHERE r = 1 ORDER BY n_chars DESC, doc_id LIMIT 10""")
def gap_prioritise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2(F.lower(F.trim("text")), 256).alias("topic"), "doc_id", "n_chars")
    return ops.first(d, ["topic"], [-F.col("n_chars"), F.col("doc_id")]).orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':7'), c_custkey) AS r FROM customer) WHERE r <= 20")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(":7"))), F.col("c_custkey")]
    return ops.top_per_key(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], order, 20).drop("rank")
