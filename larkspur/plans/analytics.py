"""Queries of statistics, distributions and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import analytics as ops
from larkspur.operators import relational
from larkspur.plans.registry import query, table

#: Stand-in ratings of events: which event types count as passed.
RATING = "CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4 END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a rating (null for signups) and a day."""
    e = table(spark, sf_dir, "events")
    return e.withColumns({"rating": F.expr(RATING), "day": F.to_date("ts")})


@query("""
    SELECT count(*) AS total, count(l.quality) AS labelled, count(*) FILTER (WHERE d.n_chars > 2000) AS long, count(DISTINCT d.lang) AS langs, count(DISTINCT d.source) AS sources
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def stats_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = relational.enrich(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels"), "doc_id", ["quality"], "left")
    return d.agg(F.count("*").alias("total"), F.count("quality").alias("labelled"), F.count_if(F.col("n_chars") > 2000).alias("long"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"))


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_type IS NOT NULL").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


@query("SELECT count(*) AS links, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, round(avg(l_discount), 10) AS avg_score, min(l_discount) AS min_score, max(l_discount) AS max_score FROM lineitem")
def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("links"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"),
        F.round(F.avg("l_discount"), 10).alias("avg_score"), F.min("l_discount").alias("min_score"), F.max("l_discount").alias("max_score"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def link_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT floor(l_discount * 10) / 10 AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.histogram(table(spark, sf_dir, "lineitem"), "l_discount", 10)


@query("SELECT CASE WHEN l_discount >= 0.07 THEN 'high' WHEN l_discount >= 0.03 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1")
def three_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("l_discount") >= 0.07, "high").when(F.col("l_discount") >= 0.03, "medium").otherwise("low")
    return table(spark, sf_dir, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


@query("""
    SELECT user_id, event_type, count(*) AS n, round(avg(value), 8) AS mean, list_slice(list(event_id ORDER BY ts DESC, event_id DESC) FILTER (WHERE value > 20), 1, 5) AS samples
    FROM events GROUP BY 1, 2 HAVING count(*) FILTER (WHERE value > 20) > 0""")
def array_agg_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    samples = ops.first_samples(e.where("value > 20"), ["user_id", "event_type"], "event_id", [F.desc("ts"), F.desc("event_id")], 5)
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean")).join(samples, ["user_id", "event_type"])


@query("""
    SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS answered, count(*) FILTER (WHERE event_type = 'error') AS unanswered, round(avg(value) FILTER (WHERE event_type <> 'error'), 8) AS quality,
      count(DISTINCT user_id) AS users, round(coalesce(count(*) FILTER (WHERE event_type <> 'error')::DOUBLE / nullif(count(*), 0), 0), 6) AS answer_rate
    FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("as_of"))), F.col("ts") >= F.col("as_of") - F.expr("INTERVAL 7 DAYS"))
    good = F.col("event_type") != "error"
    return e.agg(F.count("*").alias("total"), F.count_if(good).alias("answered"), F.count_if(~good).alias("unanswered"), F.round(F.avg(F.when(good, F.col("value"))), 8).alias("quality"),
                 F.count_distinct("user_id").alias("users"), F.round(ops.ratio(F.count_if(good), F.count("*")), 6).alias("answer_rate"))


@query("""
    SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS n_lines
    FROM customer WHERE c_acctbal > 0""")
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    per = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines"))
    live = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return live.join(per, "c_custkey", "left").fillna(0, ["n_orders", "n_lines"])


@query("SELECT count(*) AS n, count(DISTINCT event_type) AS types, list_sort(list(DISTINCT event_type)) AS type_list FROM events")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("types"), F.array_sort(F.collect_set("event_type")).alias("type_list"))


@query("""
    WITH w AS (SELECT source, regexp_extract_all(lower(text), '[a-z]{4,}') AS ws, doc_id FROM documents),
    e AS (SELECT source, unnest(ws) AS word FROM w), c AS (SELECT source, word, count(*) AS n FROM e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM c WHERE word NOT IN ('that', 'this', 'with', 'from', 'have'))
    SELECT source, word, n, rank FROM r WHERE rank <= 10""")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    w = table(spark, sf_dir, "documents").select("source", F.explode(found).alias("word")).where(~F.col("word").isin("that", "this", "with", "from", "have"))
    counts = w.groupBy("source", "word").agg(F.count("*").alias("n"))
    return relational.top_per_key(counts, ["source"], [F.desc("n"), F.col("word")], 10).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'refund') AS refund, count(*) AS total FROM events GROUP BY 1")
def zero_fill_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id")
    states = [F.count_if(F.col("event_type") == s).alias(s) for s in ("click", "view", "refund")]
    return e.agg(*states, F.count("*").alias("total"))


@query(f"""
    WITH v AS (SELECT unnest([1, 2, 3, 4, 5]) AS rating), c AS (SELECT {RATING} AS rating, count(*) AS n FROM events GROUP BY 1)
    SELECT v.rating, coalesce(c.n, 0) AS n FROM v LEFT JOIN c ON c.rating = v.rating""")
def rating_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.zero_filled(events(spark, sf_dir).select("rating"), "rating", [1, 2, 3, 4, 5])


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS due FROM events WHERE event_type <> 'signup' AND ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27' GROUP BY 1")
def forecast_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'signup' AND ts >= '2024-01-20' AND ts < '2024-01-27'")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("due"))


@query(f"""
    SELECT user_id, count(*) AS total, count(*) FILTER (WHERE r = 1) AS again, count(*) FILTER (WHERE r >= 3) AS passed, count(*) FILTER (WHERE r IS NULL) AS fresh, round(avg(value), 8) AS mean, round(sum(value), 2) AS total_value,
      round(coalesce(count(*) FILTER (WHERE r >= 3)::DOUBLE / nullif(count(r), 0), 0), 6) AS retention
    FROM (SELECT *, {RATING} AS r FROM events) GROUP BY 1""")
def user_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rating")
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(r == 1).alias("again"), F.count_if(r >= 3).alias("passed"), F.count_if(r.isNull()).alias("fresh"),
        F.round(F.avg("value"), 8).alias("mean"), F.round(F.sum("value"), 2).alias("total_value"), F.round(ops.ratio(F.count_if(r >= 3), F.count(r)), 6).alias("retention"))


@query(f"""
    SELECT CAST(ts AS DATE) AS day, count(*) AS reviews, count(*) FILTER (WHERE {RATING} >= 3) AS correct, count(DISTINCT user_id) AS users, round(avg(value), 8) AS mean FROM events GROUP BY 1""")
def daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("day").agg(F.count("*").alias("reviews"), F.count_if(F.col("rating") >= 3).alias("correct"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 8).alias("mean"))


@query("""
    SELECT event_type, round(avg(value), 8) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 8).alias("mean"), p.alias("p"))
    return e.select("event_type", "mean", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))))


@query(f"""
    SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS reviews, count(DISTINCT user_id) AS users, round(sum(value) / 60, 4) AS minutes,
      round(count(*) FILTER (WHERE {RATING} >= 3)::DOUBLE / nullif(count({RATING}), 0), 6) AS accuracy FROM events GROUP BY 1""")
def weekly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.to_date(F.date_trunc("week", F.col("ts").cast("timestamp")))
    return events(spark, sf_dir).groupBy(week.alias("week")).agg(
        F.count("*").alias("reviews"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value") / 60, 4).alias("minutes"),
        F.round(F.try_divide(F.count_if(F.col("rating") >= 3), F.count("rating")), 6).alias("accuracy"))


@query(f"""
    SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(avg(CASE WHEN {RATING} >= 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events GROUP BY 1, 2 HAVING count(*) >= 3""")
def best_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy("user_id", F.hour(F.col("ts").cast("timestamp")).alias("hour"))
    return e.agg(F.count("*").alias("n"), F.round(F.count_if(F.col("rating") >= 3) / F.count("*"), 6).alias("accuracy")).where("n >= 3")


@query("SELECT user_id, count(*) AS milestones, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("milestones"), F.max("ts").alias("last"))
    return e.orderBy(F.desc("milestones"), F.desc("last"), "user_id").limit(10)


@query("""
    WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM documents)
    SELECT word, min(doc_id) AS doc_id FROM w GROUP BY 1 HAVING count(*) = 1""")
def thin_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("word", "doc_id")


@query("""
    SELECT b.bound, count(*) FILTER (WHERE b.bound IS NULL OR value <= b.bound) AS n FROM events, (SELECT unnest([0.5, 1, 2.5, 5, 10, 25, 50, 100, 250, NULL])::DOUBLE AS bound) b GROUP BY 1""")
def cumulative_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cumulative_histogram(table(spark, sf_dir, "events"), "value", [0.5, 1, 2.5, 5, 10, 25, 50, 100, 250])


@query(f"""
    WITH a AS (SELECT user_id, event_type AS category, count(*) AS n, count(*) FILTER (WHERE value > 30) AS correct FROM events WHERE {RATING} IS NOT NULL GROUP BY 1, 2),
    q AS (SELECT user_id, count(*) AS asked FROM events GROUP BY 1)
    SELECT q.user_id, asked, sum(correct)::BIGINT AS correct, round(sum(correct)::DOUBLE / asked, 6) AS score, sum(correct)::DOUBLE / asked >= 0.5 AS passed,
      coalesce(list_sort(list(category) FILTER (WHERE correct::DOUBLE / n >= 0.6)), []) AS strengths, coalesce(list_sort(list(category) FILTER (WHERE correct::DOUBLE / n < 0.5)), []) AS weaknesses
    FROM q LEFT JOIN a ON a.user_id = q.user_id GROUP BY 1, 2""")
def exam_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    a = e.where("rating IS NOT NULL").groupBy("user_id", F.col("event_type").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 30).alias("c"))
    share = F.col("c") / F.col("n")
    per = a.groupBy("user_id").agg(F.sum("c").alias("correct"), F.array_sort(F.collect_list(F.when(share >= 0.6, F.col("category")))).alias("strengths"), F.array_sort(F.collect_list(F.when(share < 0.5, F.col("category")))).alias("weaknesses"))
    score = F.col("correct") / F.col("asked")
    joined = e.groupBy("user_id").agg(F.count("*").alias("asked")).join(per, "user_id", "left")
    return joined.select("user_id", "asked", "correct", F.round(score, 6).alias("score"), (score >= 0.5).alias("passed"), "strengths", "weaknesses")


@query(f"""
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
    l AS (SELECT user_id, avg(value) AS recent FROM e WHERE r <= 5 GROUP BY 1),
    c AS (SELECT user_id, event_type, avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n FROM events GROUP BY 1, 2),
    w AS (SELECT * FROM (VALUES ('click', 0.4), ('view', 0.3), ('purchase', 0.2), ('error', 0.1)) t(event_type, weight)),
    s AS (SELECT u.user_id, sum(weight::DOUBLE * coalesce(acc, 0.5)) AS weighted FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN w LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = w.event_type GROUP BY 1)
    SELECT l.user_id, round(0.4 * least(recent, 100) / 100 + 0.6 * weighted, 6) AS probability FROM l JOIN s ON s.user_id = l.user_id""")
def pass_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = relational.top_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).groupBy("user_id").agg(F.avg("value").alias("recent"))
    weights = {"click": 0.4, "view": 0.3, "purchase": 0.2, "error": 0.1}
    accuracy = [F.coalesce(F.avg(F.when(F.col("event_type") == t, (F.col("value") > 30).cast("double"))), F.lit(0.5)) * w for t, w in weights.items()]
    weighted = e.groupBy("user_id").agg(sum(accuracy[1:], accuracy[0]).alias("weighted"))
    both = last.join(weighted, "user_id")
    return both.select("user_id", F.round(0.4 * F.least("recent", F.lit(100)) / 100 + 0.6 * F.col("weighted"), 6).alias("probability"))


@query("SELECT event_type, substr(md5(string_agg(DISTINCT CAST(user_id AS VARCHAR), '' ORDER BY CAST(user_id AS VARCHAR))), 1, 16) AS source_hash FROM events GROUP BY 1")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.array_sort(F.collect_set(F.col("user_id").cast("string"))).alias("ids"))
    return e.select("event_type", F.substring(F.md5(F.array_join("ids", "")), 1, 16).alias("source_hash"))


@query("""
    SELECT o_custkey AS source, l_suppkey AS target, l_returnflag AS relation, max(l_discount) AS confidence, count(*) AS evidence, list_sort(list(DISTINCT o_orderkey)) AS chunks
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = [F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("relation")]
    return edges.groupBy(*key).agg(F.max("l_discount").alias("confidence"), F.count("*").alias("evidence"), F.array_sort(F.collect_set("o_orderkey")).alias("chunks"))


@query("SELECT source, count(*) AS docs, count(*) FILTER (WHERE text LIKE '%@%') AS missing FROM documents GROUP BY 1 HAVING sum(CASE WHEN text LIKE '%@%' THEN 1 ELSE 0 END) > 0")
def having_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("text").contains("@")).alias("missing"))
    return d.where("missing > 0")


@query("SELECT event_type, count(*) AS runs, round(avg(CASE WHEN value > 25 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(value), 8) AS latency FROM events GROUP BY ROLLUP (event_type)")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").rollup("event_type")
    return e.agg(F.count("*").alias("runs"), F.round(F.count_if(F.col("value") > 25) / F.count("*"), 6).alias("pass_rate"), F.round(F.avg("value"), 8).alias("latency"))


@query("""
    SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed,
      CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 'processing' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') = count(*) THEN 'failed' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'partial' ELSE 'completed' END AS status,
      round(100.0 * count(*) FILTER (WHERE o_orderstatus <> 'O') / count(*), 4) AS percent FROM orders GROUP BY 1""")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(s == "F").alias("completed"), F.count_if(s == "P").alias("failed"))
    open_ = F.col("total") - F.col("completed") - F.col("failed")
    status = F.when(open_ > 0, "processing").when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    return o.select("*", status.alias("status"), F.round(100.0 * (F.col("total") - open_) / F.col("total"), 4).alias("percent"))


@query("""
    WITH k AS (SELECT * FROM (VALUES ('the', 'the'), ('le', 'le'), ('der', 'der'), ('el', 'el'), ('of', 'of'), ('de', 'de')) t(topic, word)),
    s AS (SELECT doc_id, topic, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x = word)) AS hits FROM documents, k),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, topic) AS rank FROM s WHERE hits > 0)
    SELECT doc_id, list(topic ORDER BY rank) AS topics FROM r WHERE rank <= 3 GROUP BY 1""")
def specialty_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    hits = F.array(*(F.struct((-F.size(F.filter("words", ops.equals(w)))).alias("n"), F.lit(w).alias("topic")) for w in ("the", "le", "der", "el", "of", "de")))
    best = F.slice(F.array_sort(F.filter(hits, lambda h: h["n"] < 0)), 1, 3)
    return table(spark, sf_dir, "documents").withColumn("words", words).select("doc_id", F.transform(best, lambda h: h["topic"]).alias("topics")).where(F.size("topics") > 0)


@query("SELECT p_type, list_sort(list(DISTINCT p_brand)) AS brands FROM part GROUP BY 1")
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rank FROM lineitem WHERE l_discount >= 0.05) WHERE rank <= 3")
def top3_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_discount >= 0.05").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    top = relational.top_per_key(lines, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")], 3)
    return top.withColumn("rank", F.col("rank").cast("long"))


@query("""
    WITH r AS (SELECT o.o_orderpriority AS phase, o.o_orderkey, o.o_orderstatus = 'F' AS critical, o.o_totalprice, row_number() OVER (PARTITION BY o.o_orderpriority ORDER BY o.o_orderstatus = 'F' DESC, o.o_totalprice DESC, o.o_orderkey) AS rank FROM orders o)
    SELECT phase, o_orderkey, critical, rank FROM r WHERE rank <= 5""")
def ranked_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("phase"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("critical"), "o_totalprice")
    top = relational.top_per_key(o, ["phase"], [F.desc("critical"), F.desc_nulls_last("o_totalprice"), F.col("o_orderkey")], 5)
    return top.select("phase", "o_orderkey", "critical", F.col("rank").cast("long").alias("rank"))


@query(f"""
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE {RATING} >= 3) AS correct, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, day, round(sum(correct) OVER w / nullif(sum(n) OVER w, 0)::DOUBLE, 6) AS accuracy FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_accuracy_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy("user_id", "day").agg(F.count_if(F.col("rating") >= 3).alias("correct"), F.count("*").alias("n"))
    return d.select("user_id", "day", F.round(ops.rolling_ratio(d, ["user_id"], "day", "correct", "n", 7), 6).alias("accuracy"))


@query("""
    WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE ts < TIMESTAMP '2024-01-16'),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS n FROM d)
    SELECT user_id, count(*) FILTER (WHERE date_diff('day', day, DATE '2024-01-15') = n - 1) AS streak FROM r GROUP BY 1""")
def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.streaks(events(spark, sf_dir), "user_id", "day", F.lit("2024-01-15").cast("date"))


@query("""
    WITH t AS (SELECT doc_id, source, CAST(floor(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) * 1.3) AS INTEGER) AS tokens FROM documents),
    s AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM t)
    SELECT source, doc_id, tokens, spent FROM s WHERE spent <= 4000""")
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", tx.token_estimate(F.col("text")).alias("tokens"))
    return ops.within_budget(d, ["source"], [F.col("doc_id")], "tokens", 4000, F.floor(F.col("doc_id") / 2_000))


@query("""
    WITH s AS (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM conversations)
    SELECT conv_id, turn, spent FROM s WHERE spent <= 600""")
def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 4).alias("tokens"))
    return ops.within_budget(c, ["conv_id"], [F.desc("turn")], "tokens", 600).select("conv_id", "turn", "spent")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.substring("text", 1, 200).alias("p")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""
    SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn, min(event_id) OVER (PARTITION BY event_type) AS kind_first
    FROM events""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id")
    return ops.round_robin(e, "event_type", "event_id", F.floor(F.col("event_id") / 20_000)).select("event_type", "event_id", "turn", "kind_first")


@query("""
    SELECT s.day, count(e.event_id) AS due FROM (SELECT CAST(unnest(range(DATE '2024-01-10', DATE '2024-01-17', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN events e ON CAST(e.ts AS DATE) <= s.day GROUP BY 1""")
def due_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.range(7).select(F.date_add(F.lit("2024-01-10").cast("date"), F.col("id").cast("int")).alias("day"))
    return ops.due_by_day(table(spark, sf_dir, "events"), "ts", days)


@query("SELECT p_partkey, p_name, coalesce(CASE WHEN p_size > 40 THEN NULL ELSE p_size END, 999) AS chapter FROM part ORDER BY 3, p_name, p_partkey LIMIT 50")
def chapter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapter = F.coalesce(F.when(F.col("p_size") <= 40, F.col("p_size")), F.lit(999))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", chapter.alias("chapter")).orderBy("chapter", "p_name", "p_partkey").limit(50)


@query("""
    SELECT event_type, count(*) AS n, round(avg(value), 8) AS mean, min(value) AS least, max(value) AS most, count(*) FILTER (WHERE value >= 80) AS high FROM events GROUP BY 1""")
def confidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(v), 8).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_if(v >= 80).alias("high"))
