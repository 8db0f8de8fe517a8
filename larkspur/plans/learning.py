"""Queries of learning analytics; events stand for reviews, event types for ratings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import learning as ops
from larkspur.plans.analytics import RATING, events
from larkspur.plans.registry import query, table


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated events with a stability and the days since the review."""
    e = events(spark, sf_dir).where("rating IS NOT NULL")
    return e.withColumns({"stability": 0.5 + F.col("value") / 10, "days": F.datediff(F.lit("2024-02-10").cast("date"), "day")})


_REVIEWS = f"r AS (SELECT *, {RATING} AS rating, 0.5::DOUBLE + value / 10 AS stability, date_diff('day', CAST(ts AS DATE), DATE '2024-02-10') AS days FROM events WHERE {RATING} IS NOT NULL)"


@query(f"WITH {_REVIEWS} SELECT event_id, round(pow(1 + days / (9 * stability), -1), 6) AS recall FROM r")
def fsrs_retrievability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select("event_id", F.round(ops.retrievability(F.col("days"), F.col("stability")), 6).alias("recall"))


@query(f"WITH {_REVIEWS} SELECT event_id, greatest(1, least(365, CAST(round_even(9 * stability * (1 / 0.9::DOUBLE - 1), 0) AS INTEGER))) AS days FROM r")
def fsrs_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select("event_id", ops.interval(F.col("stability")).alias("days"))


@query(f"""
    WITH {_REVIEWS}, d AS (SELECT event_id, rating, stability AS s, least(10, greatest(1, 4.93::DOUBLE - (rating - 3) * 0.94::DOUBLE)) AS d, pow(1 + days / (9 * stability), -1) AS q FROM r)
    SELECT event_id, round(least(10, greatest(1, 0.01::DOUBLE * 4.93::DOUBLE + 0.99::DOUBLE * (d - 0.86::DOUBLE * (rating - 3)))), 6) AS difficulty,
      round(CASE WHEN rating = 1 THEN greatest(0.1::DOUBLE, 2.18::DOUBLE * pow(d, -0.05::DOUBLE) * (pow(s + 1, 0.34::DOUBLE) - 1) * exp((1 - q) * 1.26::DOUBLE))
      ELSE greatest(0.1::DOUBLE, s * (1 + exp(1.49::DOUBLE) * (11 - d) * pow(s, -0.14::DOUBLE) * (exp((1 - q) * 0.94::DOUBLE) - 1) * CASE rating WHEN 2 THEN 0.29::DOUBLE WHEN 4 THEN 2.61::DOUBLE ELSE 1 END)) END, 5) AS stability FROM d""")
def fsrs_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).withColumn("d", ops.first_difficulty(F.col("rating"))).withColumn("q", ops.retrievability(F.col("days"), F.col("stability")))
    s, d, q, g = F.col("stability"), F.col("d"), F.col("q"), F.col("rating")
    after = F.when(g == 1, ops.stability_after_lapse(s, d, q)).otherwise(ops.stability_after_success(s, d, q, g))
    return r.select("event_id", F.round(ops.next_difficulty(d, g), 6).alias("difficulty"), F.round(after, 5).alias("stability"))


@query()
def fsrs_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory of each user's card k % 10 after all reviews."""
    card = (F.get_json_object("props", "$.k").cast("int") % 10).alias("card")
    r = reviews(spark, sf_dir).select("user_id", card, "ts", "event_id", "rating", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("at"))
    return ops.memory(r, ["user_id", "card"], ["ts", "event_id"], "rating", "at")


_ITEMS = "i AS (SELECT p_partkey, 0.5::DOUBLE + p_size / 50.0::DOUBLE AS a, (p_retailprice - 950) / 50 AS b, 0.2::DOUBLE AS c FROM part)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (0.5 + F.col("p_size") / 50.0).alias("a"), ((F.col("p_retailprice") - 950) / 50).alias("b"), F.lit(0.2).alias("c"))


@query(f"WITH {_ITEMS}, p AS (SELECT *, c + (1 - c) / (1 + exp(-a * (0.5::DOUBLE - b))) AS p FROM i) SELECT p_partkey, round(p, 6) AS p, round(CASE WHEN p > c AND p < 1 THEN a * a * pow(p - c, 2) * (1 - p) / (pow(1 - c, 2) * p) ELSE 0 END, 6) AS information FROM p")
def irt_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("p", ops.probability(F.lit(0.5), F.col("a"), F.col("b"), F.col("c")))
    return i.select("p_partkey", F.round("p", 6).alias("p"), F.round(ops.information(F.col("p"), F.col("a"), F.col("c")), 6).alias("information"))


@query(f"""
    WITH {_ITEMS}, p AS (SELECT *, c + (1 - c) / (1 + exp(-a * (0.5::DOUBLE - b))) AS p FROM i), f AS (SELECT p_partkey % 7 AS grp, CASE WHEN p > c AND p < 1 THEN a * a * pow(p - c, 2) * (1 - p) / (pow(1 - c, 2) * p) ELSE 0 END AS x FROM p)
    SELECT grp, round(1 / sqrt(sum(x)), 6) AS error FROM f GROUP BY 1""")
def irt_standard_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("p", ops.probability(F.lit(0.5), F.col("a"), F.col("b"), F.col("c")))
    total = F.sum(ops.information(F.col("p"), F.col("a"), F.col("c")))
    return i.groupBy((F.col("p_partkey") % 7).alias("grp")).agg(F.round(ops.standard_error(total), 6).alias("error"))


@query(f"WITH {_ITEMS}, p AS (SELECT *, c + (1 - c) / (1 + exp(-a * (0.5::DOUBLE - b))) AS p FROM i) SELECT p_partkey, round(a * a * pow(p - c, 2) * (1 - p) / (pow(1 - c, 2) * p) + 0.1::DOUBLE * (p_partkey % 5), 6) AS value FROM p ORDER BY 2 DESC, 1 LIMIT 5")
def next_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("p", ops.probability(F.lit(0.5), F.col("a"), F.col("b"), F.col("c")))
    value = F.round(ops.information(F.col("p"), F.col("a"), F.col("c")) + 0.1 * (F.col("p_partkey") % 5), 6)
    return i.select("p_partkey", value.alias("value")).orderBy(F.desc("value"), "p_partkey").limit(5)


_FOLD = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, (CAST(json_extract_string(props, '$.k') AS INTEGER) - 50) / 25.0::DOUBLE AS b, value > 30 AS correct FROM events),
    f AS (SELECT user_id, 0::BIGINT AS k, 0.0::DOUBLE AS ability FROM e GROUP BY 1
      UNION ALL SELECT e.user_id, e.k, greatest(-3.0::DOUBLE, least(3.0::DOUBLE, f.ability + 0.3::DOUBLE * CASE WHEN e.correct
        THEN (1 - p(f.ability, e.b)) * (p(f.ability, e.b) - 0.25::DOUBLE) / (p(f.ability, e.b) * 0.75::DOUBLE) ELSE -(p(f.ability, e.b) - 0.25::DOUBLE) / ((1 - p(f.ability, e.b)) * 0.75::DOUBLE) END - 0.1::DOUBLE * f.ability))
      FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)"""
_CHANCE = re.compile(r"p\(f\.ability, e\.b\)")
_FOLD = _CHANCE.sub("(0.25::DOUBLE + 0.75::DOUBLE / (1 + exp(-(f.ability - e.b))))", _FOLD)


@query(f"{_FOLD} SELECT user_id, round(arg_max(ability, k), 6) AS ability, max(k)::INTEGER AS answers FROM f GROUP BY 1")
def ability_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ability of each user after all answers, in order."""
    return answered(spark, sf_dir).withColumn("ability", F.round("ability", 6))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    answers = e.select("user_id", "event_id", F.lit(1.0).alias("a"), ((k - 50) / 25.0).alias("b"), F.lit(0.25).alias("c"), (F.col("value") > 30).alias("correct"))
    return ops.abilities(answers, "user_id", "event_id")


@query("""
    WITH s AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS session, unnest([1, 3, 7, 14, 30, 60, 120]) AS days)
    SELECT user_id, session, CAST(first + CAST(greatest(1, floor(days * 90 / 180)) AS INTEGER) AS DATE) AS due FROM (SELECT user_id, min(CAST(ts AS DATE)) AS first FROM events GROUP BY 1), s""")
def schedule_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = events(spark, sf_dir).groupBy("user_id").agg(F.min("day").alias("first"))
    return ops.schedule(first, "first", F.lit(90)).select("user_id", "session", "due")


@query(f"WITH {_REVIEWS} SELECT event_id FROM r WHERE pow(1 + days / (9 * stability), -1) < 0.80")
def session_card_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.session_cards(reviews(spark, sf_dir), 5, F.col("days"), F.col("stability")).select("event_id")


@query(f"""
    WITH {_REVIEWS}, t AS (SELECT unnest([event_type, 'csp_' || (event_id % 3)]) AS tag, pow(1 + days / (9 * stability), -1) AS recall FROM r)
    SELECT tag, round(avg(recall), 8) AS mean FROM t GROUP BY 1 HAVING avg(recall) < 0.65""")
def focus_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.col("event_type"), F.concat(F.lit("csp_"), F.col("event_id") % 3))
    r = reviews(spark, sf_dir).withColumns({"tags": tags, "recall": ops.retrievability(F.col("days"), F.col("stability"))})
    return ops.weak_tags(r, "tags", "recall", 0.65).select("tag", F.round("mean", 8).alias("mean"))


@query(f"""
    WITH u AS (SELECT user_id, count(*) AS n, avg({RATING}) AS score FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN n >= 75 AND score >= 2.6 THEN 3 WHEN n >= 60 THEN 2 ELSE 1 END AS level, round(least(0.95, 0.5 + least(0.3, 0.05 * n) + 0.1 * (score - 2)), 6) AS retention FROM u""")
def mastery_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("rating").alias("score"))
    level = F.when((F.col("n") >= 75) & (F.col("score") >= 2.6), 3).when(F.col("n") >= 60, 2).otherwise(1)
    return u.select("user_id", level.alias("level"), F.round(ops.predicted_retention(F.col("n"), F.col("score")), 6).alias("retention"))


@query("""
    WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), m AS (SELECT user_id, 'reviews_50' AS milestone FROM u WHERE n >= 50 UNION ALL SELECT user_id, 'reviews_75' FROM u WHERE n >= 75)
    SELECT * FROM m WHERE NOT (user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 200) AND milestone = 'reviews_50')""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u = e.groupBy("user_id").agg(F.count("*").alias("n"))
    reached = [F.when(F.col("n") >= n, F.lit(f"reviews_{n}")) for n in (50, 75)]
    new = u.select("user_id", F.explode(F.array_compact(F.array(*reached))).alias("milestone"))
    had = e.where("event_type = 'signup' AND value > 200").select("user_id").distinct().withColumn("milestone", F.lit("reviews_50"))
    return new.join(had, ["user_id", "milestone"], "left_anti")


@query("SELECT event_id, CAST(floor(value * CASE event_id % 4 + 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 WHEN 3 THEN 1.0 ELSE 1.25 END) AS INTEGER) AS days FROM events")
def schedule_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ops.rescaled(F.col("value"), F.col("event_id") % 4 + 1).alias("days"))


@query(f"SELECT user_id, round(coalesce(avg(pow(1 + days / (9 * stability), -1)), 0.5), 8) AS retention FROM (WITH {_REVIEWS} SELECT * FROM r) GROUP BY 1")
def retention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).groupBy("user_id")
    return r.agg(F.round(F.coalesce(F.avg(ops.retrievability(F.col("days"), F.col("stability"))), F.lit(0.5)), 8).alias("retention"))


_TAIL = "0.3989422804014327 * exp(-z * z / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"
_TAIL = re.sub(r"-?\d+\.\d+", lambda m: f"({m[0]}::DOUBLE)", _TAIL)


@query(f"{_FOLD}, z AS (SELECT user_id, arg_max(ability, k) AS z FROM f GROUP BY 1), t AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z) SELECT user_id, round(100 * CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END, 6) AS percentile FROM t")
def ability_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's ability stands in a normal population."""
    return answered(spark, sf_dir).select("user_id", F.round(ops.normal_percentile(F.col("ability")), 6).alias("percentile"))


@query()
def load_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due days of each user's cards with the peaks moved to later days."""
    e = events(spark, sf_dir).withColumn("stability", F.col("value"))
    return ops.balanced(e, "user_id", "event_id", "day", "stability")


@query("SELECT event_id, round(CASE WHEN value > 80 THEN 3.0 WHEN value > 40 THEN 2.0 WHEN value > 20 THEN 1.5 ELSE 1.1 END * CASE WHEN event_id % 10 < 5 THEN 2 - (event_id % 10) / 10.0::DOUBLE ELSE 1 END, 6) AS multiplier FROM events")
def risk_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    bleeding = F.when(F.col("value") > 80, 3.0).when(F.col("value") > 40, 2.0).when(F.col("value") > 20, 1.5).otherwise(1.1)
    seen = (F.col("event_id") % 10) / 10.0
    return table(spark, sf_dir, "events").select("event_id", F.round(bleeding * F.when(seen < 0.5, 2 - seen).otherwise(1.0), 6).alias("multiplier"))
