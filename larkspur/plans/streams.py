"""Queries of Structured Streaming over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.registry import query
from larkspur.streaming import logs
from larkspur.streaming import recent as live


def _cents() -> list[Column]:
    """Measures that come out the same in any order of rows."""
    return [F.count("*").alias("n"), F.max("value").alias("most"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")]


@query("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS most, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.read_log(spark, f"{sf_dir}/events.parquet")
    out = logs.run_available(logs.tumbling(log, "ts", "6 hours", ["event_type"], _cents()), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS id FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n, max(value) AS most, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM s GROUP BY user_id, id""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.read_log(spark, f"{sf_dir}/events.parquet")
    out = logs.run_available(logs.sessions(log, "ts", "2 hours", ["user_id"], _cents()), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query("SELECT event_id, user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.read_log(spark, f"{sf_dir}/events.parquet")
    twice = log.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return logs.run_available(logs.distinct_recent(twice, "ts", ["event_id"]).select("event_id", "user_id", "event_type"), "append")


@query("""
    WITH e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms FROM events), l AS (SELECT *, lag(ms) OVER w AS before, lag(event_id) OVER w AS was FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
    SELECT user_id, event_id, coalesce(ms - before <= 7200000, FALSE) AS hit, CASE WHEN ms - before <= 7200000 THEN was END AS served FROM l""")
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's event finds the one before it still alive after two hours."""
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.PROVIDER)
    try:
        log = logs.read_log(spark, f"{sf_dir}/events.parquet")
        out = logs.run_available(live.recent(log, "ts", "user_id", "event_id", 2 * 3600 * 1000), "append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "hit", "served")
