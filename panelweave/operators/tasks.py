"""Batch analytics over task events: depths, streaks, leases, retries and cache use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BREAK_AT = 3


def failure_streaks(events: DataFrame, break_at: int = BREAK_AT) -> DataFrame:
    """Failures with their place in the lane's run of equal codes; completion or reopening ends a run. paused: the run is long enough."""
    lane = Window.partitionBy("lane").orderBy("ts", "event_id")
    moves = events.filter(F.col("kind").isin("fail", "complete", "reopen"))
    code = F.when(F.col("kind") == "fail", F.col("code"))
    turn = ~(F.col("is_fail") & code.eqNullSafe(F.lag(code).over(lane)) & F.coalesce(F.lag("is_fail").over(lane), F.lit(False)))
    runs = moves.withColumn("is_fail", F.col("kind") == "fail").withColumn("turn", turn.cast("int")).withColumn("run", F.sum("turn").over(lane)).filter("is_fail")
    streak = F.row_number().over(Window.partitionBy("lane", "run").orderBy("ts", "event_id"))
    return runs.select("lane", "event_id", F.col("code").alias("code"), streak.cast("bigint").alias("streak")).withColumn("paused", F.col("streak") >= break_at)


def latest_states(events: DataFrame) -> DataFrame:
    """Each lane's last event and number of events."""
    return events.groupBy("lane").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("state"), F.max("event_id").alias("last_event"), F.count("*").alias("events"))


def queue_metrics(events: DataFrame) -> DataFrame:
    """By project: counts by kind, and the share of failures that repeat a (lane, code) before."""
    counts = events.groupBy("project_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("add", "claim", "complete", "fail", "reopen")))
    repeats = events.filter("kind = 'fail'").groupBy("project_id", "lane", "code").count().groupBy("project_id").agg(F.sum(F.col("count") - 1).alias("repeats"))
    joined = counts.join(repeats, "project_id", "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    return joined.withColumn("repeat_rate", F.round(F.coalesce(F.try_divide("repeats", "n_fail"), F.lit(0.0)), 6))


def cache_use(events: DataFrame) -> DataFrame:
    """Hits, misses and hit rate by key, and in all (null key)."""
    views = events.filter("kind = 'claim'").withColumn("hit", (F.col("value") > 100).cast("int"))
    return views.rollup("cache_key").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses")).withColumn("hit_rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))


def overlapping_leases(events: DataFrame, hours: int = 6) -> DataFrame:
    """Claims that start before an earlier claim of the lane has ended."""
    lane = Window.partitionBy("lane").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    claims = events.filter("kind = 'claim'").withColumn("ends", F.col("ts") + F.expr(f"interval {hours} hours"))
    return claims.withColumn("held_to", F.max("ends").over(lane)).filter("ts < held_to").select("lane", "event_id")


def failures_by_code(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'fail'").groupBy("project_id", "code").agg(F.count("*").alias("failures"), F.countDistinct("lane").alias("lanes"))
