"""Batch runs of the windows that streams use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import sources
from tessella.operators import signals
from tessella.plans.base import over, register
from tessella.streaming import frames


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("score"))


def _told(made: DataFrame) -> DataFrame:
    return made.select("series_id", F.unix_micros("start").alias("start_us"), "n_rows", "mean", "best")


@register("SELECT user_id AS series_id, epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, count(*) AS n_rows, avg(value) AS mean, max(value) AS best FROM events GROUP BY 1, 2")
def event_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(frames.tiles(_samples(spark, sf_dir), "6 hours", "1 day"))


@register(
    """SELECT user_id AS series_id, epoch_us(time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01')) - k * 7200000000 AS start_us, count(*) AS n_rows, avg(value) AS mean, max(value) AS best FROM events, (SELECT unnest(range(3)) AS k) GROUP BY 1, 2"""
)
def event_sliding_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(frames.sliding_means(_samples(spark, sf_dir), "6 hours", "2 hours", "1 day"))


_HOT = "SELECT user_id AS series_id, ts AS moment, value > 60 AS hot, value FROM events"


@register(
    f"""WITH s AS (SELECT series_id, epoch_us(moment) AS us, hot, value FROM ({_HOT})), g AS (SELECT *, us - last_value(CASE WHEN hot THEN us END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, lag(hot) OVER w AS before FROM s WINDOW w AS (PARTITION BY series_id ORDER BY us, hot DESC, value)),
r AS (SELECT *, sum(CASE WHEN gap <= CASE WHEN before THEN 259200000000 ELSE 43200000000 END THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY us, value ROWS UNBOUNDED PRECEDING) AS run FROM g WHERE hot)
SELECT series_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_hot, max(value) AS peak FROM r GROUP BY series_id, run HAVING max(us) - min(us) >= 3600000000"""
)
def event_hot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, _HOT, "events").withColumn("at", F.col("moment").cast("timestamp"))
    return signals.hot_runs(rows, join_s=12 * 3600.0, idle_s=72 * 3600.0, least_s=3600.0)
