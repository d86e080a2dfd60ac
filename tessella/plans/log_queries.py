"""Queries that read log and subtitle texts. Their SQL states the values that the texts were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import sources
from tessella.operators import signals
from tessella.plans.base import register
from tessella.sources import logs

_E = "e AS (SELECT event_id AS series_id, CAST(floor(value) AS DOUBLE) AS k, CAST(event_id % 7 AS DOUBLE) AS j FROM events)"


@register(f"WITH {_E} SELECT series_id, j + 0.25 AS t, k + 0.5 AS score FROM e UNION ALL SELECT series_id, j + 2.75, k + 3.5 FROM e")
def log_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.scene_scores(sources.media_logs(spark, sf_dir))


@register(f"WITH {_E} SELECT series_id, CAST(1 AS BIGINT) AS cluster, j + 2.75 AS t, k + 3.5 AS score, CAST(2 AS BIGINT) AS n_rows FROM e")
def log_scene_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.session_clusters(logs.scene_scores(sources.media_logs(spark, sf_dir)), 2.5)


@register(f"WITH {_E} SELECT series_id, j + 0.5 AS t, j AS score FROM e WHERE j >= 2")
def log_scenes_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.scene_scores_by_line(sources.media_logs(spark, sf_dir))


@register(f"WITH {_E} SELECT series_id, j AS start_s, j + 2.5 AS end_s, CAST(2.5 AS DOUBLE) AS duration_s FROM e")
def log_black_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.black_spans(sources.media_logs(spark, sf_dir))


@register(f"WITH {_E} SELECT series_id, j + 0.5 AS start_s, j + 1.75 AS end_s, CAST(1.25 AS DOUBLE) AS duration_s FROM e UNION ALL SELECT series_id, j + 4.125, j + 4.125, 0.0 FROM e")
def log_silence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.silence_spans(sources.media_logs(spark, sf_dir))


@register(f"WITH {_E} SELECT series_id, j + 1 AS start_s, j + 3.5 AS end_s, CAST(2.5 AS DOUBLE) AS duration_s FROM e")
def log_freeze_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.freeze_spans(sources.media_logs(spark, sf_dir))


@register(f"WITH {_E} SELECT series_id, k + 1 AS si, j + 1 AS ti FROM e")
def log_motion_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.motion_means(sources.media_logs(spark, sf_dir))


@register(f"WITH {_E} SELECT series_id, j + 0.5 AS t, k + 0.25 AS blur FROM e UNION ALL SELECT series_id, j + 1.5, k + 1.25 FROM e")
def log_frame_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.frame_blur(sources.media_logs(spark, sf_dir))


@register(
    f"""WITH {_E} SELECT series_id, j + 0.5 AS t, k AS brightness, j - 8 AS u, CAST(-3.0 AS DOUBLE) AS v, sqrt((j - 8) * (j - 8) + 9) AS saturation FROM e
UNION ALL SELECT series_id, j + 1.5, k + 1, NULL, NULL, NULL FROM e"""
)
def log_frame_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.frame_colours(sources.media_logs(spark, sf_dir))


@register(f"WITH {_E} SELECT series_id, -k - 0.5 AS mean_lufs, j + 0.5 AS range_lu FROM e")
def log_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.loudness(sources.media_logs(spark, sf_dir))


@register(
    f"""WITH {_E}, c AS (SELECT series_id, CAST(j + 1 AS INT) AS x, CAST(k AS INT) AS y, CAST(k + 50 AS INT) AS w, CAST(j + 150 AS INT) AS h FROM e)
SELECT series_id, x, y, w, h, floor(w * h / 64000.0 * 1000 + 0.5) / 10.0 AS area_pct FROM c WHERE NOT (w >= 304 AND h >= 190)"""
)
def log_crop_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.crop_box(sources.media_logs(spark, sf_dir), 320, 200)


@register(
    """WITH e AS (SELECT event_id AS series_id, event_type, CAST(event_id % 50 AS DOUBLE) AS m, CAST(event_id % 50 AS VARCHAR) AS s FROM events)
SELECT series_id, 0 AS seq, m * 60 + 1 AS start_s, m * 60 + 3 AS end_s, event_type || ' < ' || s AS text FROM e
UNION ALL SELECT series_id, 1, m * 60 + 5, m * 60 + 9, '"' || s || '"' FROM e"""
)
def subtitle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A label without hours has minutes and seconds alone: 'MM:SS.mmm'.
    return logs.subtitles(sources.subtitle_texts(spark, sf_dir))


@register(
    """WITH e AS (SELECT event_id AS series_id, event_id % 3 AS m, CAST(event_id % 50 AS DOUBLE) AS s, event_type FROM events)
SELECT series_id, 0 AS seq, s AS start_s, s + 2 AS end_s, event_type AS text FROM e WHERE m = 0
UNION ALL SELECT series_id, 0, s, s + 61, event_type FROM e WHERE m = 1
UNION ALL SELECT series_id, 0, 0.0, 0.0, event_type || ' [' || CAST(CAST(s AS INT) AS VARCHAR) || ']' FROM e WHERE m = 2"""
)
def speech_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = "CAST(event_id % 50 AS STRING)"
    by_form = (
        f"""CASE event_id % 3 WHEN 0 THEN concat('{{"segments": [{{"start": ', {s}, '.5, "to": ', CAST(event_id % 50 + 2 AS STRING), '.75, "text": " ', event_type, ' "}}]}}')
WHEN 1 THEN concat('\\n[00:00:', lpad({s}, 2, '0'), '.120 --> 00:01:', lpad(CAST(event_id % 50 + 1 AS STRING), 2, '0'), '.900]  ', event_type, '\\nnoise') ELSE concat(' ', event_type, ' [', {s}, ']\\n') END"""
    )
    return logs.speech_segments(sources.table(spark, sf_dir, "events").select(F.col("event_id").alias("series_id"), F.expr(by_form).alias("content")))
