"""Queries on time labels, crops, cache keys and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import sources
from tessella.functions import labels, text
from tessella.plans.base import over, register

_P2 = "lpad(CAST(CAST({0} AS BIGINT) AS VARCHAR), 2, '0')"
_MS = "lpad(CAST(CAST({0} AS BIGINT) // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST({0} AS BIGINT) % 1000 AS VARCHAR), 3, '0')"
_WHOLE = "lpad(CAST(CAST({0} AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST({0} AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST({0} AS BIGINT) % 60 AS VARCHAR), 2, '0')"
_TIMES = "SELECT event_id, value * 37.0e0 - 100 + event_id % 3 * 0.00025e0 AS s, event_id % 5 * 17 AS shift FROM events"


@register(
    f"""WITH t AS ({_TIMES}), p AS (SELECT event_id, shift, greatest(0, s) AS c FROM t),
q AS (SELECT *, floor(c / 3600) AS h, floor((c - floor(c / 3600) * 3600) / 60) AS m, floor(c * 1000 + 0.5) AS ms FROM p), r AS (SELECT *, floor((c - h * 3600 - m * 60) * 1000 + 0.5) AS sms FROM q),
w AS (SELECT *, {_WHOLE.format("floor(c)")} AS label FROM r)
SELECT event_id, {_P2.format("h")} || ':' || {_P2.format("m")} || ':' || {_MS.format("sms")} AS precise, {_P2.format("floor(ms / 3600000)")} || ':' || {_P2.format("floor(ms / 60000) % 60")} || ':' || {_MS.format("ms % 60000")} AS carried,
CASE WHEN shift = 0 THEN label ELSE {_WHOLE.format("floor(c) + shift")} END AS shifted, CASE WHEN len(ltrim(label, '0')) = 8 THEN label ELSE lpad(ltrim(label, '0:'), 8, '0') END AS padded FROM w"""
)
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, _TIMES, "events")
    label = text.clock_label(F.col("s"))
    short = F.concat(F.regexp_replace(label, r"^[0:]+(?=.)", ""), F.lit(".250"))
    return rows.select(
        "event_id",
        labels.precise_label(F.col("s")).alias("precise"),
        labels.carried_label(F.col("s")).alias("carried"),
        labels.shifted_label(label, F.col("shift")).alias("shifted"),
        F.when(F.length(short) - 4 == 8, label).otherwise(labels.padded_label(F.when(short == "0.250", ".250").otherwise(short))).alias("padded"),
    )


_KEYS = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'auto' WHEN 1 THEN '1,2,3' WHEN 2 THEN '-1,2,3,4' ELSE concat_ws(',', CAST(event_id % 90 AS VARCHAR(9)), CAST(event_id % 70 AS VARCHAR(9)), CAST(100 + event_id % 50 AS VARCHAR(9)), '64') END AS roi,
CASE event_id % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN '512' WHEN 2 THEN '384px/webp' WHEN 3 THEN 'x/jpeg' WHEN 4 THEN concat('1024/png/roi=1,2,', CAST(event_id AS VARCHAR(9)), 'x4') ELSE '768/jpeg/a/b' END AS cache_key, event_id % 3 * 256 + 256 AS resolution FROM events"""


@register(
    rf"""WITH k AS ({_KEYS}), c AS (SELECT *, regexp_matches(roi, '^\d+,\d+,\d+,\d+$') AS fit, string_split(roi, ',') AS p, string_split(cache_key, '/') AS q FROM k)
SELECT event_id, CASE WHEN fit THEN CAST(p[1] AS INT) END AS x, CASE WHEN fit THEN CAST(p[4] AS INT) END AS h, CASE WHEN fit THEN 'roi=' || p[1] || ',' || p[2] || ',' || p[3] || 'x' || p[4] ELSE '' END AS bucket,
CAST(resolution AS VARCHAR) || '/webp' || CASE WHEN fit THEN '/roi=' || p[1] || ',' || p[2] || ',' || p[3] || 'x' || p[4] ELSE '' END AS new_key,
CASE WHEN len(q) > 1 THEN TRY_CAST(regexp_extract(q[1], '^\d+') AS INT) END AS key_resolution, CASE WHEN len(q) > 1 AND regexp_matches(q[1], '^\d') THEN q[2] END AS key_format, CASE WHEN len(q) > 1 AND regexp_matches(q[1], '^\d') THEN array_to_string(q[3:], '/') END AS key_bucket FROM c"""
)
def crop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, _KEYS, "events").withColumns({"crop": labels.crop_of(F.col("roi")), "parts": labels.cache_key_parts(F.col("cache_key"))})
    bucket = labels.crop_bucket(F.col("crop"))
    return rows.select(
        "event_id", "crop.x", "crop.h", bucket.alias("bucket"), labels.cache_key(F.col("resolution"), F.lit("webp"), bucket).alias("new_key"),
        F.col("parts.resolution").alias("key_resolution"), F.col("parts.format").alias("key_format"), F.col("parts.bucket").alias("key_bucket"),
    )


@register("SELECT page_id, substr(sha256(encode(html[1:262144]) || encode(CAST(strlen(html) AS VARCHAR)) || encode(CASE WHEN page_id % 4 > 0 THEN CAST(CAST(floor(page_id % 100 * 0.0625e0 * 1000 + 0.5) AS BIGINT) AS VARCHAR) ELSE '' END)), 1, 12) AS fingerprint FROM pages")
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    duration = F.when(F.col("page_id") % 4 > 0, (F.col("page_id") % 100) * 0.0625)
    return sources.table(spark, sf_dir, "pages").select("page_id", labels.fingerprint(F.col("html"), F.octet_length("html"), duration).alias("fingerprint"))


_NAMES = """SELECT event_id, concat('00:0', CAST(event_id % 10 AS VARCHAR(9)), ':59') AS label, CASE event_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'WEBP' WHEN 2 THEN 'mp3' WHEN 3 THEN 'aiff' ELSE 'jpg' END AS ext,
CASE event_id % 6 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25/1' WHEN 2 THEN '24' WHEN 3 THEN '' WHEN 4 THEN '15/0' ELSE '60/2' END AS rate, value / 12 AS gb, CASE event_id % 4 WHEN 0 THEN ' #a0B1c2 ' WHEN 1 THEN 'cream' WHEN 2 THEN 'fff' ELSE '#12' END AS colour, 640 + event_id % 3 * 640 AS w, 360 + event_id % 4 * 360 AS h FROM events"""


@register(
    f"""WITH n AS ({_NAMES}) SELECT event_id, replace(label, ':', '-') || '.' || ext AS file, CASE lower(ext) WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' ELSE 'image/jpeg' END AS image_type,
CASE lower(ext) WHEN 'mp3' THEN 'audio/mp3' WHEN 'aiff' THEN 'audio/aiff' ELSE 'audio/wav' END AS sound_type, CAST(CASE rate WHEN '25/1' THEN 25 WHEN '24' THEN 24 WHEN '15/0' THEN 15 ELSE 30 END AS BIGINT) AS fps,
CASE WHEN gb < 4 THEN 'tiny' WHEN gb < 8 THEN 'small' WHEN gb < 16 THEN 'large-v3-turbo' ELSE 'large-v3' END AS model, regexp_matches(trim(colour), '^#?[0-9a-fA-F]{{3,8}}$') AS is_colour,
CASE WHEN w % 640 = 0 AND w / 640 = h / 360 THEN CAST(w / 640 AS INT) END AS scale, CAST(ceil(gb * 30) AS BIGINT) AS n_frames FROM n"""
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, _NAMES, "events")
    file = labels.frame_file(F.col("label"), F.col("ext"))
    return rows.select(
        "event_id", file.alias("file"), labels.media_type(file, labels.IMAGE_TYPES, "image/jpeg").alias("image_type"), labels.media_type(file, labels.SOUND_TYPES, "audio/wav").alias("sound_type"),
        labels.whole_fps(F.col("rate")).alias("fps"), labels.speech_model(F.col("gb")).alias("model"), labels.is_colour(F.col("colour")).alias("is_colour"),
        labels.stage_scale(F.col("w"), F.col("h"), F.lit(640), F.lit(360)).alias("scale"), F.ceil(F.col("gb") * 30).alias("n_frames"),
    )


_URLS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.youtube.com/watch?v=1' WHEN 1 THEN 'http://youtu.be/2' WHEN 2 THEN 'ftp://youtube.com/3' WHEN 3 THEN 'not a url' WHEN 4 THEN 'https://youtube.com.example.org/' ELSE url END AS url FROM pages"


@register(f"WITH u AS ({_URLS}) SELECT page_id, regexp_matches(url, '^https?://((www|m|music)\\.)?(youtube\\.com|youtu\\.be)(/|$)') AND NOT url LIKE '%www.youtu.be%' AS is_video FROM u")
def video_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, _URLS, "pages").select("page_id", labels.is_video_host(F.col("url")).alias("is_video"))
