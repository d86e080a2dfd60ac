"""Queries on ordered rules: classes, decisions, captions, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import sources
from tessella.functions import rules
from tessella.plans.base import register

_ASSETS = """SELECT event_id AS series_id, CAST(floor(value) AS DOUBLE) AS si, CASE WHEN event_id % 11 > 0 THEN CAST(event_id * 13 % 80 AS DOUBLE) END AS ti,
CASE WHEN event_id % 17 > 0 THEN CAST(event_id * 29 % 90 AS DOUBLE) END AS subj_ti, event_id * 7 % 50 AS scenes_count, CAST(event_id % 5 * 30 AS DOUBLE) AS duration_s, event_id * 3 % 7 AS outliers_count,
CASE event_id % 4 WHEN 0 THEN 'cc' WHEN 1 THEN 'cropdetect-fallback' WHEN 2 THEN 'center-prior' END AS bbox_method, CASE WHEN event_id % 9 > 0 THEN CAST(event_id * 31 % 101 AS DOUBLE) END AS bbox_area_pct,
CASE WHEN event_id % 6 > 0 THEN event_id % 10 / CAST(10 AS DOUBLE) END AS bbox_confidence, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS low_confidence, event_id % 2 = 0 AS has_speech, event_type, value FROM events"""


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ASSETS.replace("FROM events", "FROM {events}"), events=sources.table(spark, sf_dir, "events"))


_TERMS = ", ".join(f"{sql} AS {name}" for name, sql in rules.CLASS_TERMS.items())
_RULES = "SELECT series_id, {} AS content_class, {} AS rule FROM terms".format(*("CASE " + " ".join(f"WHEN {r[2]} THEN '{r[k]}'" for r in rules.CLASS_RULES) + " ELSE 'generic' END" for k in (1, 0)))


@register(f"WITH assets AS ({_ASSETS}), terms AS (SELECT series_id, {_TERMS} FROM assets) {_RULES}")
def content_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(_assets(spark, sf_dir))


@register(f"WITH assets AS ({_ASSETS}) SELECT series_id, (ti IS NOT NULL AND ti > 20) OR (subj_ti IS NOT NULL AND subj_ti > 15) AS has_motion FROM assets")
def motion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assets(spark, sf_dir).select("series_id", rules.has_motion(F.col("ti"), F.col("subj_ti")).alias("has_motion"))


@register(
    f"""WITH assets AS ({_ASSETS}), seen AS (SELECT *, CASE WHEN event_type IN ('click', 'error') THEN 'nature' ELSE '' END AS content_class, CASE event_type WHEN 'error' THEN 'still, high motion' END AS content_profile, ti > 60 AS has_motion FROM assets),
auto AS (SELECT *, content_class NOT IN ('', 'nature', 'generic') OR coalesce(content_profile LIKE '%high motion%', false) OR scenes_count / greatest(1, duration_s) > 0.3 OR coalesce(has_motion, false) OR outliers_count > 0 OR coalesce(bbox_area_pct < 30, false) AS suggested FROM seen)
SELECT series_id, suggested,
CASE WHEN low_confidence IS NOT NULL THEN 'explicit' WHEN suggested THEN 'auto' WHEN has_speech THEN 'config' ELSE 'default' END AS narrative_source,
CASE WHEN low_confidence IS NOT NULL THEN low_confidence ELSE suggested OR has_speech END AS narrative_on,
CASE WHEN event_type = 'view' THEN 'default' WHEN low_confidence IS NOT NULL THEN 'explicit' WHEN has_speech AND scenes_count >= 1 AND duration_s > 4 THEN 'config' ELSE 'default' END AS adaptive_source,
CASE WHEN event_type = 'view' THEN false WHEN low_confidence IS NOT NULL THEN low_confidence ELSE has_speech AND scenes_count >= 1 AND duration_s > 4 END AS adaptive_on FROM auto"""
)
def mode_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assets(spark, sf_dir).withColumns(
        {
            "content_class": F.when(F.col("event_type").isin("click", "error"), "nature").otherwise(""),
            "content_profile": F.when(F.col("event_type") == "error", "still, high motion"),
            "has_motion": F.col("ti") > 60,
        }
    )
    asked, configured = F.col("low_confidence"), F.col("has_speech")
    rows = rows.withColumn("suggested", rules.suggests_narrative())
    narrative = rules.decide_narrative(asked, F.col("suggested"), configured)
    adaptive = rules.decide_adaptive(asked, F.col("scenes_count"), F.col("duration_s"), F.col("event_type") == "view", configured)
    return rows.select("series_id", "suggested", narrative["source"].alias("narrative_source"), narrative["on"].alias("narrative_on"), adaptive["source"].alias("adaptive_source"), adaptive["on"].alias("adaptive_on"))


@register(
    f"""WITH assets AS ({_ASSETS}) SELECT series_id,
CASE WHEN low_confidence IS NULL OR NOT low_confidence THEN 'missing' WHEN outliers_count = 0 THEN 'empty' WHEN event_type = 'click' THEN 'automatic'
WHEN duration_s >= 30 AND si / duration_s < 0.5 THEN 'short' WHEN duration_s > 0 AND si > duration_s * 1.2 THEN 'overlong' END AS refusal,
CASE WHEN has_speech THEN -value / 10 < -30 ELSE -value / 10 < -33 END AS too_quiet FROM assets"""
)
def caption_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("event_type") == "click", "automatic_captions").otherwise("subtitles")
    refusal = rules.caption_refusal(F.col("low_confidence"), F.col("outliers_count"), source, F.col("si"), F.col("duration_s"))
    quiet = rules.too_quiet(-F.col("value") / 10, F.when(F.col("has_speech"), "lufs").otherwise("dbfs"))
    return _assets(spark, sf_dir).select("series_id", refusal.alias("refusal"), quiet.alias("too_quiet"))


@register("SELECT event_id AS series_id, greatest(0, floor(value - 100)) AS start_s, greatest(0, floor(value + 50.0 - 100)) AS end_s FROM events WHERE value + 50.0 >= 100 AND value <= 300")
def caption_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.table(spark, sf_dir, "events").select(F.col("event_id").alias("series_id"), F.col("value").alias("start_s"), (F.col("value") + 50.0).alias("end_s"))
    return rules.caption_slice(rows, 100.0, 300.0)


@register(
    """WITH b AS (SELECT o_orderkey AS series_id, CAST(320 + o_orderkey % 700 AS BIGINT) AS fw, CAST(240 + o_orderkey % 500 AS BIGINT) AS fh FROM orders),
c AS (SELECT *, CAST(floor(fw * 0.6e0) AS BIGINT) AS w, CAST(floor(fh * 0.6e0) AS BIGINT) AS h FROM b), d AS (SELECT *, w - w % 2 AS we, h - h % 2 AS he FROM c),
f AS (SELECT series_id, (fw - w) // 2 AS x, (fh - h) // 2 AS y, we AS w, he AS h, floor(we * he / CAST(fw * fh AS DOUBLE) * 1000 + 0.5) / 10 AS area_pct FROM d)
SELECT *, CAST(CASE WHEN area_pct >= 10 AND area_pct <= 70 THEN 0.9 WHEN area_pct < 10 THEN 0.4 ELSE 0.6 END AS DOUBLE) AS confidence FROM f"""
)
def centre_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = rules.centre_box(320 + F.col("o_orderkey") % 700, 240 + F.col("o_orderkey") % 500)
    rows = sources.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("series_id"), box.alias("b")).select("series_id", "b.*")
    return rows.withColumn("confidence", rules.crop_confidence(F.col("area_pct")))


_SEGMENTS = "s AS (SELECT conv_id AS series_id, turn AS seq, turn * 10.0e0 AS start_s, turn * 10.0e0 + 8 AS end_s, text FROM conversations)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("series_id"), F.col("turn").alias("seq"), (F.col("turn") * 10.0).alias("start_s"), (F.col("turn") * 10.0 + 8).alias("end_s"), "text")


@register(
    f"""WITH {_SEGMENTS}, l AS (SELECT series_id, count(*) AS n, arg_max(text, seq) AS text, arg_max(end_s, seq) AS e, CAST(series_id % 7 AS DOUBLE) AS d FROM s GROUP BY series_id)
SELECT series_id, concat_ws(',', CASE WHEN series_id % 5 = 3 THEN 'quiet' END, CASE WHEN n = 1 AND d < 5 AND len(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) <= 4 THEN 'lone' END, CASE WHEN d > 0 AND e > d + 30 THEN 'overrun' END) AS doubts FROM l"""
)
def transcript_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(spark, sf_dir)
    context = segments.select("series_id").distinct().withColumns({"duration_s": (F.col("series_id") % 7).cast("double"), "loudness": F.when(F.col("series_id") % 5 < 4, -14.0 * (F.col("series_id") % 5))})
    return rules.transcript_doubts(segments, context)


@register(
    f"""WITH {_SEGMENTS} SELECT * FROM s WHERE series_id % 5 > 1
UNION ALL SELECT series_id, min(seq), arg_min(start_s, seq), arg_max(end_s, seq), '[low confidence]' FROM s WHERE series_id % 5 <= 1 GROUP BY series_id"""
)
def collapsed_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(spark, sf_dir)
    flagged = segments.select("series_id").distinct().withColumn("flagged", F.col("series_id") % 5 <= 1)
    return rules.collapse_flagged(segments, flagged)
