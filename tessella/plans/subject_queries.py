"""Queries on subjects, transcripts and parts brought together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import fanin, subjects
from tessella.plans.base import over, register

_ASSETS = "SELECT DISTINCT user_id AS series_id, CASE WHEN user_id % 5 = 0 THEN 3.0e0 ELSE 20.0e0 + user_id % 30 END AS duration_s, CASE WHEN user_id % 4 > 0 THEN user_id % 10 / 10.0e0 END AS confidence, user_id * 7 % 31 * 1.0e0 AS subj_ti FROM events"
_OVERALL = "SELECT user_id AS series_id, CASE WHEN user_id % 3 = 0 THEN event_id % 3 * 1.0e0 ELSE event_id % 40 * 1.0e0 END AS start_s, CASE WHEN user_id % 3 = 0 THEN event_id % 3 + 0.5e0 ELSE event_id % 40 + 1.5e0 END AS end_s, value AS intensity FROM events WHERE event_id % 6 = 0 AND user_id % 7 > 0"
_SUBJECT = "SELECT user_id AS series_id, event_id % 20 * 1.0e0 AS start_s, event_id % 20 + 2.0e0 AS end_s, value AS intensity FROM events WHERE event_id % 9 = 0 AND user_id % 2 = 0"


@register(
    f"""WITH a AS ({_ASSETS}), o AS ({_OVERALL}), s AS ({_SUBJECT}), c AS (SELECT a.*, EXISTS (SELECT 1 FROM o WHERE o.series_id = a.series_id AND end_s > duration_s * 0.25 AND start_s < duration_s * 0.75) AS covered, EXISTS (SELECT 1 FROM s WHERE s.series_id = a.series_id) AS own FROM a),
t AS (SELECT *, CASE WHEN NOT coalesce(confidence >= 0.2 AND duration_s > 5 AND NOT covered, false) THEN 'global' WHEN own THEN 'subject' WHEN subj_ti > 15 THEN 'middle' ELSE 'kept' END AS tier FROM c)
SELECT o.series_id, start_s, end_s, intensity, CAST(NULL AS DOUBLE) AS coverage_score, tier FROM o JOIN t USING (series_id) WHERE tier IN ('global', 'kept') UNION ALL SELECT s.series_id, start_s, end_s, intensity, NULL, tier FROM s JOIN t USING (series_id) WHERE tier = 'subject'
UNION ALL SELECT series_id, duration_s * 0.2, duration_s * 0.8, subj_ti, 0.5, tier FROM t WHERE tier = 'middle'"""
)
def subject_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_windows(*(over(spark, sf_dir, x, "events") for x in (_ASSETS, _OVERALL, _SUBJECT)))


@register(
    f"""WITH w AS (SELECT o.*, duration_s FROM ({_OVERALL}) o JOIN ({_ASSETS}) a USING (series_id))
SELECT series_id, bool_and(end_s < greatest(5, duration_s * 0.15) OR start_s > duration_s - greatest(5, duration_s * 0.15)) AS at_boundary FROM w WHERE duration_s > 10 GROUP BY 1"""
)
def boundary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = over(spark, sf_dir, _ASSETS, "events").select("series_id", "duration_s")
    return subjects.boundary_only(over(spark, sf_dir, _OVERALL, "events").join(assets, "series_id"))


_BOXES = "SELECT event_id AS series_id, 640 + event_id % 5 * 7 AS fw, 360 + event_id % 3 * 11 AS fh, CASE WHEN event_id % 3 = 0 THEN event_id % 100 * 1.0e0 END AS blob_pct, CASE WHEN event_id % 4 > 0 THEN 60.0e0 + event_id % 40 END AS crop_pct FROM events"


@register(
    f"""WITH b AS ({_BOXES}), m AS (SELECT *, CAST(floor(fw * 0.6e0) AS BIGINT) AS w, CAST(floor(fh * 0.6e0) AS BIGINT) AS h FROM b), e AS (SELECT *, w - w % 2 AS we, h - h % 2 AS he FROM m)
SELECT series_id, CASE WHEN blob_pct IS NOT NULL THEN 'cc' WHEN crop_pct < 85 THEN 'cropdetect' ELSE 'center-prior' END AS method, CASE WHEN blob_pct IS NOT NULL THEN 1 WHEN crop_pct < 85 THEN 2 ELSE CAST(floor((fw - w) / 2) AS BIGINT) END AS x, CASE WHEN blob_pct IS NOT NULL THEN 30 WHEN crop_pct < 85 THEN 40 ELSE he END AS h,
CASE WHEN blob_pct IS NOT NULL THEN blob_pct WHEN crop_pct < 85 THEN crop_pct ELSE floor(we * he / CAST(fw * fh AS DOUBLE) * 1000 + 0.5) / 10 END AS area_pct, CAST(CASE WHEN blob_pct BETWEEN 10 AND 70 THEN 0.9 WHEN blob_pct < 10 THEN 0.4 WHEN blob_pct IS NOT NULL THEN 0.6 WHEN crop_pct < 85 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS confidence FROM e"""
)
def subject_boxes_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    def box(pct: str, *sides: int):
        return F.when(F.col(pct).isNotNull(), F.struct(*(F.lit(v).alias(k) for k, v in zip("xywh", sides)), F.col(pct).alias("area_pct")))

    found = subjects.subject_box(box("blob_pct", 1, 2, 20, 30), box("crop_pct", 2, 3, 30, 40), F.col("fw"), F.col("fh"))
    return over(spark, sf_dir, _BOXES, "events").select("series_id", found.alias("b")).select("series_id", "b.method", "b.x", "b.h", "b.area_pct", "b.confidence")


_SEGMENTS = "SELECT user_id AS series_id, event_id AS seg_id, event_id % 60 * 1.0e0 AS start_s, event_id % 60 + value / 40 AS end_s, CASE event_id % 3 WHEN 0 THEN 'static' ELSE 'motion' END AS kind FROM events WHERE event_id % 2 = 0"
_WINDOWS = "SELECT user_id AS series_id, event_id AS win_id, event_id % 57 * 1.0e0 AS start_s, event_id % 57 + value / 25 AS end_s FROM events WHERE event_id % 2 = 1 AND event_id % 5 > 0"
_FOUND = "SELECT user_id AS series_id, event_id AS win_id, CASE WHEN event_id % 4 > 0 THEN event_type END AS box, CASE WHEN event_id % 7 = 0 THEN 'failed' END AS error FROM events"
_WHOLE = "SELECT DISTINCT user_id AS series_id, 'whole' AS box FROM events WHERE user_id % 3 > 0"


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.window_boxes(*(over(spark, sf_dir, x, "events") for x in (_WINDOWS, _FOUND)))


@register(f"WITH w AS ({_WINDOWS}), f AS ({_FOUND}) SELECT w.series_id, win_id, CASE WHEN error IS NULL AND end_s - start_s >= 1 THEN box END AS box FROM w LEFT JOIN f USING (series_id, win_id)")
def window_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir)


@register(
    f"""WITH s AS ({_SEGMENTS}), w AS (SELECT w.*, box FROM ({_WINDOWS}) w JOIN ({_FOUND}) f USING (series_id, win_id) WHERE error IS NULL AND box IS NOT NULL AND end_s - start_s >= 1), h AS (SELECT s.series_id, seg_id, arg_min(box, win_id) AS own FROM s JOIN w ON s.series_id = w.series_id AND s.start_s < w.end_s AND s.end_s > w.start_s WHERE kind = 'motion' GROUP BY 1, 2)
SELECT s.series_id, s.seg_id, coalesce(own, g.box) AS box FROM s LEFT JOIN h USING (series_id, seg_id) LEFT JOIN ({_WHOLE}) g USING (series_id)"""
)
def segment_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = over(spark, sf_dir, _WINDOWS, "events").join(_boxed(spark, sf_dir), ["series_id", "win_id"])
    return subjects.segment_crops(over(spark, sf_dir, _SEGMENTS, "events"), windows, over(spark, sf_dir, _WHOLE, "events"))


_TEXTS = """SELECT conv_id AS series_id, turn AS seq, turn * 10.0e0 AS start_s, turn * 10.0e0 + 8 AS end_s, CASE WHEN conv_id % 5 = 0 THEN 'Thank you.' WHEN conv_id % 5 = 1 AND turn < 4 THEN concat(' Same ', CAST(turn % 1 AS STRING), ' line ') WHEN conv_id % 5 = 2 THEN 'Yes' WHEN conv_id % 11 = 3 THEN '[low confidence: music]' ELSE text END AS text FROM conversations WHERE turn = 0 OR conv_id % 6 > 0"""
_MADE_UP = " OR ".join("regexp_matches(text, '(?i)" + p.replace("'", "''") + "')" for p in text.MADE_UP_PHRASES)


@register(
    f"""WITH s AS ({_TEXTS}), l AS (SELECT series_id, count(*) AS n, arg_max(text, seq) AS text, arg_max(end_s, seq) AS e, CAST(series_id % 7 AS DOUBLE) AS d FROM s GROUP BY series_id), k AS (SELECT series_id, lower(trim(text)) AS norm, count(*) AS c, min(seq) AS f FROM s GROUP BY 1, 2), r AS (SELECT series_id, arg_min(c, f) AS c FROM k WHERE c >= 3 GROUP BY 1),
h AS (SELECT series_id, count_if({_MADE_UP}) AS m FROM s GROUP BY 1), v AS (SELECT series_id, concat_ws(',', CASE WHEN series_id % 5 = 3 THEN 'quiet' END, CASE WHEN c * 2 >= n THEN 'repeated' END, CASE WHEN m > 0 AND m * 2 >= n THEN 'made_up' END,
CASE WHEN n = 1 AND d < 5 AND len(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) <= 4 THEN 'lone' END, CASE WHEN d > 0 AND e > d + 30 THEN 'overrun' END) AS reasons FROM l JOIN h USING (series_id) LEFT JOIN r USING (series_id))
SELECT series_id, reasons <> '' AS flagged, reasons FROM v"""
)
def transcript_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = over(spark, sf_dir, _TEXTS, "conversations")
    context = segments.select("series_id").distinct().withColumns({"duration_s": (F.col("series_id") % 7).cast("double"), "loudness": F.when(F.col("series_id") % 5 < 4, -14.0 * (F.col("series_id") % 5))})
    return subjects.transcript_confidence(segments, context)


@register(
    f"""WITH s AS ({_TEXTS}) SELECT series_id, sum(len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{2,}}'))) >= 3 AND sum(len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]'))) >= 15 AND series_id % 8 > 0 AND NOT (count(*) = 1 AND bool_and(text LIKE '[low confidence%')) AS has_speech FROM s GROUP BY 1"""
)
def speech_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = over(spark, sf_dir, _TEXTS, "conversations")
    return subjects.speech_present(segments, segments.where("series_id % 8 = 0"))


_CHUNKS = "SELECT user_id AS series_id, event_id AS chunk, event_id * 10.0e0 AS start_s, event_id * 10.0e0 + 10 AS end_s FROM events"
_RESULTS = "SELECT user_id AS series_id, event_id AS chunk, event_id % 5 > 0 AS ok, event_id * 10.0e0 + k.k * 6 - 3 AS start_s, event_id * 10.0e0 + k.k * 6 - 3 + value / 30 AS end_s, event_type AS text FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 3) k WHERE event_id % 7 > 0"


@register(
    f"""WITH c AS ({_CHUNKS}), r AS ({_RESULTS}) SELECT c.series_id, c.chunk, greatest(r.start_s, c.start_s) AS start_s, least(r.end_s, c.end_s) AS end_s, text, false AS failed FROM c JOIN r USING (series_id, chunk) WHERE ok AND least(r.end_s, c.end_s) > greatest(r.start_s, c.start_s)
UNION ALL SELECT series_id, chunk, start_s, end_s, '[transcription failed for this segment after retry]', true FROM c WHERE chunk % 7 = 0 OR chunk % 5 = 0"""
)
def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanin.chunk_results(over(spark, sf_dir, _CHUNKS, "events"), over(spark, sf_dir, _RESULTS, "events"))


_ROUTES = """SELECT event_id AS series_id, CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN true END AS asked, event_id % 7 > 0 AS has_audio, CASE WHEN event_id % 3 = 0 THEN 'short' END AS refusal, event_id % 2 = 0 AS has_captions, CASE event_id % 4 WHEN 0 THEN 'gemini-api' WHEN 1 THEN 'none' ELSE 'local' END AS backend,
CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS doubtful, event_id % 9 < 4 AS has_key, event_id % 8 < 5 AS has_tool, CASE WHEN event_id % 10 = 0 THEN 5.0e0 END AS start_s, value * 8 AS duration_s FROM events"""


@register(
    f"""WITH r AS ({_ROUTES}), u AS (SELECT *, CASE WHEN backend = 'local' AND NOT has_tool THEN CASE WHEN has_key THEN 'gemini-api' ELSE 'none' END ELSE backend END AS first FROM r), v AS (SELECT *, CASE WHEN first = 'gemini-api' AND NOT has_key THEN 'local' ELSE first END AS usable FROM u)
SELECT series_id, usable, CASE WHEN asked = false OR NOT has_audio THEN 'none' WHEN has_captions AND refusal IS NULL THEN 'captions' WHEN usable = 'local' AND doubtful THEN 'suppressed' ELSE usable END AS route, CASE WHEN start_s IS NOT NULL THEN 'slice' WHEN duration_s <= 1200 THEN 'whole' ELSE 'chunks' END AS cut FROM v"""
)
def audio_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    usable = fanin.usable_backend(c("backend"), c("has_key"), c("has_tool"))
    route = fanin.audio_route(c("asked"), c("has_audio"), c("refusal"), c("has_captions"), c("usable"), c("doubtful"))
    rows = over(spark, sf_dir, _ROUTES, "events").withColumn("usable", usable)
    return rows.select("series_id", "usable", route.alias("route"), fanin.sliced_route(c("start_s"), F.lit(None).cast("double"), c("duration_s")).alias("cut"))


_ENDS = "SELECT user_id AS series_id, CASE event_id % 5 WHEN 0 THEN 'later' WHEN 1 THEN '1:2' ELSE concat('00:', lpad(CAST(event_id % 60 AS STRING), 2, '0'), ':30') END AS label FROM events WHERE event_id % 5 < 2 OR user_id % 3 > 0"


@register(f"SELECT series_id, coalesce(max(CASE WHEN label LIKE '00:%' THEN CAST(label[4:5] AS DOUBLE) * 60 + 30 END), 0.0) AS coverage_s FROM ({_ENDS}) GROUP BY 1")
def caption_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanin.coverage(over(spark, sf_dir, _ENDS, "events").withColumnRenamed("label", "end"))


_WATCHED = "SELECT user_id AS series_id, event_id AS segment, value AS v, event_type FROM events WHERE event_id % 4 > 0"


@register(
    f"""WITH w AS ({_WATCHED}), b AS (SELECT series_id, segment, 0 AS k, floor(v / 20) AS at_s, event_type AS text FROM w UNION ALL SELECT series_id, segment, 1, floor(v / 50), 'second' FROM w WHERE segment % 3 = 0)
SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY at_s, segment, k) AS INT) AS pos, segment, at_s, text FROM b"""
)
def merged_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    beat = lambda at, text: F.struct(F.floor(at).cast("double").alias("at_s"), text.alias("text"))
    first, second = beat(F.col("v") / 20, F.col("event_type")), beat(F.col("v") / 50, F.lit("second"))
    beats = F.when(F.col("segment") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    return fanin.merged_beats(over(spark, sf_dir, _WATCHED, "events").select("series_id", "segment", beats.alias("beats")))


_PALETTES = "SELECT user_id AS series_id, event_id AS segment, concat(' #', lpad(CAST(event_id % 13 AS STRING), 3, '0'), ' ') AS a, CASE event_id % 3 WHEN 0 THEN 'cream' WHEN 1 THEN concat('a', CAST(event_id % 5 AS STRING), 'b') END AS b FROM events"


@register(
    f"""WITH p AS ({_PALETTES}), c AS (SELECT series_id, segment, 0 AS k, trim(a) AS colour FROM p UNION ALL SELECT series_id, segment, 1, trim(b) FROM p), g AS (SELECT series_id, colour, min((segment, k)) AS first_at FROM c WHERE regexp_matches(colour, '^#?[0-9a-fA-F]{{3,8}}$') GROUP BY 1, 2)
SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY first_at) AS INT) AS pos, colour FROM g"""
)
def merged_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanin.merged_palette(over(spark, sf_dir, _PALETTES, "events").select("series_id", "segment", F.array("a", "b").alias("palette")))


@register(
    """SELECT user_id AS series_id, CAST(sum(1 + event_id % 4) AS BIGINT) AS n_parts, CAST(sum(CASE WHEN event_id % 4 > 0 THEN 1 + event_id % 4 ELSE 0 END) AS BIGINT) AS n_watched, count_if(event_id % 4 = 0) AS n_lost FROM events GROUP BY 1"""
)
def watched_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = over(spark, sf_dir, "SELECT user_id AS series_id, event_id AS segment, 1 + event_id % 4 AS n_parts FROM events", "events")
    return fanin.watched_parts(planned, over(spark, sf_dir, _WATCHED, "events"))
