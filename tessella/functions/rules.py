"""Ordered rules on columns: the first that holds decides. Missing values count as the rules say, never as an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules in their order as (rule, class, condition), and what their names stand for.
CLASS_RULES = (
    ("dense_screen", "ui-screen", "si > 180 AND ti < 25"),
    ("sparse_screen", "ui-screen", "si > 100 AND ti < 15 AND outliers = 0"),
    ("still_screen", "ui-screen", "ti < 5 AND cuts < 0.1 AND outliers = 0 AND method IN ('cc', 'cropdetect')"),
    ("colour_events", "animation", "outliers >= 3 AND (cuts < 0.3 OR doubtful)"),
    ("montage", "animation", "outliers >= 5 AND ti < 15 AND cuts > 0.2 AND si < 50"),
    ("teaser", "animation", "si < 35 AND ti < 15 AND cuts > 0.2 AND cuts < 0.6 AND NOT doubtful"),
    ("clean_subject", "animation", "ti >= 50 AND NOT loose_box AND method = 'cc'"),
    ("dense_cuts", "talking-head", "cuts > 0.4 AND si > 70 AND NOT doubtful"),
    ("subject_moves", "human-motion", "loose_box AND ratio > 1.1 AND st > 30"),
    ("subject_dominates", "human-motion", "ratio > 1.4 AND st > 40 AND NOT trusted"),
    ("sports", "human-motion", "loose_box AND cuts > 0.3 AND ti > 20 AND ratio > 1.1"),
    ("presenter", "talking-head", "ratio > 1.2 AND cuts < 0.6 AND NOT doubtful"),
    ("edited", "talking-head", "cuts > 0.3 AND si > 40 AND NOT doubtful"),
    ("instructor", "human-motion", "loose_box AND ti > 18 AND cuts < 0.4 AND speech AND st > 18 AND NOT doubtful"),
    ("still_scene", "nature", "ti < 15 AND st < 20 AND cuts < 0.1"),
    ("flow", "nature", "ti > 15 AND ti < 35 AND cuts < 0.35 AND outliers = 0 AND loose_box AND si < 60 AND abs(ratio - 1) < 0.15 AND NOT trusted"),
    ("moving_camera", "real-world", "loose_box AND ti > 25 AND si > 60"),
    ("moving_subject", "real-world", "loose_box AND ti > 30 AND ratio > 1.1"),
)
CLASS_TERMS = {
    "si": "coalesce(si, 0)",
    "ti": "coalesce(ti, 0)",
    "st": "coalesce(subj_ti, 0)",
    "cuts": "CASE WHEN duration_s > 0 THEN scenes_count / duration_s ELSE 0 END",
    "ratio": "CASE WHEN ti > 0 THEN coalesce(subj_ti, 0) / ti ELSE 0 END",
    "outliers": "outliers_count",
    "method": "coalesce(bbox_method, 'none')",
    "doubtful": "coalesce(low_confidence, false)",
    "trusted": "NOT coalesce(low_confidence, true)",
    "speech": "coalesce(has_speech, false)",
    "loose_box": "coalesce(bbox_method = 'cropdetect-fallback' AND coalesce(bbox_area_pct, 100) >= 90 OR bbox_method = 'center-prior', false) OR coalesce(bbox_confidence, 1) < 0.3",
}


def classify(assets: DataFrame) -> DataFrame:
    """(series_id, content_class, rule) from (series_id, si, ti, subj_ti, scenes_count, duration_s, outliers_count, bbox_method,
    bbox_area_pct, bbox_confidence, low_confidence, has_speech); 'generic' where no rule holds."""
    terms = assets.select("series_id", *(F.expr(sql).alias(name) for name, sql in CLASS_TERMS.items()))
    first = lambda pick: F.coalesce(*(F.when(F.expr(r[2]), F.lit(r[pick])) for r in CLASS_RULES), F.lit("generic"))
    return terms.select("series_id", first(1).alias("content_class"), first(0).alias("rule"))


def has_motion(ti: Column, subj_ti: Column) -> Column:
    return F.coalesce(ti > 20, F.lit(False)) | F.coalesce(subj_ti > 15, F.lit(False))


def _any(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests))


def suggests_narrative() -> Column:
    """Over content_class, content_profile, scenes_count, duration_s, has_motion, outliers_count, bbox_area_pct: does any signal ask for it?"""
    cuts = F.coalesce("scenes_count", F.lit(0)) / F.greatest(F.lit(1.0), F.col("duration_s"))
    return _any(
        ~F.col("content_class").isin("nature", "generic") & (F.col("content_class") != ""),
        F.col("content_profile").rlike(r"(?i)high\s*motion|action|dynamic"),
        cuts > 0.3,
        F.col("has_motion"),
        F.col("outliers_count") > 0,
        F.col("bbox_area_pct") < 30,
    )


def _decision(on: Column, source: str) -> Column:
    return F.struct(on.alias("on"), F.lit(source).alias("source"))


def decide_narrative(asked: Column, suggested: Column, configured: Column) -> Column:
    """STRUCT<on, source>: an explicit choice, else the suggestion, else the configuration, else off."""
    yes, no = F.lit(True), F.lit(False)
    return F.when(asked.isNotNull(), _decision(asked, "explicit")).when(_any(suggested), _decision(yes, "auto")).when(_any(configured), _decision(yes, "config")).otherwise(_decision(no, "default"))


def decide_adaptive(asked: Column, n_windows: Column, duration_s: Column, has_segments: Column, configured: Column, least_s: float = 4.0) -> Column:
    """STRUCT<on, source>: off with given segments; else an explicit choice; else the configuration where there are windows and length."""
    fit = (n_windows >= 1) & (duration_s > least_s)
    off = _decision(F.lit(False), "default")
    return F.when(_any(has_segments), off).when(asked.isNotNull(), _decision(asked, "explicit")).when(_any(configured & fit), _decision(F.lit(True), "config")).otherwise(off)


def caption_refusal(found: Column, n_rows: Column, source: Column, coverage_s: Column, duration_s: Column) -> Column:
    """Why captions cannot stand in for a transcript: missing, empty, automatic, short or overlong; null where they can."""
    share = F.when(duration_s > 0, coverage_s / duration_s).otherwise(1.0)
    return (
        F.when(~F.coalesce(found, F.lit(False)), "missing")
        .when(n_rows == 0, "empty")
        .when(source == "automatic_captions", "automatic")
        .when((duration_s >= 30) & (share < 0.5), "short")
        .when((duration_s > 0) & (coverage_s > duration_s * 1.2), "overlong")
    )


def too_quiet(value: Column, scale: Column) -> Column:
    """Is the sound too quiet for speech? Below -30 LUFS or -33 dBFS; unknown loudness is not."""
    limit = F.when(scale == "lufs", -30.0).when(scale == "dbfs", -33.0)
    return F.coalesce(~F.isnan(value) & (value < limit), F.lit(False))


def caption_slice(captions: DataFrame, start: float, end: float | None = None) -> DataFrame:
    """Captions that touch [start, end], with times from ``start`` on, not below zero and rounded down to seconds."""
    kept = captions.where((F.col("end_s") >= start) & (F.lit(True) if end is None else F.col("start_s") <= end))
    return kept.withColumns({k: F.floor(F.greatest(F.lit(0.0), F.col(k) - start)).cast("double") for k in ("start_s", "end_s")})


def crop_confidence(area_pct: Column) -> Column:
    return F.when(area_pct.between(10, 70), 0.9).when(area_pct < 10, 0.4).otherwise(0.6)


def centre_box(frame_w: Column, frame_h: Column, share: float = 0.6) -> Column:
    """STRUCT<x, y, w, h, area_pct>: a box of even sides in the middle of the frame."""
    w, h = F.floor(frame_w * share), F.floor(frame_h * share)
    even_w, even_h = w - w % 2, h - h % 2
    area = F.floor(even_w * even_h / (frame_w * frame_h) * 1000 + 0.5) / 10.0
    return F.struct(F.floor((frame_w - w) / 2).alias("x"), F.floor((frame_h - h) / 2).alias("y"), even_w.alias("w"), even_h.alias("h"), area.alias("area_pct"))


def transcript_doubts(segments: DataFrame, context: DataFrame) -> DataFrame:
    """(series_id, doubts): what speaks against transcripts (series_id, seq, start_s, end_s, text), given (series_id, duration_s, loudness).

    ``quiet``: a loudness below -28; null says nothing. ``lone``: one segment of four words at most on less than five seconds. ``overrun``: the last segment ends over thirty seconds
    after the asset. Repeats and made-up phrases are ``text.transcript_verdict``'s part. Series without segments have no row.
    """
    last = segments.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("text", "seq").alias("text"), F.max_by("end_s", "seq").alias("last_end"))
    words = F.size(F.split(F.regexp_replace(F.trim("text"), r"^\s+|\s+$", ""), r"\s+"))
    lone = (F.col("n") == 1) & (F.col("duration_s") < 5) & (words <= 4)
    overrun = (F.col("duration_s") > 0) & (F.col("last_end") > F.col("duration_s") + 30)
    named = F.array_compact(F.array(F.when(F.col("loudness") < -28, F.lit("quiet")), F.when(lone, F.lit("lone")), F.when(overrun, F.lit("overrun"))))
    return last.join(context, "series_id").select("series_id", F.array_join(named, ",").alias("doubts"))


def collapse_flagged(segments: DataFrame, flagged: DataFrame, mark: str = "[low confidence]") -> DataFrame:
    """Transcripts of flagged series (series_id, flagged) become one segment over their whole span; the others stay as they are."""
    marked = segments.join(flagged.select("series_id", "flagged"), "series_id", "left")
    kept = marked.where(~F.coalesce("flagged", F.lit(False))).select("series_id", "seq", "start_s", "end_s", "text")
    one = marked.where("flagged").groupBy("series_id").agg(F.min("seq").alias("seq"), F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s")).withColumn("text", F.lit(mark))
    return kept.unionByName(one)
