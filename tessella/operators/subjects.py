"""Where the subject of an asset is and when it moves: windows, boxes, crops of segments, and one verdict on a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import rules, text
from tessella.operators import intervals


def covers_middle(windows: DataFrame) -> DataFrame:
    """(series_id, covered) of windows (series_id, start_s, end_s, duration_s): whether one lies over the middle half of its asset."""
    over = (F.col("end_s") > F.col("duration_s") * 0.25) & (F.col("start_s") < F.col("duration_s") * 0.75)
    return windows.groupBy("series_id").agg(F.bool_or(over).alias("covered"))


def subject_windows(assets: DataFrame, overall: DataFrame, subject: DataFrame, least_confidence: float = 0.2, least_s: float = 5.0, moving: float = 15.0) -> DataFrame:
    """(series_id, start_s, end_s, intensity, coverage_score, tier): the windows that are to be used for each asset.

    assets: (series_id, duration_s, confidence of the subject's box, subj_ti); overall and subject: windows (series_id, start_s, end_s, intensity).
    The overall ones are doubted where there is a box, the asset is long enough and none covers its middle half. Then the subject's windows
    stand for them ('subject'); without any, one window over the middle six tenths where the subject moves ('middle'); else
    they stay ('kept'). Those not doubted are 'global'.
    """
    covered = covers_middle(overall.join(assets.select("series_id", "duration_s"), "series_id"))
    own = subject.select("series_id").distinct().withColumn("has_own", F.lit(True))
    rated = assets.join(covered, "series_id", "left").join(own, "series_id", "left")
    doubted = (F.col("confidence") >= least_confidence) & (F.col("duration_s") > least_s) & ~F.coalesce("covered", F.lit(False))
    tier = F.when(~F.coalesce(doubted, F.lit(False)), "global").when(F.col("has_own"), "subject").when(F.col("subj_ti") > moving, "middle").otherwise("kept")
    rated = rated.withColumn("tier", tier)
    columns = ["series_id", "start_s", "end_s", "intensity", "coverage_score", "tier"]
    of = lambda rows, *tiers: rows.join(rated.where(F.col("tier").isin(*tiers)).select("series_id", "tier"), "series_id").withColumn("coverage_score", F.lit(None).cast("double")).select(columns)
    middle = rated.where("tier = 'middle'").select("series_id", (F.col("duration_s") * 0.2).alias("start_s"), (F.col("duration_s") * 0.8).alias("end_s"), F.col("subj_ti").alias("intensity"), F.lit(0.5).alias("coverage_score"), "tier")
    return of(overall, "global", "kept").unionByName(of(subject, "subject")).unionByName(middle)


def boundary_only(windows: DataFrame, least_s: float = 10.0) -> DataFrame:
    """(series_id, at_boundary) of windows (series_id, start_s, end_s, duration_s) of assets longer than ``least_s``: whether every window lies in the
    first or last 15 %, five seconds at least."""
    edge = F.greatest(F.lit(5.0), F.col("duration_s") * 0.15)
    outside = (F.col("end_s") < edge) | (F.col("start_s") > F.col("duration_s") - edge)
    return windows.where(F.col("duration_s") > least_s).groupBy("series_id").agg(F.bool_and(outside).alias("at_boundary"))


def subject_box(blob: Column, crop: Column, frame_w: Column, frame_h: Column, loose: float = 85.0) -> Column:
    """STRUCT<x, y, w, h, area_pct, method, confidence>: the blob's box, else the crop's if its area is under ``loose``, else the middle of the frame.

    blob and crop are STRUCT<x, y, w, h, area_pct> or null.
    """

    def told(box: Column, method: str, confidence: Column) -> Column:
        whole = [box[k].cast("long").alias(k) for k in "xywh"]
        return F.struct(*whole, box["area_pct"].alias("area_pct"), F.lit(method).alias("method"), confidence.alias("confidence"))

    tight = crop["area_pct"] < loose
    return (
        F.when(blob.isNotNull(), told(blob, "cc", rules.crop_confidence(blob["area_pct"]).cast("double")))
        .when(F.coalesce(tight, F.lit(False)), told(crop, "cropdetect", F.lit(0.5)))
        .otherwise(told(rules.centre_box(frame_w, frame_h), "center-prior", F.lit(0.2)))
    )


def window_boxes(windows: DataFrame, found: DataFrame, least_s: float = 1.0) -> DataFrame:
    """(series_id, win_id, box): each window (series_id, win_id, start_s, end_s) with what a detector (series_id, win_id, box, error) says of it; null where it failed
    or said nothing, and for windows shorter than ``least_s``, which are too short to be looked at."""
    said = found.where("error IS NULL").groupBy("series_id", "win_id").agg(F.first("box", ignorenulls=True).alias("said"))
    box = F.when(F.col("end_s") - F.col("start_s") >= least_s, F.col("said"))
    return windows.select("series_id", "win_id", "start_s", "end_s").join(said, ["series_id", "win_id"], "left").select("series_id", "win_id", box.alias("box"))


def segment_crops(segments: DataFrame, windows: DataFrame, boxes: DataFrame, slot: float = 10.0) -> DataFrame:
    """(series_id, seg_id, box): moving segments take the box of the first window, by win_id, that overlaps them strictly and has one; the
    others, and those without such a window, their series' box.

    segments: (series_id, seg_id, start_s, end_s, kind); windows: (series_id, win_id, start_s, end_s, box); boxes: (series_id, box).
    Segments and windows meet by series and time slot, so none meets all others of its series.
    """
    pairs = intervals.overlapping(segments.where("kind = 'motion'").select("series_id", "seg_id", "start_s", "end_s"), windows.where("box IS NOT NULL").select("series_id", "win_id", "box", "start_s", "end_s"), slot)
    hits = pairs.groupBy("series_id", "seg_id").agg(F.min_by("box", "win_id").alias("own"))
    rows = segments.select("series_id", "seg_id").join(hits, ["series_id", "seg_id"], "left").join(boxes.select("series_id", F.col("box").alias("common")), "series_id", "left")
    return rows.select("series_id", "seg_id", F.coalesce("own", "common").alias("box"))


def transcript_confidence(segments: DataFrame, context: DataFrame) -> DataFrame:
    """(series_id, flagged, reasons): one verdict on (series_id, seq, start_s, end_s, text), given (series_id, duration_s, loudness).

    reasons has, in this order and joined by commas: quiet, repeated, made_up, lone, overrun; any of them flags. Series without segments
    have no row.
    """
    doubts = rules.transcript_doubts(segments, context).select("series_id", F.split("doubts", ",").alias("d"))
    said = text.transcript_verdict(segments)
    half = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) * 2 >= F.col("n")), F.lit(False))
    both = said.join(doubts, "series_id", "left")
    has = lambda name: F.coalesce(F.array_contains("d", name), F.lit(False))
    found = {"quiet": has("quiet"), "repeated": half("repeat_n"), "made_up": half("n_made_up"), "lone": has("lone"), "overrun": has("overrun")}
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in found.items())))
    return both.select("series_id", (F.size(reasons) > 0).alias("flagged"), F.array_join(reasons, ",").alias("reasons"))


def speech_present(segments: DataFrame, skipped: DataFrame, mark: str = "[low confidence") -> DataFrame:
    """(series_id, has_speech): ``text.has_speech`` but for series that were skipped (series_id) and those whose only segment starts with the mark."""
    told = text.has_speech(segments)
    marks = segments.groupBy("series_id").agg((F.count(F.lit(1)) == 1).alias("one"), F.bool_and(F.coalesce(F.col("text").startswith(mark), F.lit(False))).alias("marked"))
    passed = skipped.select("series_id").distinct().withColumn("skip", F.lit(True))
    silent = (F.col("one") & F.col("marked")) | F.coalesce("skip", F.lit(False))
    return told.join(marks, "series_id").join(passed, "series_id", "left").select("series_id", (F.col("has_speech") & ~silent).alias("has_speech"))
