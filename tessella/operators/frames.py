"""Frame times of assets and of segment plans, and what is drawn from a structural scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import labels, text

#: Signals of a scan and the columns that each needs.
SIGNALS = {
    "scene_changes": ("scene_score",),
    "black_intervals": ("black",),
    "freeze": ("frozen",),
    "motion": ("si", "ti"),
    "blur": ("blur",),
    "exposure": ("brightness", "u", "v"),
    "silence": ("silence",),
    "loudness": ("lufs",),
}


def structural_scan(frames: DataFrame, wanted: tuple[str, ...]) -> DataFrame | None:
    """The series, times and just the columns of the wanted signals, so that a scan reads no others; None where nothing is wanted."""
    columns = [c for name in SIGNALS if name in wanted for c in SIGNALS[name]]
    return frames.select("series_id", "t", *columns) if columns else None


def signal_rows(frames: DataFrame, wanted: tuple[str, ...]) -> DataFrame | None:
    """(series_id, t, signal, value): a row for each wanted signal's column that a frame has, in one pass over just those columns; None where nothing is wanted."""
    scanned = structural_scan(frames, wanted)
    if scanned is None:
        return None
    cells = F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("value")) for c in scanned.columns if c not in ("series_id", "t")))
    return scanned.select("series_id", "t", F.inline(cells)).where("value IS NOT NULL")


def resampled(samples: DataFrame, rate: float = 10.0, box: Column | None = None) -> DataFrame:
    """(series_id, t, x): one sample for each 1/rate of time, the first of those in it; ``box`` keeps the samples where it holds."""
    kept = samples if box is None else samples.where(box)
    return kept.groupBy("series_id", F.floor(F.col("t") * rate).alias("slot")).agg(F.min_by("x", "t").alias("x")).select("series_id", (F.col("slot") / rate).alias("t"), "x")


def _time_label(t: Column, fps: Column) -> Column:
    """In milliseconds where frames are not whole seconds apart."""
    step = F.lit(1.0) / fps
    return F.when(step == F.floor(step), text.clock_label(t)).otherwise(labels.precise_label(t))


def frame_labels(requests: DataFrame, most: int = 1000) -> DataFrame:
    """(series_id, i, t, label): the frames of (series_id, fps, start_s, end_s, duration_s), fps a second from the start on, ``most`` at most.

    A null start is 0, a null end the asset's; an end that is not after the start counts as none.
    """
    start = F.coalesce("start_s", F.lit(0.0))
    end = F.when(F.col("end_s") > start, F.least("end_s", "duration_s")).otherwise(F.col("duration_s"))
    n = F.least(F.lit(most), F.ceil((end - start) * F.col("fps") - 1e-9)).cast("int")
    rows = requests.select("series_id", "fps", start.alias("first"), n.alias("n")).where("n > 0").withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    t = F.col("first") + F.col("i") / F.col("fps")
    return rows.select("series_id", "i", t.alias("t"), _time_label(t, F.col("fps")).alias("label"))


def segment_frame_labels(segments: DataFrame, crop: Column | None = None, most: int = 1000, resolution: int = 512) -> DataFrame:
    """(series_id, seg_id, i, t, label, resolution, drawn_crop, crop) for segments (series_id, seg_id, start_s, end_s, fps, resolution, crop).

    A segment's own crop goes before the common one when frames are drawn; only its own is told in ``crop``. A null resolution is the default.
    """
    n = F.least(F.lit(most), F.ceil((F.col("end_s") - F.col("start_s")) * F.col("fps") - 1e-9)).cast("int")
    common = F.lit(None).cast("string") if crop is None else crop
    rows = segments.withColumns({"n": n, "drawn_crop": F.coalesce("crop", common), "resolution": F.coalesce("resolution", F.lit(resolution))}).where("n > 0").withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    t = F.col("start_s") + F.col("i") / F.col("fps")
    return rows.select("series_id", "seg_id", "i", t.alias("t"), _time_label(t, F.col("fps")).alias("label"), "resolution", "drawn_crop", "crop")


def segment_seconds(segments: DataFrame) -> DataFrame:
    """(series_id, seg_id, i, label): whole-second labels at start, start + 1/fps, ... before the end, each rounded half up."""
    n = F.ceil((F.col("end_s") - F.col("start_s")) * F.col("fps") - 1e-9).cast("int")
    rows = segments.withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    return rows.select("series_id", "seg_id", "i", text.clock_label(F.floor(F.col("start_s") + F.col("i") / F.col("fps") + 0.5)).alias("label"))


def equal_tiles(assets: DataFrame) -> DataFrame:
    """(series_id, k, start_s, end_s): each (series_id, duration_s, n) in n equal parts, edge to edge; no duration, no parts."""
    part = F.col("duration_s") / F.greatest(F.lit(1), F.col("n"))
    rows = assets.where("duration_s > 0").withColumn("k", F.explode(F.expr("sequence(0, greatest(1, n) - 1)")))
    return rows.select("series_id", "k", (F.col("k") * part).alias("start_s"), F.least((F.col("k") + 1) * part, F.col("duration_s")).alias("end_s"))


def first_of_each(frames: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each series by time."""
    place = F.row_number().over(Window.partitionBy("series_id").orderBy("t"))
    return frames.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
