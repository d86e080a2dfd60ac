"""Operators on intervals (series_id, start_s, end_s, ...): merge, complement, overlap, nearest, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_windows(windows: DataFrame) -> DataFrame:
    """Windows that overlap or touch join: (series_id, seg, start_s, end_s, intensity = the largest)."""
    order = Window.partitionBy("series_id").orderBy("start_s", "end_s")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = windows.withColumn("opens", F.when(F.col("start_s") <= reach, 0).otherwise(1))
    seg = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("seg", seg).groupBy("series_id", "seg").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("intensity").alias("intensity"))


def complement(merged: DataFrame, bounds: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """What disjoint windows leave of each series' (start0, end0), where it is longer than ``tolerance``; head and tail included."""
    order = Window.partitionBy("series_id").orderBy("start_s")
    inner = merged.join(bounds, "series_id").select("series_id", F.coalesce(F.lag("end_s").over(order), "start0").alias("start_s"), F.col("start_s").alias("end_s"))
    tail = bounds.join(merged.groupBy("series_id").agg(F.max("end_s").alias("last")), "series_id", "left").select("series_id", F.coalesce("last", "start0").alias("start_s"), F.col("end0").alias("end_s"))
    return inner.unionByName(tail).where(F.col("end_s") - F.col("start_s") > tolerance)


def slots(start: Column, end: Column, length: float) -> Column:
    """The slots of a length that an interval touches, as rows; for intervals that are not much longer than ``length``."""
    return F.explode(F.sequence(F.floor(start / length), F.floor(end / length)))


#: The level of intervals without a finite length, which has one slot.
_ENDLESS = 4096


def _level(start: Column, end: Column, slot: float) -> Column:
    """The least k for which the interval is no longer than slot * 2^k."""
    span = (end - start) / F.lit(slot)
    finite = (F.abs(start) < float("inf")) & (F.abs(end) < float("inf"))
    return F.when(~finite, F.lit(_ENDLESS)).when(span <= 1, F.lit(0)).otherwise(F.ceil(F.log2(span)).cast("int"))


def slot_of(at: Column, slot: float, level: Column | None = None) -> Column:
    """The slot of a time on a level, that of the column ``level_`` unless given; times beyond what a slot number can tell share the outermost slots."""
    level = F.col("level_") if level is None else level
    number = F.when(level == _ENDLESS, F.lit(0.0)).otherwise(F.greatest(F.lit(-4e18), F.least(F.lit(4e18), at / (F.lit(float(slot)) * F.pow(F.lit(2.0), level)))))
    return F.floor(number)


def leveled(rows: DataFrame, start: str, end: str, levels: list[int], slot: float) -> DataFrame:
    """Each interval on its own level and all coarser ones of ``levels``, in the slots that it touches there (three at most on its own level, two on
    the others): columns level_, slot_ and home_, true on its own level."""
    own = rows.withColumn("own_", _level(F.col(start), F.col(end), slot))
    spread = own.withColumn("level_", F.explode(F.filter(F.array(*(F.lit(k) for k in levels)), lambda k: k >= F.col("own_"))))
    placed = spread.withColumn("slot_", F.explode(F.sequence(slot_of(F.col(start), slot), slot_of(F.col(end), slot))))
    return placed.withColumn("home_", F.col("own_") == F.col("level_")).drop("own_")


def levels_of(*sides: DataFrame, slot: float = 10.0) -> list[int]:
    """The levels of the intervals (start_s, end_s): a few numbers, however many intervals there are (a double has 2,100 powers of two)."""
    found: set[int] = set()
    for side in sides:
        found |= {r[0] for r in side.select(_level(F.col("start_s"), F.col("end_s"), slot)).distinct().collect()}
    return sorted(found)


def overlapping(a: DataFrame, b: DataFrame, slot: float = 10.0) -> DataFrame:
    """The pairs of intervals of one series that overlap strictly: columns of ``a`` and ``b``, which share the names series_id, start_s and end_s only;
    those of ``b`` are called other_start_s and other_end_s.

    An interval lies on the level of its length, where slots are about as long as it is, and visits the coarser levels that are in use. Two intervals meet on the
    coarser of their levels, so a long one costs a few rows, not one for each slot of its time. Intervals that end before they start meet none.
    """
    valid = "end_s >= start_s"
    a, b = a.where(valid), b.where(valid)
    levels = levels_of(a, b, slot=slot)
    if not levels:
        levels = [0]
    one = leveled(a, "start_s", "end_s", levels, slot).withColumnRenamed("home_", "a_home_")
    two = leveled(b, "start_s", "end_s", levels, slot).withColumnRenamed("home_", "b_home_").withColumnsRenamed({"start_s": "other_start_s", "end_s": "other_end_s"})
    met = one.join(two, ["series_id", "level_", "slot_"]).where("(a_home_ OR b_home_) AND start_s < other_end_s AND end_s > other_start_s")
    # intervals that share several slots meet in the first of them only
    first = F.col("slot_") == F.greatest(slot_of(F.col("start_s"), slot), slot_of(F.col("other_start_s"), slot))
    return met.where(first).drop("level_", "slot_", "a_home_", "b_home_")


def within(points: DataFrame, windows: DataFrame, slot: float = 10.0) -> DataFrame:
    """The pairs of a point (series_id, t, ...) and a window (series_id, start_s, end_s, ...) of its series that holds it, ends included."""
    held = windows.where("end_s >= start_s")
    levels = levels_of(held, slot=slot) or [0]
    homes = leveled(held, "start_s", "end_s", levels, slot).where("home_").drop("home_")
    at = points.withColumn("level_", F.explode(F.array(*(F.lit(k) for k in levels))))
    return at.withColumn("slot_", slot_of(F.col("t"), slot)).join(homes, ["series_id", "level_", "slot_"]).where("t BETWEEN start_s AND end_s").drop("level_", "slot_")


def first_overlap(segments: DataFrame, windows: DataFrame, slot: float = 10.0) -> DataFrame:
    """For each segment (series_id, seg_id, start_s, end_s) the first window, by win_id, that overlaps it strictly; null where none does."""
    pairs = overlapping(segments.select("series_id", "seg_id", "start_s", "end_s"), windows.select("series_id", "win_id", "start_s", "end_s"), slot)
    hits = pairs.groupBy("series_id", "seg_id").agg(F.min("win_id").alias("win_id"))
    return segments.select("series_id", "seg_id").distinct().join(hits, ["series_id", "seg_id"], "left")


def nearest_within(targets: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """For each target (series_id, k, goal) the nearest point (series_id, t) within ``tolerance``, the earlier of equals; null where there is none.

    Points lie in slots of twice the tolerance; a target meets those that its range touches, two at most.
    """
    length = 2 * tolerance
    a = targets.select("series_id", "k", "goal", slots(F.col("goal") - tolerance, F.col("goal") + tolerance, length).alias("slot_"))
    b = points.select("series_id", "t", F.floor(F.col("t") / length).alias("slot_"))
    hits = a.join(b, ["series_id", "slot_"]).where(F.abs(F.col("t") - F.col("goal")) <= tolerance)
    best = hits.groupBy("series_id", "k", "goal").agg(F.min_by("t", F.struct(F.abs(F.col("t") - F.col("goal")), "t")).alias("t"))
    return targets.select("series_id", "k", "goal").distinct().join(best, ["series_id", "k", "goal"], "left")


def overlap_audit(scenes: DataFrame) -> DataFrame:
    """Rows (series_id, pos, start_s, end_s) that start before the furthest end so far ('overlap') or after it ('gap')."""
    reach = F.max("end_s").over(Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(F.col("start_s") < F.col("reach") - 1e-9, "overlap").when(F.col("start_s") > F.col("reach") + 1e-9, "gap")
    return scenes.withColumn("reach", reach).withColumn("violation", kind).where("violation IS NOT NULL").select("series_id", "pos", "violation")


def clamp(intervals: DataFrame, start: float, end: float) -> DataFrame:
    """The parts of intervals within [start, end]; empty ones go."""
    return intervals.withColumns({"start_s": F.greatest("start_s", F.lit(start)), "end_s": F.least("end_s", F.lit(end))}).where("end_s > start_s")
