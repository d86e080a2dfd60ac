"""From drawn frames to delivered ones: rates and budgets by precedence, what fits, what is dropped and why."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import intervals

# By resolution up to a limit (the last holds above it): frames at a cap of 100,000 tokens, at 50,000, tokens of a frame,
# frames a second for thorough coverage, and frames a second that are drawn.
BANDS = ((384, 25, 200, 2700, 1.5, 1.5), (512, 17, 150, 3800, 3.0, 3.0), (768, 8, 75, 7000, 6.0, 6.0), (1024, 4, 30, 11000, 6.0, 6.0), (1536, 2, 20, 21000, 6.0, 12.5))
# Frames a second by duration below a limit, and beyond.
DURATION_RATES, LAST_RATE = ((60, 2.0), (300, 1.0), (900, 0.5), (3600, 0.2)), 0.1
# Tokens that a response may have, those of its texts, of a frame's heading, and characters of a token.
RESPONSE_CAP, TEXT_TOKENS, FRAME_TOKENS, TOKEN_CHARS = 88000, 12000, 50, 3.5


def by_resolution(resolution: Column, field: int) -> Column:
    """A value of ``BANDS``; ``field`` is its place there."""
    return F.coalesce(*(F.when(resolution <= b[0], F.lit(b[field])) for b in BANDS[:-1]), F.lit(BANDS[-1][field]))


def view_budget(resolution: Column, cap: Column) -> Column:
    """Frames that fit a response of ``cap`` tokens: by table at 100,000 and more and at 50,000, else in proportion to the latter."""
    base = by_resolution(resolution, 2)
    return F.when(cap >= 100000, by_resolution(resolution, 1)).when(cap == 50000, base).otherwise(F.greatest(F.lit(1), F.floor(base * (cap / 50000))))


def rate_by_duration(duration_s: Column) -> Column:
    return F.coalesce(*(F.when(duration_s < limit, F.lit(rate)) for limit, rate in DURATION_RATES), F.lit(LAST_RATE))


def preview_rate(asked: Column, view: Column, duration_s: Column, resolution: Column) -> Column:
    """Frames a second for an estimate: as asked, else by resolution, else the view over the duration, else by duration."""
    spread = F.when((view > 0) & (duration_s > 0), view / duration_s)
    return F.coalesce(asked, F.when(resolution.isNotNull(), by_resolution(resolution, 5)), spread, rate_by_duration(duration_s))


def drawing_rate(asked: Column, view: Column, start_s: Column, end_s: Column, duration_s: Column, resolution: Column, has_segments: Column) -> Column:
    """Frames a second when drawing: as above, but segments bring their own rates, and a view is spread over the asked range, of one
    second at least."""
    free = ~F.coalesce(has_segments, F.lit(False))
    active = F.greatest(F.lit(1.0), F.coalesce(end_s, duration_s) - F.coalesce(start_s, F.lit(0.0)))
    return F.coalesce(asked, F.when(free & resolution.isNotNull(), by_resolution(resolution, 5)), F.when(free & (view > 0), view / active), rate_by_duration(duration_s))


def transport_tokens(chars: Column, frames: Column, text_chars: Column | None = None) -> Column:
    """Tokens of a response: with a fixed allowance for its texts, or with a quarter of their characters where these are given."""
    texts = F.lit(TEXT_TOKENS) if text_chars is None else F.ceil(text_chars / 4)
    return F.ceil(chars / TOKEN_CHARS) + frames * FRAME_TOKENS + texts


def frames_that_fit(chars: Column, frames: Column) -> Column:
    """How many frames of the mean size fit, two at least; null without characters. The mean is over all frames, those without an image too."""
    each = chars / frames / TOKEN_CHARS + FRAME_TOKENS
    return F.when(chars > 0, F.greatest(F.lit(2), F.floor((RESPONSE_CAP - TEXT_TOKENS) / each)))


def density_floor(derived: Column, original: Column, active_s: Column) -> Column:
    """At least one frame in five seconds, and two, but no more than there were."""
    return F.greatest(derived, F.least(F.greatest(F.lit(2), F.ceil(active_s / 5)), original))


def probed_view(probe_chars: Column, view: Column, active_s: Column) -> Column:
    """The view after one probed frame: what fits at its size, by ``density_floor``; as it was where the probe has no characters."""
    fit = frames_that_fit(probe_chars, F.lit(1))
    return F.when(fit.isNull() | view.isNull(), view).otherwise(density_floor(fit, view, F.greatest(F.lit(0.0), active_s)))


def sized_view(view: Column, fit: Column) -> Column:
    """The view, lowered to what fits where it is over two and over that."""
    return F.when((view > 2) & (view > fit), fit).otherwise(view)


def in_range(frames: DataFrame, slack: float = 0.1) -> DataFrame:
    """Frames (series_id, t, duration_s, ...) with a column ``kept``: false for those over ``slack`` behind their asset's end."""
    return frames.withColumn("kept", F.col("t") <= F.col("duration_s") + slack)


def by_segments(frames: DataFrame, segments: DataFrame, slot: float = 10.0) -> DataFrame:
    """Frames (series_id, t, ...) with a column ``inside``: whether some segment (series_id, start_s, end_s) holds it, ends included.

    Both sides meet by series and time slot, on the level of a segment's length; no frame meets all segments of its series.
    """
    valid = segments.where("end_s >= start_s").select("series_id", "start_s", "end_s")
    levels = intervals.levels_of(valid, slot=slot) or [0]
    if len(levels) == 1:
        spread = intervals.leveled(valid, "start_s", "end_s", levels, slot).select(F.col("series_id").alias("s_"), "start_s", "end_s", "slot_")
        keyed = frames.withColumn("_slot", intervals.slot_of(F.col("t"), slot, F.lit(levels[0])))
        hit = (F.col("series_id") == F.col("s_")) & (F.col("_slot") == F.col("slot_")) & F.col("t").between(F.col("start_s"), F.col("end_s"))
        inside, outside = keyed.join(spread, hit, "left_semi").drop("_slot"), keyed.join(spread, hit, "left_anti").drop("_slot")
    else:  # times are looked up once, as a frame meets segments of several levels
        hits = intervals.within(frames.select("series_id", "t").distinct(), valid, slot).select("series_id", "t").distinct()
        inside, outside = frames.join(hits, ["series_id", "t"], "left_semi"), frames.join(hits, ["series_id", "t"], "left_anti")
    return inside.withColumn("inside", F.lit(True)).unionByName(outside.withColumn("inside", F.lit(False)))


def dropped(before: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``before`` whose (series_id, label) was not kept."""
    return before.join(kept.select("series_id", "label"), ["series_id", "label"], "left_anti")


def _even(n: int, count: int) -> np.ndarray:
    return np.arange(n) if count >= n else np.zeros(1, np.int64) if count == 1 else np.floor(np.arange(count) * (n - 1) / (count - 1) + 0.5).astype(np.int64)


def _fits(chars: float, n: int) -> bool:
    return -(-chars // TOKEN_CHARS) + n * FRAME_TOKENS + TEXT_TOKENS <= RESPONSE_CAP


def trimmed(frames: DataFrame) -> DataFrame:
    """(series_id, t, n_chars, moving, policy): frames (series_id, t, n_chars, moving) of each response, trimmed until they fit.

    A response of over two frames that does not fit keeps as many as fit at its mean size: moving frames first, evenly among
    themselves where they are too many, then still ones evenly; without moving frames ('uniform') all evenly. Then one frame after another goes,
    the rest evenly chosen anew, until it fits or two are left. One task holds the sizes of one response's frames.
    """

    def trim(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        chars = table.column("n_chars").fill_null(0).to_numpy()
        moving = table.column("moving").fill_null(False).to_numpy(zero_copy_only=False)
        n, kept, policy = len(chars), np.arange(len(chars)), "none"
        if n > 2 and not _fits(float(chars.sum()), n):
            fit = max(2, int((RESPONSE_CAP - TEXT_TOKENS) // (chars.sum() / n / TOKEN_CHARS + FRAME_TOKENS))) if chars.sum() else n - 1
            if fit < n:
                move, still = np.flatnonzero(moving), np.flatnonzero(~moving)
                if not len(move):
                    kept, policy = _even(n, fit), "uniform"
                elif len(move) >= fit:
                    kept, policy = move[_even(len(move), fit)], "motion-aware"
                else:
                    kept, policy = np.sort(np.concatenate([move, still[_even(len(still), fit - len(move))] if len(still) else still])), "motion-aware"
                while len(kept) > 2 and not _fits(float(chars[kept].sum()), len(kept)):
                    kept = kept[_even(len(kept), len(kept) - 1)]
        return table.take(pa.array(kept)).append_column("policy", pa.array([policy] * len(kept), pa.string()))

    kind = frames.schema["t"].dataType.simpleString()
    key = frames.schema["series_id"].dataType.simpleString()
    return frames.select("series_id", "t", F.col("n_chars").cast("long"), "moving").groupBy("series_id").applyInArrow(trim, f"series_id {key}, t {kind}, n_chars long, moving boolean, policy string")


def short_delivery(assets: DataFrame, frames: DataFrame) -> DataFrame:
    """(series_id, delivered, requested, last_t, remaining_s, cause, gap_start, gap_end) of responses with fewer frames than asked.

    assets: (series_id, view, trimmed, end_s, duration_s, fps). 'trimmed': frames were dropped to fit, and the largest gap, the first of
    equals, is told; 'rate': what is left after the last frame is shorter than a step; 'cap': frames are missing at the end.
    """
    by_time = Window.partitionBy("series_id").orderBy("t")
    gaps = frames.select("series_id", "t", F.lag("t").over(by_time).alias("before"))
    read = gaps.groupBy("series_id").agg(F.count(F.lit(1)).alias("delivered"), F.max("t").alias("last_t"), F.min("t").alias("first_t"), F.max_by(F.struct("before", "t"), F.when(F.col("before").isNotNull(), F.struct(F.col("t") - F.col("before"), -F.col("t")))).alias("gap"))
    rows = assets.join(read, "series_id").where(F.col("delivered") < F.col("view"))
    remaining = F.coalesce("end_s", "duration_s") - F.col("last_t")
    tail = (remaining > 0) & (remaining < 1.0 / F.col("fps") + 0.005)
    cause = F.when(F.col("trimmed") > 0, "trimmed").when(tail, "rate").otherwise("cap")
    of_gap = lambda name: F.when(cause == "trimmed", F.coalesce(F.col(f"gap.{name}"), F.col("first_t")))
    return rows.select("series_id", "delivered", F.col("view").alias("requested"), "last_t", remaining.alias("remaining_s"), cause.alias("cause"), of_gap("before").alias("gap_start"), of_gap("t").alias("gap_end"))


def crop_summary(segments: DataFrame) -> DataFrame:
    """(series_id, n_segments, n_cropped, n_crops) of segments (series_id, crop)."""
    return segments.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count("crop").alias("n_cropped"), F.count_distinct("crop").alias("n_crops"))


def token_split(blocks: DataFrame) -> DataFrame:
    """(series_id, total_tokens, text_tokens, image_tokens) of content blocks (series_id, kind, tokens), in one pass."""
    text = F.sum(F.when(F.col("kind") == "text", F.col("tokens")).otherwise(0))
    sums = blocks.groupBy("series_id").agg(F.sum("tokens").alias("total_tokens"), text.alias("text_tokens"))
    return sums.withColumn("image_tokens", F.col("total_tokens") - F.col("text_tokens"))


def response_rows(texts: DataFrame, images: DataFrame) -> DataFrame:
    """(series_id, place, kind, t, label): the headings and images of a response, in the order of their times, a heading before its image."""
    rows = texts.withColumn("kind", F.lit("text")).unionByName(images.withColumn("kind", F.lit("image")))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy("t", F.desc("kind"), "label"))
    return rows.select("series_id", place.alias("place"), "kind", "t", "label")
