"""Grey images in, motion out: differences of consecutive frames, the crop around what moves, and small masks for the blob detector.

Images are rows (series_id, frame, t, content) with content in the P5 format. Frames of a series are put in order by their numbers alone;
an image meets the one before it by series and frame number, so no task holds or sorts the images of a series. Masks are images too, of the values 0 and 255.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import intervals, masks
from tessella.sources import pgm

# The difference that counts as motion, masks a second and at most, their width and least height.
THRESHOLD, PER_SECOND, MOST_MASKS, WIDTH, LEAST_HEIGHT = 10, 2, 24, 160, 40


def _p5(width: int, height: int, values: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (width, height) + values.astype(np.uint8).tobytes()


def _difference(one: bytes | None, other: bytes | None, threshold: int) -> bytes | None:
    a, b = pgm.pixels(one), pgm.pixels(other)
    if a is None or b is None or a[:2] != b[:2]:
        return None
    moved = np.abs(a[2].astype(np.int16) - b[2].astype(np.int16)) > threshold
    return _p5(a[0], a[1], moved * np.uint8(255))


def differences(images: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(series_id, frame, t, before_t, content): for each image but a series' first the mask of the pixels that differ from the image before by more than ``threshold``.

    Content is null where either image cannot be read or their sizes differ. Rows without a frame number are left out; a frame that a source repeats
    stands for itself each time.
    """
    rows = images.where("frame IS NOT NULL")
    order = rows.select("series_id", "frame").distinct().withColumn("before", F.lag("frame").over(Window.partitionBy("series_id").orderBy("frame"))).where("before IS NOT NULL")
    earlier = rows.select("series_id", F.col("frame").alias("before"), F.col("t").alias("before_t"), F.col("content").alias("one"))
    pairs = rows.select("series_id", "frame", "t", F.col("content").alias("other")).join(order.join(earlier, ["series_id", "before"]), ["series_id", "frame"])

    def run(batches):
        for batch in batches:
            masks_ = [_difference(a, b, threshold) for a, b in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("series_id", "frame", "t", "before_t")), pa.array(masks_, pa.binary())], ["series_id", "frame", "t", "before_t", "content"])

    kinds = ", ".join(f"{c} {images.schema[s].dataType.simpleString()}" for c, s in (("series_id", "series_id"), ("frame", "frame"), ("t", "t"), ("before_t", "t")))
    return pairs.select("series_id", "frame", "t", "before_t", "one", "other").mapInArrow(run, f"{kinds}, content binary")


def crop_boxes(moving: DataFrame, limit: float = 20.0) -> DataFrame:
    """(series_id, frame, x, y, w, h): after each mask the box around all rows and columns whose mean was over ``limit`` in it or in a mask before, at even places
    and of even size; no row before there is one."""

    def run(batches):
        for batch in batches:
            found = []
            for body in batch.column("content").to_pylist():
                image = pgm.pixels(body)
                sides = [None] * 4
                if image and image[0] and image[1]:
                    values = image[2].reshape(image[1], image[0])
                    across, down = np.flatnonzero(values.mean(axis=0) > limit), np.flatnonzero(values.mean(axis=1) > limit)
                    if len(across) and len(down):
                        sides = [int(v) for v in (across[0], across[-1], down[0], down[-1])]
                found.append(sides)
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), batch.column("frame"), *(pa.array(c, pa.int32()) for c in zip(*found))], ["series_id", "frame", "x0", "x1", "y0", "y1"])

    kinds = ", ".join(f"{c} {moving.schema[c].dataType.simpleString()}" for c in ("series_id", "frame"))
    edges = moving.select("series_id", "frame", "content").mapInArrow(run, f"{kinds}, x0 int, x1 int, y0 int, y1 int")
    so_far = Window.partitionBy("series_id").orderBy("frame").rangeBetween(Window.unboundedPreceding, 0)
    grown = edges.withColumns({c: (F.min if c.endswith("0") else F.max)(c).over(so_far) for c in ("x0", "x1", "y0", "y1")}).where("x0 IS NOT NULL")
    even = lambda low, high: (F.col(low) + F.col(low) % 2, F.col(high) - F.col(low) - F.col(low) % 2 + 1)
    (x, w), (y, h) = even("x0", "x1"), even("y0", "y1")
    return grown.select("series_id", "frame", x.alias("x"), y.alias("y"), (w - w % 2).alias("w"), (h - h % 2).alias("h")).where("w > 0 AND h > 0")


def grid_of(frame_w: int, frame_h: int) -> tuple[int, int]:
    """The size of a mask for frames of this size: ``WIDTH`` wide and in proportion, of even height, never larger than the frame."""
    height = max(LEAST_HEIGHT, int(frame_h * (WIDTH / frame_w) / 2 + 0.5) * 2)
    return min(WIDTH, frame_w), min(height, frame_h)


def _smaller(body: bytes | None, width: int, height: int) -> bytes | None:
    image = pgm.pixels(body)
    if image is None or not image[0] or not image[1]:
        return None
    w, h = min(width, image[0]), min(height, image[1])
    lit = (image[2] > 0).reshape(image[1], image[0])
    rows = np.logical_or.reduceat(lit, np.arange(h) * image[1] // h, axis=0)
    return _p5(w, h, np.logical_or.reduceat(rows, np.arange(w) * image[0] // w, axis=1) * np.uint8(255))


def smaller(moving: DataFrame, width: int, height: int) -> DataFrame:
    """The masks on a grid of at most ``width`` by ``height``: a cell is lit where any of its pixels is. Masks are never enlarged."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("content")
            yield batch.set_column(at, "content", pa.array([_smaller(b, width, height) for b in batch.column(at).to_pylist()], pa.binary()))

    return moving.mapInArrow(run, moving.schema)


def mask_scan(moving: DataFrame, windows: DataFrame, per_second: float = PER_SECOND, most: int = MOST_MASKS, slot: float = 10.0) -> DataFrame:
    """(series_id, win_id, frame, t, content): for each window (series_id, win_id, start_s, end_s) the first mask of every 1/``per_second`` of its time, ``most`` at most.

    A mask belongs to a window if both its images do, ends included. Which masks are taken is settled on times alone; then the masks are fetched.
    """
    times = moving.where("content IS NOT NULL").select("series_id", "frame", "t", "before_t").distinct()
    held = intervals.within(times, windows.select("series_id", "win_id", "start_s", "end_s"), slot).where("before_t >= start_s")
    place = Window.partitionBy("series_id", "win_id")
    first = held.withColumn("tick", F.floor((F.col("t") - F.col("start_s")) * per_second)).groupBy("series_id", "win_id", "tick").agg(F.min(F.struct("t", "frame")).alias("m"))
    taken = first.withColumn("place", F.row_number().over(place.orderBy("tick"))).where(F.col("place") <= most).select("series_id", "win_id", F.col("m.frame").alias("frame"))
    return taken.join(moving.select("series_id", "frame", "t", "content"), ["series_id", "frame"]).select("series_id", "win_id", "frame", "t", "content")


def boxes_of(moving: DataFrame, windows: DataFrame, grid: tuple[int, int], frame: tuple[int, int], least_s: float = 1.0) -> DataFrame:
    """(series_id, win_id, left, top, w, h, area_pct, confidence): the box, in pixels of the frame, of what the masks light in each window (series_id, win_id,
    start_s, end_s), found on a grid.

    Windows shorter than ``least_s``, those with fewer than two lit masks and those whose blobs give no box have nulls.
    """
    key = F.concat_ws("/", F.col("series_id").cast("string"), F.col("win_id").cast("string")).alias("key")
    scanned = smaller(mask_scan(moving, windows.where(F.col("end_s") - F.col("start_s") >= least_s)), *grid)
    pixels = pgm.lit_pixels(scanned.select(key, "frame", "content").withColumnRenamed("key", "series_id"))
    boxes = masks.subject_boxes(masks.dilated_blobs(masks.union_mask(pixels), *grid), *grid, *frame).withColumnRenamed("series_id", "key")
    return windows.select("series_id", "win_id", key).join(boxes, "key", "left").drop("key")


def window_boxes(images: DataFrame, windows: DataFrame, frame_w: int, frame_h: int, least_s: float = 1.0) -> DataFrame:
    """From images (series_id, frame, t, content) of one size to the box of what moves in each window: ``boxes_of`` their differences on the grid
    for frames of this size."""
    return boxes_of(differences(images), windows, grid_of(frame_w, frame_h), (frame_w, frame_h), least_s)
