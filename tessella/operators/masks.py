"""Motion masks as rows (series_id, frame, x, y), one for each lit pixel, on a grid of fixed size.

Masks are united and boxed by plain DataFrame work, dilated and labelled by NumPy in tasks that hold a batch of series each. A series' mask has
at most ``width * height`` rows, however many frames it has, as its frames are united first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import intervals

#: Cells of grids that are dilated at once.
CELLS = 1 << 22

def union_mask(pixels: DataFrame, least_frames: int = 2) -> DataFrame:
    """(series_id, x, y, energy): each lit pixel and how many rows light it. Series with fewer than ``least_frames`` lit frames have no rows.

    The energy counts a pixel once for each of its rows; a source that repeats a pixel within a frame has to drop the repeats before.
    """
    usable = pixels.groupBy("series_id").agg(F.count_distinct("frame").alias("frames")).where(F.col("frames") >= least_frames)
    energy = pixels.groupBy("series_id", "x", "y").agg(F.count("frame").alias("energy"))
    return energy.join(usable.select("series_id"), "series_id", "left_semi")


def _whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches sorted by their first column, cut between series only."""
    held: list[pa.RecordBatch] = []
    for batch in (b for b in batches if len(b)):
        keys = batch.column(0).dictionary_encode("encode").indices.to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if not len(cuts) and held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
            cuts = np.array([0])
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = []
        held.append(batch.slice(int(cuts[-1]) if len(cuts) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _by_series(mask: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, ...]]], columns: str) -> DataFrame:
    """(series_id, ``columns``): what ``work`` tells of the pixels of whole series, many series at once, so that none costs a call of its own.

    It takes the numbers of the series, ascending from 0, x and y, and gives the numbers of its rows' series and the columns. A task holds a batch and one series.
    """
    # dealt by a hash of the series: where the rows lie by series already, a shuffle by series itself is left out, and a join before it that turns into a broadcast then splits them
    pixels = mask.select("series_id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL").repartition(F.xxhash64("series_id")).sortWithinPartitions("series_id")
    names = ["series_id", *(c.split()[0] for c in columns.split(", "))]
    kinds = [{"int": pa.int32(), "bigint": pa.int64()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_series(batches):
            keys = table.column(0).combine_chunks()
            code = keys.dictionary_encode("encode").indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            series = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
            for number, *values in work(series, *(table.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(starts[number])), *(pa.array(v).cast(k) for v, k in zip(values, kinds))], names)

    return pixels.mapInArrow(run, f"series_id {mask.schema['series_id'].dataType.simpleString()}, {columns}")


def _dilated(series: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, height: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(series, x, y) of the pixels within ``times`` steps, in row order; series by series on grids with a margin of ``times``, ``CELLS`` cells at once."""
    wide, high = width + 2 * times, height + 2 * times
    inside = (x >= -times) & (x < width + times) & (y >= -times) & (y < height + times)
    series, x, y = series[inside], x[inside], y[inside]
    step = max(1, CELLS // (wide * high))
    for first in range(0, int(series.max(initial=-1)) + 1, step):
        lo, hi = np.searchsorted(series, [first, first + step])
        lit = np.zeros((min(step, int(series[-1]) + 1 - first), high, wide), bool)
        lit[series[lo:hi] - first, y[lo:hi] + times, x[lo:hi] + times] = True
        across = np.logical_or.reduce([lit[:, :, d : d + width] for d in range(2 * times + 1)])
        number, row, column = np.nonzero(np.logical_or.reduce([across[:, d : d + height] for d in range(2 * times + 1)]))
        yield number + first, column, row


def dilate(mask: DataFrame, width: int, height: int, times: int = 2) -> DataFrame:
    """(series_id, x, y) of all pixels on the grid within ``times`` steps, diagonal ones included, of a pixel of the mask.

    Repeated dilation by a 3 x 3 square is one dilation by a larger square. Pixels are shuffled before they are dilated, each once.
    """
    kind = "bigint" if "bigint" in (mask.schema[c].dataType.simpleString() for c in ("x", "y")) else "int"
    return _by_series(mask, partial(_dilated, width=width, height=height, times=times), f"x {kind}, y {kind}")


def _labelled(series: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(series, blob, area, min_x, max_x, min_y, max_y) of the 4-connected parts of each series' pixels, by runs of neighbours in a row."""
    if not len(x):
        return
    left, top = int(x.min()), int(y.min())
    wide, high = int(x.max()) - left + 2, int(y.max()) - top + 2  # the last column has no right neighbour, the last row none below
    step = max(1, 2**62 // (wide * high))
    if step <= series[-1]:  # pixels too far apart to be told by one number
        for k in np.unique(series):
            one = series == k
            yield from ((found + k, *rest) for found, *rest in _labelled(series[one] - k, x[one], y[one]))
        return
    code = np.unique((series * high + y - top) * wide + x - left)
    begins = np.concatenate([[True], code[1:] != code[:-1] + 1])
    start, run = np.flatnonzero(begins), np.cumsum(begins) - 1
    size = np.diff(np.append(start, len(code)))
    at = np.minimum(np.searchsorted(code, code + wide), len(code) - 1)
    met = np.flatnonzero(code[at] == code + wide)
    a, b = run[met], run[at[met]]
    first = np.arange(len(start))
    while True:
        low, high_end = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
        apart = low != high_end
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(first, high_end[apart], low[apart])
        while (first[first] != first).any():
            first = first[first]
    order = np.argsort(first, kind="stable")
    roots, cut = np.unique(first[order], return_index=True)
    row, from_x = np.divmod(code[start][order], wide)
    over = lambda f, v: f.reduceat(v, cut)
    number = row[cut] // high
    blob = np.arange(1, len(roots) + 1) - np.searchsorted(number, number)
    row = row % high + top
    yield number, blob, over(np.add, size[order]), over(np.minimum, from_x) + left, over(np.maximum, from_x + size[order] - 1) + left, over(np.minimum, row), over(np.maximum, row)


_BLOB = "blob int, area bigint, min_x int, max_x int, min_y int, max_y int"


def blobs(mask: DataFrame) -> DataFrame:
    """(series_id, blob, area, min_x, max_x, min_y, max_y): the 4-connected parts of each series' distinct pixels, numbered from 1 in row order."""
    return _by_series(mask, _labelled, _BLOB)


def dilated_blobs(mask: DataFrame, width: int, height: int, times: int = 2) -> DataFrame:
    """The blobs of the dilated mask, without a row for each pixel of it: both are told where a series' pixels are."""

    def work(series: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for number, near_x, near_y in _dilated(series, x, y, width, height, times):
            yield from _labelled(number, near_x, near_y)

    return _by_series(mask, work, _BLOB)


def subject_boxes(found: DataFrame, width: int, height: int, frame_w: int, frame_h: int) -> DataFrame:
    """(series_id, left, top, w, h, area_pct, confidence): a padded box in frame pixels around the blobs of at least half the largest one's area.

    Series whose largest blob is smaller than 20 pixels or 0.2 % of the grid, or larger than 85 % of it, have no box, nor have those
    whose box would be narrower or lower than 20 frame pixels.
    """
    largest = found.where("series_id IS NOT NULL").withColumn("top_area", F.max("area").over(Window.partitionBy("series_id")))
    sized = largest.where((F.col("top_area") >= max(20, width * height * 0.002)) & (F.col("top_area") <= width * height * 0.85))
    around = (
        sized.where(F.col("area") >= F.col("top_area") * 0.5)
        .groupBy("series_id")
        .agg(F.min("min_x").alias("x0"), F.max("max_x").alias("x1"), F.min("min_y").alias("y0"), F.max("max_y").alias("y1"))
    )

    def side(low: str, high: str, frame: int, grid: int, start: str, size: str) -> tuple[dict, dict, dict]:
        scale = frame / grid
        near = {start: F.floor(F.col(low) * F.lit(scale)), size: F.ceil((F.col(high) - F.col(low) + 1) * F.lit(scale))}
        fit = {size: F.least(F.lit(frame) - F.col(start), F.col(size))}
        pad = F.floor(F.col(size) * F.lit(0.06))
        before = F.least(pad, F.col(start))
        grown = {start: F.col(start) - before, size: F.least(F.lit(frame) - (F.col(start) - before), F.col(size) + before + pad)}
        return near, fit, grown

    across, down = side("x0", "x1", frame_w, width, "left", "w"), side("y0", "y1", frame_h, height, "top", "h")
    for a, b in zip(across, down):
        around = around.withColumns(a | b)
    even = around.withColumns({"w": F.col("w") - F.col("w") % 2, "h": F.col("h") - F.col("h") % 2}).where("w >= 20 AND h >= 20")
    share = F.col("w") * F.col("h") / F.lit(float(frame_w * frame_h)) * 100
    return even.withColumn("share", share).select(
        "series_id",
        "left",
        "top",
        "w",
        "h",
        (F.floor(F.col("share") * 10 + 0.5) / 10.0).alias("area_pct"),
        F.when(F.col("share").between(10, 70), 0.9).when(F.col("share") < 10, 0.4).otherwise(0.6).alias("confidence"),
    )


def boxes_by_window(pixels: DataFrame, windows: DataFrame, width: int, height: int, frame_w: int, frame_h: int, slot: float = 10.0, least_s: float = 1.0) -> DataFrame:
    """(series_id, win_id, left, top, w, h, area_pct, confidence) for each window (series_id, win_id, start_s, end_s): the box of what the pixels
    (series_id, frame, t, x, y) of its time light, ends included; nulls where there is none, and for windows shorter than ``least_s``.

    Pixels and windows meet by series and time slot.
    """
    named = windows.withColumn("key", F.concat_ws("/", F.col("series_id").cast("string"), F.col("win_id").cast("string")))
    held = intervals.within(pixels, named.where(F.col("end_s") - F.col("start_s") >= least_s).select("series_id", "key", "start_s", "end_s"), slot).select(F.col("key").alias("series_id"), "frame", "x", "y")
    boxes = subject_boxes(dilated_blobs(union_mask(held), width, height), width, height, frame_w, frame_h).withColumnRenamed("series_id", "key")
    return named.select("series_id", "win_id", "key").join(boxes, "key", "left").drop("key")
