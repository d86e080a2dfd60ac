"""Grey images in the P5 format as lit pixels."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_HEAD = re.compile(rb"P5(?:\s|#[^\n]*\n?)*(\d+)(?:\s|#[^\n]*\n?)+(\d+)(?:\s|#[^\n]*\n?)+(\d+)\s")


def pixels(body: bytes | None) -> tuple[int, int, np.ndarray] | None:
    """(width, height, values by row), or None for another format or too few bytes. Comments may stand in the head, of 256 bytes at most."""
    m = _HEAD.match(body[:256]) if body else None
    if not m:
        return None
    width, height = int(m[1]), int(m[2])
    if len(body) < m.end() + width * height:
        return None
    return width, height, np.frombuffer(body, np.uint8, width * height, m.end())


def lit_pixels(images: DataFrame) -> DataFrame:
    """(series_id, frame, x, y) for every pixel above zero of images (series_id, frame, content binary); those that cannot be read have none."""

    def run(batches):
        for batch in batches:
            found = [(k, image) for k, image in enumerate(map(pixels, batch.column("content").to_pylist())) if image and image[0]]
            while found:
                # as many images at once as have some four million pixels
                size = np.cumsum([len(image[2]) for _, image in found])
                now, found = found[: max(1, int(np.searchsorted(size, 1 << 22)))], found[max(1, int(np.searchsorted(size, 1 << 22))) :]
                values = np.concatenate([image[2] for _, image in now])
                length, width = (np.array(x, np.int64) for x in zip(*((len(image[2]), image[0]) for _, image in now)))
                at = np.flatnonzero(values)
                which = np.searchsorted(np.cumsum(length), at, side="right")
                place = at - (np.cumsum(length) - length)[which]
                take = pa.array(np.array([k for k, _ in now], np.int64)[which])
                x, y = place % width[which], place // width[which]
                yield pa.RecordBatch.from_arrays([batch.column("series_id").take(take), batch.column("frame").take(take), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], ["series_id", "frame", "x", "y"])

    kinds = ", ".join(f"{c} {images.schema[c].dataType.simpleString()}" for c in ("series_id", "frame"))
    return images.select("series_id", "frame", "content").mapInArrow(run, f"{kinds}, x int, y int")
