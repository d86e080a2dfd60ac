"""Streaming forms of operators whose state is bounded by a watermark, by a time to live, or kept in a folder.

Each takes a stream or, for tests and backfills, a batch of the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessella.operators import frame_cache


def read_frames(spark: SparkSession, path: str, schema: StructType | str, files_at_once: int) -> DataFrame:
    """A stream of Parquet files; a trigger takes ``files_at_once`` of them at most, however many wait."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def session_clusters(samples: DataFrame, gap: str, lateness: str) -> DataFrame:
    """(series_id, start, end, at, score, n_rows) from a stream (series_id, at timestamp, score): the best sample of each run of samples
    less than ``gap`` apart, the earliest of equals. A run is closed, and its state dropped, ``lateness`` after its end."""
    best = F.max_by(F.struct("at", "score"), F.struct("score", -F.unix_micros("at"))).alias("best")
    runs = samples.withWatermark("at", lateness).groupBy("series_id", F.session_window("at", gap).alias("run")).agg(best, F.count(F.lit(1)).alias("n_rows"))
    return runs.select("series_id", "run.start", "run.end", "best.at", "best.score", "n_rows")


def _windowed(samples: DataFrame, window, lateness: str) -> DataFrame:
    made = samples.withWatermark("at", lateness).groupBy("series_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("score").alias("mean"), F.max("score").alias("best"))
    return made.select("series_id", "w.start", "w.end", "n_rows", "mean", "best")


def tiles(samples: DataFrame, size: str, lateness: str) -> DataFrame:
    """(series_id, start, end, n_rows, mean, best) of samples (series_id, at timestamp, score) in tiles of one size, edge to edge."""
    return _windowed(samples, F.window("at", size), lateness)


def sliding_means(samples: DataFrame, size: str, step: str, lateness: str) -> DataFrame:
    """The same in windows of one size that begin every ``step``."""
    return _windowed(samples, F.window("at", size, step), lateness)


def first_of_label(frames: DataFrame, lateness: str) -> DataFrame:
    """Of frames (series_id, label, at timestamp, ...) that repeat a label the first to arrive; labels are forgotten ``lateness`` after their time."""
    return frames.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["series_id", "label"])


def within_assets(frames: DataFrame, slack: float = 0.1) -> DataFrame:
    """Frames (series_id, at timestamp, t, duration_s) that lie in their asset; those later than a watermark are dropped by what follows."""
    return frames.where(F.col("t") <= F.col("duration_s") + slack)


def timely_frames(frames: DataFrame, lateness: str, slack: float = 0.1) -> DataFrame:
    """Frames (series_id, label, at timestamp, t, duration_s, ...) that lie in their asset and arrive in time: one whose time is more than ``lateness`` before the
    latest seen, when its batch begins, is dropped, and so is a repeat of a series' label while the first is remembered."""
    return within_assets(frames, slack).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["series_id", "label"])


def live_sessions(frames: DataFrame, lateness: str, lifetime_s: int) -> DataFrame:
    """(series_id, n_frames, last_at, expired) from a stream (series_id, at timestamp): each batch tells the sessions that it touches, and those
    whose last frame is over ``lifetime_s`` before the watermark once more as expired; their state is then gone."""
    kind = frames.schema["series_id"].dataType.simpleString()

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            expired = True
        else:
            n, last = state.get if state.exists else (0, 0)
            for part in parts:
                n, last = n + len(part), max(last, int(part["at"].max().timestamp() * 1e6))
            state.update((n, last))
            state.setTimeoutTimestamp(max(last // 1000 + lifetime_s * 1000, state.getCurrentWatermarkMs() + 1))
            expired = False
        yield pd.DataFrame({"series_id": [key[0]], "n_frames": [n], "last_at": [pd.Timestamp(last, unit="us")], "expired": [expired]})

    grouped = frames.select("series_id", "at").withWatermark("at", lateness).groupBy("series_id")
    return grouped.applyInPandasWithState(update, f"series_id {kind}, n_frames long, last_at timestamp, expired boolean", "n long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def cache_writer(frames: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that inserts each batch's absent frames in the cache's folder; a repeated batch changes nothing."""
    return frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: frame_cache.insert_absent(batch, path))
