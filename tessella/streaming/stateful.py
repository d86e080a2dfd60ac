"""Streams with state of their own: runs of samples closed by the watermark, frames kept once, sessions that expire.

The state lies in a store on disk, by key and by name within a key, so a batch reads and writes what it touches and nothing else. These
functions set the session's state store to the one that such state needs (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import StructType

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State by name needs this store; a session that has another one set keeps it only for queries started before."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _micros(seconds: float) -> int:
    return round(seconds * 1e6)


class _Runs(StatefulProcessor):
    """Samples wait in a list until the watermark has passed them; then they are taken in order and extend, or end, the open run of their series."""

    def __init__(self, join_s: float, idle_s: float, least_s: float):
        self.join, self.idle, self.least = _micros(join_s), _micros(idle_s), _micros(least_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, hot boolean, value double")
        self.open = handle.getValueState("open", "first long, last long, n long, peak double, parted boolean")

    def _settled(self, key: tuple, waiting: list[tuple], upto: int) -> Iterator[pd.DataFrame]:
        """Take the waiting samples up to a time, tell the runs that end, and wake up again when the next may."""
        run = self.open.get() if self.open.exists() else None
        done = []
        ready = sorted((w for w in waiting if w[0] <= upto), key=lambda w: (w[0], not w[1], w[2]))
        for at, hot, value in ready:
            near = run is not None and at - run[1] <= (self.join if run[4] else self.idle)
            if hot:
                if near:
                    run = (run[0], at, run[2] + 1, max(run[3], value), False)
                else:
                    done.append(run)
                    run = (at, at, 1, value, False)
            elif run is not None:
                if at - run[1] > self.join:
                    done.append(run)
                    run = None
                else:
                    run = (*run[:4], True)
        if run is not None and upto - run[1] >= (self.join if run[4] else self.idle):
            done.append(run)
            run = None
        rest = [w for w in waiting if w[0] > upto]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if run is not None:
            self.open.update(run)
        else:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = [w[0] for w in rest] + ([run[1] + (self.join if run[4] else self.idle)] if run else [])
        if wake:
            self.handle.registerTimer(min(wake) // 1000 + 1)
        told = [r for r in done if r is not None and r[1] - r[0] >= self.least]
        if told:
            first, last, n, peak, _ = zip(*told)
            yield pd.DataFrame({"series_id": [key[0]] * len(told), "start_us": first, "end_us": last, "n_hot": n, "peak": peak})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        for part in rows:
            waiting.extend(zip(part["us"].tolist(), part["hot"].tolist(), part["value"].tolist()))
        yield from self._settled(key, waiting, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        yield from self._settled(key, waiting, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def hot_runs(samples: DataFrame, lateness: str, join_s: float = 1.0, idle_s: float = 60.0, least_s: float = 0.4) -> DataFrame:
    """(series_id, start_us, end_us, n_hot, peak) of a stream (series_id, at timestamp, hot boolean, value): the runs that ``signals.hot_runs`` finds.

    Hot samples with none but hot ones between them are one run if no more than ``idle_s`` apart, with others between them if no more than ``join_s``
    apart; runs shorter than ``least_s`` are not told. Samples may come in any order within ``lateness``; later ones are dropped.
    A run is told once the watermark shows that nothing can extend it. Samples with a null time, flag or value are passed over.
    The state of a series is its samples since the watermark and one open run.
    """
    use_state_store(samples.sparkSession)
    kind = samples.schema["series_id"].dataType.simpleString()
    rows = samples.where("at IS NOT NULL AND hot IS NOT NULL AND value IS NOT NULL").select("series_id", "at", F.unix_micros("at").alias("us"), "hot", F.col("value").cast("double").alias("value")).withWatermark("at", lateness)
    return rows.groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=_Runs(join_s, idle_s, least_s), outputStructType=f"series_id {kind}, start_us long, end_us long, n_hot long, peak double", outputMode="Append", timeMode="EventTime"
    )


def motion_runs(samples: DataFrame, stats: DataFrame, lateness: str, k: float = 1.5, **given: float) -> DataFrame:
    """``hot_runs`` of a stream (series_id, at timestamp, value) whose samples count as hot above median + k * MAD of their series, as a table (series_id, med, mad) has them
    from earlier samples; series that the table lacks have no runs."""
    hot = F.col("value") > F.col("med") + k * F.col("mad")
    return hot_runs(samples.join(stats.select("series_id", "med", "mad"), "series_id").select("series_id", "at", hot.alias("hot"), "value"), lateness, **given)


class _Kept(StatefulProcessor):
    """A map of a series' frames by name; only frames that it lacks go on. Names are forgotten by processing time or with their series."""

    def __init__(self, names: list[str], columns: list[str], lifetime_ms: int | None, quiet_ms: int | None):
        self.names, self.columns, self.lifetime, self.quiet = names, columns, lifetime_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "name string", "arrival long", self.lifetime)
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.quiet is not None and self.last.exists() and self.last.get()[0] // 1000 + self.quiet <= timerValues.getCurrentWatermarkInMs():
            self._forget()  # rows of a batch come before the timers that are due
        part = pd.concat(list(rows), ignore_index=True)
        part = part.sort_values("arrival", kind="stable")
        name = part[self.names].astype(object).where(part[self.names].notna(), None).apply(lambda r: repr(tuple(r)), axis=1) if len(part) else pd.Series(dtype=object)
        first = ~name.duplicated()
        part, name = part[first], name[first]
        new = [not self.held.containsKey((n,)) for n in name]
        for n, arrival in zip(name[new], part.loc[new, "arrival"]):
            self.held.updateValue((n,), (0 if pd.isna(arrival) else int(arrival),))
        if self.quiet is not None:
            last = max([int(part["us"].max()), *([self.last.get()[0]] if self.last.exists() else [])])
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(last // 1000 + self.quiet, timerValues.getCurrentWatermarkInMs() + 1))
        if any(new):
            yield part.loc[new, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        return iter(())

    def _forget(self) -> None:
        self.held.clear()
        self.last.clear()

    def close(self) -> None:
        pass


def absent_frames(frames: DataFrame, lifetime_s: float | None = None, quiet_s: float | None = None, lateness: str = "0 seconds", names: tuple[str, ...] = ("resolution", "format", "bucket", "label")) -> DataFrame:
    """The frames of a stream (series_id, label, arrival, ...) whose name their series did not have before; within a batch the first by ``arrival``.

    The names of a series are its own entries of the state, so the work of a batch follows the batch, whatever is kept already. With
    ``lifetime_s`` a name is forgotten so long after it was written, by the clock; with ``quiet_s`` all names of a series are forgotten when its last
    frame (``at`` timestamp) lies so long before the watermark. Only one of the two can be given; with neither, names are kept for good.
    A null series or label is a value like any other, a null arrival is the last; with ``quiet_s`` frames without a time are passed over.
    """
    if lifetime_s is not None and quiet_s is not None:
        raise ValueError("names expire by the clock or by event time, not by both")
    use_state_store(frames.sparkSession)
    columns = frames.columns
    rows = frames.where("at IS NOT NULL").withColumn("us", F.unix_micros("at")).withWatermark("at", lateness) if quiet_s is not None else frames
    processor = _Kept([c for c in names if c in columns], columns, None if lifetime_s is None else round(lifetime_s * 1000), None if quiet_s is None else round(quiet_s * 1000))
    mode = "EventTime" if quiet_s is not None else "ProcessingTime" if lifetime_s is not None else "None"
    return rows.groupBy("series_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType(frames.schema.fields), outputMode="Append", timeMode=mode)


def kept_frames_writer(frames: DataFrame, path: str, checkpoint: str, **expiry) -> DataStreamWriter:
    """A writer that appends absent frames to a folder by resolution. The folder's own log makes each batch count once, and nothing is read back."""
    return absent_frames(frames, **expiry).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).partitionBy("resolution").outputMode("append")
