"""Streams with state by name: replays of shuffled samples against the batch operator, frames kept once, names that expire."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.operators import signals
from tessella.streaming import frames as streams
from tessella.streaming import stateful

SAMPLES = "series_id INT, at TIMESTAMP, hot BOOLEAN, value DOUBLE"
FRAMES = "series_id INT, resolution INT, label STRING, file STRING, arrival INT, at TIMESTAMP"


def stream_of(spark, folder, files, schema, at="us"):
    """A stream of one file a trigger, in the order of ``files``; times are given in microseconds."""
    plain = schema.replace("at TIMESTAMP", "at LONG")
    for k, rows in enumerate(files):
        frame = spark.createDataFrame(rows, plain).withColumn("at", F.timestamp_micros("at")).coalesce(1)
        frame.write.parquet(str(folder / "in" / f"part={k:03}"))
        time.sleep(0.02)  # files are taken by age
    return streams.read_frames(spark, str(folder / "in" / "*"), schema, 1)


def ran(stream, name, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return query


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_replayed_runs_equal_the_batch(spark, tmp_path):
    r = random.Random(1)
    rows = []
    for s in range(6):
        at = 0
        for _ in range(120):
            at += r.choice([100_000, 300_000, 900_000, 1_000_000, 1_000_001, 4_000_000, 9_000_000])
            rows.append((s, 1_700_000_000_000_000 + at, r.random() < 0.6, float(r.randrange(50))))
    rows += [(0, rows[5][1], True, 77.0), (1, rows[130][1], None, 1.0), (2, None, True, 1.0)]
    rows.sort(key=lambda x: (x[1] or 0) + r.randrange(20_000_000))  # 20 seconds out of order at most
    files = [rows[k : k + 180] for k in range(0, len(rows), 180)]
    files.append([(99, max(x[1] or 0 for x in rows) + 10**9, False, 0.0)])  # time goes on, so every run ends
    given = {"join_s": 1.0, "idle_s": 4.0, "least_s": 0.3}
    stream = stateful.hot_runs(stream_of(spark, tmp_path, files, SAMPLES), "60 seconds", **given)
    query = ran(stream, "runs", tmp_path)
    batch = signals.hot_runs(spark.createDataFrame(rows, SAMPLES.replace("at TIMESTAMP", "at LONG")).withColumn("at", F.timestamp_micros("at")), **given)
    got = sorted(map(tuple, spark.table("runs").collect()))
    assert len(got) > 50 and got == sorted(map(tuple, batch.select("series_id", "start_us", "end_us", "n_hot", "peak").collect()))
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) >= 6 and held[-1] <= 3  # what is left is the list of the last sample and its timer


def test_motion_runs_by_earlier_statistics(spark, tmp_path):
    second = 1_000_000
    rows = [(s, 1_700_000_000 * second + k * second, None, float(10 * s + (50 if 5 <= k < 9 else 0))) for s in (1, 2, 3) for k in range(20)] + [(1, 1_700_009_000 * second, None, 0.0)]
    stats = spark.createDataFrame([(1, 10.0, 2.0), (2, 20.0, 40.0)], "series_id int, med double, mad double")
    stream = stateful.motion_runs(stream_of(spark, tmp_path, [rows], SAMPLES), stats, "1 second", join_s=1.0, idle_s=5.0, least_s=0.5)
    ran(stream, "by_statistics", tmp_path)
    assert [tuple(r) for r in spark.table("by_statistics").collect()] == [(1, rows[5][1], rows[8][1], 4, 60.0)]


def kept_files(n, start=0):
    return [(k % 3, 384, f"l{start + k}", f"f{start + k}", start + k, 1_700_000_000_000_000 + (start + k) * 1_000_000) for k in range(n)]


def test_frames_are_kept_once(spark, tmp_path):
    one = kept_files(9)
    repeat = [(0, 384, "l0", "again", 50, one[0][5]), (0, 512, "l0", "larger", 51, one[0][5]), (1, 384, "new", "late", 53, one[0][5]), (1, 384, "new", "soon", 52, one[0][5]), (None, 384, None, "none", 54, one[0][5]), (None, 384, None, "none again", 55, one[0][5])]
    stream = stream_of(spark, tmp_path, [one, repeat, repeat], FRAMES)
    path = str(tmp_path / "kept")
    stateful.kept_frames_writer(stream, path, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    got = sorted((r.series_id, r.resolution, r.label, r.file) for r in spark.read.parquet(path).where("series_id IS NOT NULL").collect())
    assert got == sorted([*(r[:4] for r in one), (0, 512, "l0", "larger"), (1, 384, "new", "soon")])
    assert [r.file for r in spark.read.parquet(path).where("series_id IS NULL").collect()] == ["none"]


def test_a_series_is_forgotten_when_it_falls_quiet(spark, tmp_path):
    day = 86_400_000_000
    old, later = kept_files(300), [(7, 384, "x", "f", 1, 1_700_000_000_000_000 + 9 * day)]
    more = [(0, 384, "l0", "seen anew", 2, 1_700_000_000_000_000 + 9 * day)]
    stream = stateful.absent_frames(stream_of(spark, tmp_path, [old, later, more], FRAMES), quiet_s=7 * 86_400)
    query = ran(stream, "quiet", tmp_path)
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) >= 300 and held[-1] <= 15  # two names, with the times and timers of their series
    assert sorted(r.file for r in spark.table("quiet").where("label = 'l0'").collect()) == ["f0", "seen anew"]


def test_names_expire_by_the_clock(spark, tmp_path):
    one = kept_files(6)
    stream = stateful.absent_frames(stream_of(spark, tmp_path, [one], FRAMES), lifetime_s=6.0)
    query = stream.writeStream.format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "clock")).trigger(processingTime="1 second").start()

    def arrives(file, wait):
        frame = spark.createDataFrame([(*one[0][:3], file, 9, one[0][5])], FRAMES.replace("at TIMESTAMP", "at LONG")).withColumn("at", F.timestamp_micros("at"))
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={file}"))
        time.sleep(wait)
        return sorted(r.file for r in spark.table("clock").where("label = 'l0'").collect())

    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("clock").count() == 6:
                break
        arrives("at once", 1)
        time.sleep(12)
        got = arrives("anew", 8)
    finally:
        query.stop()
    assert got in (["anew", "f0"], ["anew", "at once", "f0"])  # whether the second comes in time depends on the machine
    with pytest.raises(ValueError):
        stateful.absent_frames(stream, lifetime_s=1.0, quiet_s=1.0)
