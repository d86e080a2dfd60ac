"""Streams of small files: windows, repeated labels, sessions that expire."""

from pyspark.sql import functions as F

from tessella.sources import json_texts
from tessella.streaming import frames as streams

AT = "2024-01-01 00:00:"


def ran(stream, name, folder, mode):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start().awaitTermination(180)
    return stream.sparkSession.table(name).collect()


def source(spark, folder, files, schema, at_once=1):
    shown = schema.replace("at TIMESTAMP", "at STRING")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, shown).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(folder / "in" / f"part={k}"))
    return streams.read_frames(spark, str(folder / "in" / "*"), schema, at_once)


def test_tiles_and_sliding_windows(spark, tmp_path):
    rows = [[(1, f"{AT}01", 2.0), (1, f"{AT}04", 4.0), (1, f"{AT}11", 9.0)], [(2, f"{AT}02", 5.0), (1, f"{AT}12", 1.0)]]
    stream = source(spark, tmp_path, rows, "series_id INT, at TIMESTAMP, score DOUBLE")
    got = {(r.series_id, r.start.second): (r.n_rows, r.mean, r.best) for r in ran(streams.tiles(stream, "10 seconds", "1 minute"), "tiled", tmp_path, "complete")}
    assert got == {(1, 0): (2, 3.0, 4.0), (1, 10): (2, 5.0, 9.0), (2, 0): (1, 5.0, 5.0)}
    slid = {(r.series_id, r.start.second): r.n_rows for r in ran(streams.sliding_means(stream.where("series_id = 1"), "10 seconds", "5 seconds", "1 minute"), "slid", tmp_path, "complete") if r.start.minute == 0}
    assert slid == {(1, 0): 2, (1, 5): 2, (1, 10): 2}


def test_first_of_label_and_late_frames(spark, tmp_path):
    files = [[(1, "a", f"{AT}05", 5.0, 9.0)], [(1, "a", f"{AT}06", 6.0, 9.0), (1, "b", f"{AT}06", 9.2, 9.0), (1, "c", f"{AT}07", 9.05, 9.0)]]
    stream = source(spark, tmp_path, files, "series_id INT, label STRING, at TIMESTAMP, t DOUBLE, duration_s DOUBLE")
    got = ran(streams.first_of_label(streams.within_assets(stream), "1 minute"), "labelled_once", tmp_path, "append")
    assert sorted((r.label, r.t) for r in got) in ([("a", 5.0), ("c", 9.05)], [("a", 6.0), ("c", 9.05)])


def test_sessions_expire(spark, tmp_path):
    files = [[(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05")], [(2, "2024-01-01 02:00:00")], [(2, "2024-01-01 04:00:00")]]
    stream = source(spark, tmp_path, files, "series_id INT, at TIMESTAMP")
    got = [(r.series_id, r.n_frames, r.expired) for r in ran(streams.live_sessions(stream, "0 seconds", 3600), "sessions", tmp_path, "update")]
    assert (1, 2, False) in got and (1, 2, True) in got and (2, 1, False) in got


def test_manifests_are_replaced(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = [(1, 384, "a", "old", 1), (1, 384, "a", "new", 2), (1, 512, "a", "x", 1)]
    schema = "series_id INT, resolution INT, label STRING, file STRING, arrival INT"
    for some in (rows, rows[:2]):
        json_texts.write_manifests(spark.createDataFrame(some, schema), path)
    assert [(r.resolution, r.file) for r in spark.read.parquet(path).collect()] == [(384, "new")]


MANIFEST = "series_id INT, resolution INT, label STRING, file STRING, arrival INT"


def manifest_rows(spark, path):
    return sorted(tuple(r) for r in json_texts.read_manifests(spark.createDataFrame([], MANIFEST), path).select("series_id", "resolution", "label", "file").collect())


def test_manifests_of_other_series_stay(spark, tmp_path):
    path = str(tmp_path / "m")
    made = lambda *rows: spark.createDataFrame(rows, MANIFEST)
    json_texts.write_manifests(made((1, 384, "a", "one", 1), (2, 384, "a", "two", 1), (None, 384, "a", "none", 1)), path)
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "m" / "series_id=2").iterdir()}
    json_texts.merge_manifests(made((1, 384, "a", "again", 2), (1, 384, "b", "later", 4), (1, 384, "b", "sooner", 3), (1, 512, "a", "large", 2), (3, 384, "a", "three", 1)), path)
    want = [(1, 384, "a", "one"), (1, 384, "b", "sooner"), (1, 512, "a", "large"), (2, 384, "a", "two"), (3, 384, "a", "three")]
    assert manifest_rows(spark, path) == want
    json_texts.merge_manifests(made((1, 384, "b", "sooner", 3)), path)
    assert manifest_rows(spark, path) == want
    json_texts.write_manifests(made((3, 512, "z", "new", 9)), path)
    assert manifest_rows(spark, path) == [*want[:4], (3, 512, "z", "new")]
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "m" / "series_id=2").iterdir()} == untouched


def test_a_merge_reads_the_folders_of_its_batch(spark, tmp_path):
    path = str(tmp_path / "m")
    json_texts.write_manifests(spark.createDataFrame([(k, 384, "a", "f", 1) for k in range(20)], MANIFEST), path)
    batch = spark.createDataFrame([(7, 384, "b", "g", 2), (9, 384, "b", "g", 2)], MANIFEST)
    held = json_texts._held_of(batch, path)
    assert held.count() == 2 and {f.split("series_id=")[1].split("/")[0] for f in held.inputFiles()} >= {"7", "9"} and "PartitionFilters: [series_id" in held._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.series_id for r in json_texts._held_of(batch, path, most=1).collect()) == [7, 9]


def test_late_frames_are_dropped(spark, tmp_path):
    files = [[(1, "a", f"{AT}50", 5.0, 9.0)], [(1, "b", f"{AT}51", 5.5, 9.0)], [(1, "late", f"{AT}05", 1.0, 9.0), (1, "in_time", f"{AT}45", 2.0, 9.0), (1, "outside", f"{AT}52", 9.2, 9.0), (1, "b", f"{AT}52", 5.5, 9.0)]]
    stream = source(spark, tmp_path, files, "series_id INT, label STRING, at TIMESTAMP, t DOUBLE, duration_s DOUBLE")
    query = streams.timely_frames(stream, "10 seconds").writeStream.format("memory").queryName("timely").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert {r.label for r in spark.table("timely").collect()} == {"a", "b", "in_time"}
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 1
