"""Masks, the frame cache and the streaming forms, by hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import frame_cache, masks
from tessella.streaming import frames as streams

CACHED = "series_id INT, resolution INT, label STRING, file STRING, arrival INT"


def test_dilation_stops_at_the_edges(spark):
    mask = spark.createDataFrame([(1, 0, 0), (1, 9, 5)], "series_id INT, x INT, y INT")
    got = {(r.x, r.y) for r in masks.dilate(mask, 10, 6).collect()}
    assert got == {(x, y) for x in range(3) for y in range(3)} | {(x, y) for x in (7, 8, 9) for y in (3, 4, 5)}


def test_one_lit_frame_gives_no_mask(spark):
    pixels = spark.createDataFrame([(1, 0, 5, 5), (1, 0, 6, 5), (2, 0, 5, 5), (2, 1, 5, 5)], "series_id INT, frame INT, x INT, y INT")
    assert [tuple(r) for r in masks.union_mask(pixels).collect()] == [(2, 5, 5, 2)]


def test_blobs_match_a_flood_fill(spark):
    r = random.Random(4)
    lit = {s: {(r.randrange(20), r.randrange(12)) for _ in range(110)} for s in (1, 2)}
    lit[3] = {(x, y) for x in range(19) for y in range(11) if y % 2 == 0 or x == (18 if y % 4 == 1 else 0)}  # one winding path
    rows = spark.createDataFrame([(s, x, y) for s, p in lit.items() for x, y in p], "series_id INT, x INT, y INT")
    want = set()
    for s, left in lit.items():
        left, blob = set(left), 0
        while left:
            blob, todo, part = blob + 1, [min(left, key=lambda p: (p[1], p[0]))], set()
            while todo:
                x, y = todo.pop()
                if (x, y) in left:
                    left.remove((x, y))
                    part.add((x, y))
                    todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
            xs, ys = zip(*part)
            want.add((s, blob, len(part), min(xs), max(xs), min(ys), max(ys)))
    assert {tuple(x) for x in masks.blobs(rows).collect()} == want
    assert sum(s == 3 for s, *_ in want) == 1
    assert masks.blobs(rows.where("false")).count() == 0


@pytest.mark.parametrize(
    ("blobs", "box"),
    [
        ([(1, 400, 40, 59, 20, 39)], (311, 151, 178, 178)),  # 160 wide, 9 pixels of padding on each side
        ([(1, 400, 0, 19, 0, 19), (2, 200, 30, 39, 0, 19), (3, 199, 100, 110, 0, 19)], (0, 0, 338, 168)),
        ([(1, 19, 0, 18, 0, 0)], None),
        ([(1, 12241, 0, 159, 0, 89)], None),
    ],
)
def test_boxes(spark, blobs, box):
    found = spark.createDataFrame([(7, *b) for b in blobs], "series_id INT, blob INT, area LONG, min_x INT, max_x INT, min_y INT, max_y INT")
    got = masks.subject_boxes(found, 160, 90, 1280, 720).collect()
    assert [(r.left, r.top, r.w, r.h) for r in got] == ([box] if box else [])


def test_summary_lists_short_caches_only(spark):
    rows = [(1, 384, f"{k:02}", "f", k) for k in range(50)] + [(1, 512, f"{k:02}", "f", k) for k in range(51)]
    got = {r.resolution: r for r in frame_cache.summary(spark.createDataFrame(rows, CACHED)).collect()}
    assert got[384].labels == ",".join(f"{k:02}" for k in range(50)) and got[384].first_label is None
    assert got[512].labels is None and (got[512].frame_count, got[512].first_label, got[512].last_label) == (51, "00", "50")


def test_expiry(spark):
    rows = [
        (1, '{"created_at": "2024-01-01T00:00:00Z"}'),
        (2, '{"created_at": "2024-01-08T00:00:00Z"}'),  # exactly seven days old
        (3, "{broken"),
        (4, None),
        (5, '{"created_at": "long ago"}'),
        (6, "{}"),
    ]
    sessions = spark.createDataFrame(rows, "series_id INT, manifest STRING")
    assert {r.series_id for r in frame_cache.expired(sessions, "2024-01-15 00:00:00").collect()} == {1, 3}


def test_first_writer_of_a_frame_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    one = spark.createDataFrame([(1, 384, "a", "late", 2), (1, 384, "a", "early", 1), (1, 512, "a", "other", 3)], CACHED)
    two = spark.createDataFrame([(1, 384, "a", "again", 4), (1, 384, "b", "new", 5)], CACHED)
    for rows in (one, two, two):
        frame_cache.insert_absent(rows, path)
    got = frame_cache.stored(one, path).collect()
    assert sorted((r.resolution, r.label, r.file) for r in got) == [(384, "a", "early"), (384, "b", "new"), (512, "a", "other")]


def test_format_and_crop_keep_frames_apart(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "series_id INT, resolution INT, format STRING, bucket STRING, label STRING, file STRING, arrival INT"
    one = spark.createDataFrame([(k, 384, f, b, "a", f"{f}{b}", 1) for k in range(40) for f in ("jpeg", "png") for b in ("", "roi=1,2,3x4")], schema)
    frame_cache.insert_absent(one, path)
    frame_cache.insert_absent(one.withColumn("file", F.lit("again")).unionByName(spark.createDataFrame([(7, 384, "webp", "", "a", "new", 2)], schema)), path)
    got = frame_cache.stored(one, path).collect()
    assert len(got) == 161 and {r.file for r in got} == {"jpeg", "png", "jpegroi=1,2,3x4", "pngroi=1,2,3x4", "new"}


def test_streams(spark, tmp_path):
    at = "2024-01-01 00:00:"
    samples = [(1, f"{at}00", 3.0), (1, f"{at}01", 9.0), (1, f"{at}02", 9.0), (1, f"{at}20", 4.0), (2, f"{at}01", 1.0)]
    source = str(tmp_path / "samples")
    spark.createDataFrame(samples, "series_id INT, at STRING, score DOUBLE").withColumn("at", F.to_timestamp("at")).write.parquet(source)
    stream = spark.readStream.schema("series_id INT, at TIMESTAMP, score DOUBLE").parquet(source)
    found = streams.session_clusters(stream, "5 seconds", "1 seconds")
    query = found.writeStream.format("memory").queryName("found_clusters").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.series_id, r.at.second, r.score, r.n_rows) for r in spark.table("found_clusters").collect()}
    assert got == {(1, 1, 9.0, 3), (1, 20, 4.0, 1), (2, 1, 1.0, 1)}

    arrivals = str(tmp_path / "arrivals")
    spark.createDataFrame([(1, 384, "a", "x", 1), (1, 384, "a", "y", 2)], CACHED).write.parquet(arrivals)
    incoming = spark.readStream.schema(CACHED).parquet(arrivals)
    for _ in range(2):
        streams.cache_writer(incoming, str(tmp_path / "kept"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.file for r in frame_cache.stored(spark.createDataFrame([], CACHED), str(tmp_path / "kept")).collect()] == ["x"]


def test_images_of_any_event(spark, tmp_path):
    """Made of repeated rows instead of pixel by pixel; lit pixels of images of several sizes come out together."""
    from tessella.plans import mask_queries
    from tessella.sources import pgm

    spark.sql("SELECT id AS event_id, 1L AS user_id, CASE WHEN id % 7 > 0 THEN CAST(id % 31 - 12 AS DOUBLE) END AS value FROM range(-40, 200)").write.parquet(f"{tmp_path}/events.parquet")
    images = mask_queries._images(spark, str(tmp_path))
    assert "lambda" not in images._jdf.queryExecution().optimizedPlan().toString()
    want = "array_join(transform(sequence(0L, 383L), k -> CASE WHEN {} THEN 'C8' ELSE lpad(hex((frame * k) % 8), 2, '0') END), '')".format(mask_queries._LIT.format(x="k % 24", y="k div 24", e="frame", v="v"))
    told = {r.frame: r.c for r in mask_queries.over(spark, str(tmp_path), mask_queries._IMAGES, "events").selectExpr("frame", f"unhex({want}) AS c").collect()}
    assert {r.frame: r.content[13:] for r in images.collect()} == told and len(told) == 240
    bodies = [b"P5 2 1 255\n\x00\x01", b"P6 1 1 255\n\x01", b"P5 1 3 255\n\x05\x00\x06", None, b"P5 2 2 255\n\x00\x00\x00\x00", b"P5 3 1 255\n\x00\x00\x01"]
    rows = pgm.lit_pixels(spark.createDataFrame([(k, 10 + k, b) for k, b in enumerate(bodies)], "series_id INT, frame INT, content BINARY"))
    assert sorted(map(tuple, rows.collect())) == [(0, 10, 1, 0), (2, 12, 0, 0), (2, 12, 0, 2), (5, 15, 2, 0)]


def test_masks_are_cut_between_series_only(spark, monkeypatch):
    """Many series meet in one call and one series spans several batches; both ways to the blobs agree, by plain sets."""
    monkeypatch.setattr(masks, "CELLS", 700)  # a few grids at once
    r = random.Random(12)
    lit = {f"s{k}" if k else None: {(r.randrange(-3, 18), r.randrange(-3, 12)) for _ in range(1 + 3 * (k % 40))} for k in range(130)}
    mask = spark.createDataFrame([(s, x, y) for s, p in lit.items() for x, y in p] + [("gone", None, 4)], "series_id STRING, x INT, y INT").repartition(3)
    near = {(s, x + i, y + j) for s, p in lit.items() for x, y in p for i in range(-2, 3) for j in range(-2, 3) if 0 <= x + i < 15 and 0 <= y + j < 9}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in ("17", "100000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            dilated = masks.dilate(mask, 15, 9)
            got = [tuple(x) for x in dilated.collect()]
            assert set(got) == near and len(got) == len(near)
            parts = {tuple(x) for x in masks.dilated_blobs(mask, 15, 9).collect()}
            assert parts == {tuple(x) for x in masks.blobs(dilated).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(s, sum(p[2] for p in parts if p[0] == s)) for s in lit if any(n[0] == s for n in near)} == {(s, sum(n[0] == s for n in near)) for s in lit if any(n[0] == s for n in near)}
    far = spark.createDataFrame([(s, x, y) for s in (1, 2) for x, y in ((0, 0), (2**31 - 2, 2**31 - 2), (2**31 - 2, 2**31 - 3), (0, 2**31 - 2))], "series_id INT, x INT, y INT")
    assert sorted((b.series_id, b.blob, b.area) for b in masks.blobs(far).collect()) == [(s, *b) for s in (1, 2) for b in ((1, 1), (2, 2), (3, 1))]


def test_blobs_of_a_mask_are_made_once(spark):
    """Dilated pixels are neither rows nor shuffled, and boxes read the blobs once."""
    mask = spark.createDataFrame([(1, 5, 5)], "series_id INT, x INT, y INT")
    plan = masks.subject_boxes(masks.dilated_blobs(mask, 160, 90), 160, 90, 1280, 720)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan and plan.count("MapInArrow") == 1


def test_series_stay_whole_behind_a_join(spark):
    """The join of a united mask may become a broadcast while the query runs; the shuffle by series has to stay."""
    pixels = spark.range(8400).selectExpr("id % 7 AS series_id", "CAST(id % 3 AS INT) AS frame", "CAST(id div 7 % 40 AS INT) AS x", "CAST(id div 280 AS INT) AS y")
    found = masks.dilated_blobs(masks.union_mask(pixels), 40, 30)
    assert [(b.area, b.blob) for b in found.collect()] == [(1200, 1)] * 7
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
