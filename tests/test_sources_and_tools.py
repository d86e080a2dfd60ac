"""Tail reads, table functions, motion masks, contracts and intervals of any length, against brute force and hand-made cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import cost
from tessella.functions import table_functions
from tessella.operators import contracts, delivery, fanin, intervals, motion_masks, planning, reports, requests, signals, subjects
from tessella.sources import json_texts, pgm, tails

# --- logs read from their ends


def line(model) -> str:
    return json.dumps({"message": {"model": model}})


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_tail_equals_whole_read(spark, tmp_path, block):
    r = random.Random(block)
    whole = []
    for k in range(60):
        lines = [r.choice([line(f"m{r.randrange(99)}"), line(""), line(5), '{"message": {"model": "cut', "{}", "", '["model"]', '{"model": "top"}', '{"message": {"model": "ü中"}}', '{"message": {"model": NaN}}', "\xff model"]) for _ in range(r.randrange(0, 30))]
        text = "\n".join(lines) + r.choice(["", "\n"])
        (tmp_path / f"log{k:02}.jsonl").write_text(text)
        whole.append((f"log{k:02}", text))
    (tmp_path / "_hidden").write_text(line("hidden"))
    want = {r.series_id: r.model for r in json_texts.last_model(spark.createDataFrame(whole, "series_id string, content string")).collect()}
    spark.dataSource.register(tails.TailModels)
    got = spark.read.format("tail_models").options(block_bytes=block, partition_bytes=1000).load(str(tmp_path)).collect()
    assert {r.file.rsplit("/", 1)[1][:5]: r.model for r in got if r.model} == want and "hidden" not in {r.model for r in got}


def test_a_long_log_costs_one_block(spark, tmp_path):
    long = tmp_path / "long.jsonl"
    with long.open("w") as f:
        for k in range(120_000):
            f.write(line(f"model-{k}") + " " * 40 + "\n")
    unnamed = tmp_path / "unnamed.jsonl"
    unnamed.write_text(line("too far") + "\n" + ('{"x": 1}\n' * 700_000))
    spark.dataSource.register(tails.TailModels)
    got = {r.file.rsplit("/", 1)[1]: (r.model, r.bytes_read) for r in spark.read.format("tail_models").load(str(tmp_path)).collect()}
    assert long.stat().st_size > 9_000_000 and unnamed.stat().st_size > tails.MOST_BYTES
    assert got == {"long.jsonl": ("model-119999", tails.BLOCK_BYTES), "unnamed.jsonl": (None, tails.MOST_BYTES)}
    assert spark.read.format("tail_models").load(str(long)).count() == 1


def test_logs_of_series_are_written_whole_and_in_order(spark, tmp_path):
    rows = [(s, k, f"{s} {k} ü") for s in (None, -3, 0, 5) for k in range(40)] + [(9, 1, None)]
    random.Random(2).shuffle(rows)
    lines = spark.createDataFrame(rows, "series_id long, k long, line string").repartition(5)
    folder = tmp_path / "deep" / "logs"
    for _ in range(2):  # again over what is there
        tails.write_logs(lines, str(folder), "k")
        got = {f.name: f.read_text() for f in folder.iterdir()}
        assert got.pop("series_id=9.txt") == "\n"
        assert got == {f"series_id={'none' if s is None else s}.txt": "".join(f"{s} {k} ü\n" for k in range(40)) for s in (None, -3, 0, 5)}


def test_a_line_over_many_blocks_is_found():
    body = (line("early") + "\n" + json.dumps({"pad": "x" * 5000, "message": {"model": "wide"}}) + "\n{}\n").encode()
    assert tails.last_of(len(body), lambda at, n: body[at : at + n], block=100)[0] == "wide"
    assert tails.last_of(len(body), lambda at, n: body[at : at + n], block=100, most=4000) == (None, 4000)


# --- table functions


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(3)
    rows = [(s, k * (0.1 if s % 2 else 1.3) + r.random() * 0.05, 100 * r.random() ** 4 * (4 if k % 40 < 9 else 1)) for s in range(12) for k in range(5 if s == 4 else 160)]
    rows += [(2, 500.0, None), (None, 1.0, 5.0), (None, 2.0, 50.0)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "series_id long, t double, x double").cache()
    table.createOrReplaceTempView("samples_of_tools")
    table_functions.register(spark)
    return table


def same(sql_rows, frame):
    key = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    got = sql_rows.collect()
    assert got and key(got) == key(frame.select(sql_rows.columns).collect())


def test_wide_windows_of_the_table_function_do_not_round_as_long_sums_do(spark, samples):
    """Before, plain running sums lost values behind larger ones, and took means of exactly the limit for more."""
    large = [1e16 if k < 5 else 3.25 if 100 <= k < 140 else 1.0 for k in range(200)]
    level = [k % 3 * 3 / 100 if k < 41 else 0.75 if 100 <= k < 150 else 0.0 for k in range(200)]
    wide = spark.createDataFrame([(s, k / 20, x) for s, xs in ((1, large), (2, level)) for k, x in enumerate(xs)], "series_id INT, t DOUBLE, x DOUBLE")
    wide.createOrReplaceTempView("wide_samples")
    told = spark.sql("SELECT * FROM motion_windows(TABLE(wide_samples) PARTITION BY series_id)")
    assert [r.series_id for r in told.where("start_s > 3 OR series_id = 2").collect()] == [1]
    same(told, signals.motion_windows(wide))


def test_table_functions_equal_the_operators(spark, samples):
    same(spark.sql("SELECT * FROM motion_windows(TABLE(samples_of_tools) PARTITION BY series_id)"), signals.motion_windows(samples))
    same(spark.sql("SELECT * FROM motion_windows(TABLE(SELECT * FROM samples_of_tools WHERE series_id < 9) PARTITION BY series_id, k => 0.5, join_gap => 2, min_length => 0.1)"), signals.motion_windows(samples.where("series_id < 9"), k=0.5, join_gap=2.0, min_length=0.1))
    same(spark.sql("SELECT * FROM even_sample(TABLE(SELECT * FROM samples_of_tools WHERE x IS NOT NULL) PARTITION BY series_id, count => 7)"), signals.even_sample(samples.where("x IS NOT NULL"), 7))
    same(spark.sql("SELECT * FROM even_sample(TABLE(samples_of_tools) PARTITION BY series_id, stride => 'floor', count => 9)"), signals.even_sample(samples, 9, "floor"))
    known = samples.where("x IS NOT NULL AND series_id IS NOT NULL")
    known.createOrReplaceTempView("known_samples")
    same(spark.sql("SELECT * FROM robust_stats(TABLE(known_samples) PARTITION BY series_id, floor => 0.5)"), signals.robust_stats(known, 0.5))
    scenes = known.withColumnRenamed("x", "score")
    scenes.createOrReplaceTempView("scenes_of_tools")
    same(spark.sql("SELECT * FROM session_clusters(TABLE(scenes_of_tools) PARTITION BY series_id ORDER BY t, gap => 1.31)"), signals.session_clusters(scenes, 1.31))


@pytest.mark.parametrize(
    ("call", "said"),
    [
        ("motion_windows(TABLE(samples_of_tools) PARTITION BY series_id, k => -1.0)", "k must be at least 0"),
        ("motion_windows(TABLE(samples_of_tools) PARTITION BY series_id, min_rows => 2.5)", "min_rows must be a whole number"),
        ("motion_windows(TABLE(samples_of_tools) PARTITION BY series_id, speed => 2)", "there is no parameter speed"),
        ("motion_windows(TABLE(samples_of_tools) PARTITION BY series_id, k => 'NaN'::double)", "k must be finite"),
        ("motion_windows(TABLE(SELECT series_id, x FROM samples_of_tools) PARTITION BY series_id)", "no column t"),
        ("motion_windows(TABLE(SELECT series_id, 'a' AS t, x FROM samples_of_tools) PARTITION BY series_id)", "column t must be a number"),
        ("even_sample(TABLE(samples_of_tools) PARTITION BY series_id, stride => 'odd')", "stride must be one of round, floor"),
        ("even_sample(TABLE(samples_of_tools) PARTITION BY series_id, count => 0)", "count must be at least 1"),
        ("robust_stats(5)", "must be a table"),
    ],
)
def test_wrong_calls_fail_when_analysed(spark, samples, call, said):
    with pytest.raises(Exception, match=said):
        spark.sql(f"SELECT * FROM {call}").schema  # nothing is run


def test_partitions_of_several_series_are_refused(spark, samples):
    with pytest.raises(Exception, match="several values of series_id"):
        spark.sql("SELECT * FROM even_sample(TABLE(samples_of_tools) WITH SINGLE PARTITION)").collect()


# --- motion from images


def image(values: np.ndarray) -> bytes:
    return b"P5\n# made\n%d %d\n255\n" % (values.shape[1], values.shape[0]) + values.astype(np.uint8).tobytes()


def test_differences_and_crops(spark):
    r = np.random.default_rng(1)
    stacks = {s: r.integers(0, 40, (6, 12, 20)) for s in (1, 2)}
    rows = [(s, k * 3, k / 2, image(v)) for s, stack in stacks.items() for k, v in enumerate(stack)]
    rows += [(3, 0, 0.0, image(stacks[1][0])), (3, 1, 0.5, b"P6 nothing"), (3, 2, 1.0, image(stacks[1][1])), (3, 3, 1.5, image(stacks[1][2][:6])), (4, 0, 0.0, None), (4, None, 1.0, image(stacks[1][0]))]
    images = spark.createDataFrame(rows, "series_id int, frame int, t double, content binary").repartition(5)
    got = {(x.series_id, x.frame): (x.before_t, pgm.pixels(bytes(x.content)) if x.content else None) for x in motion_masks.differences(images).collect()}
    for s, stack in stacks.items():
        for k in range(1, 6):
            before, mask = got[s, k * 3]
            assert before == (k - 1) / 2 and (mask[2].reshape(12, 20) == 255 * (np.abs(stack[k] - stack[k - 1]) > 10)).all()
        assert (s, 0) not in got
    assert [got[3, k][1] for k in (1, 2, 3)] == [None] * 3 and len(got) == 13
    moved = np.zeros((3, 12, 20))
    moved[0, 3:9, 5:12], moved[1, 1:5, 9:16], moved[2, 0, 0] = 255, 255, 255
    masks = spark.createDataFrame([(9, 0, image(np.zeros((12, 20)))), *((9, k + 1, image(m)) for k, m in enumerate(moved)), (9, 7, None)], "series_id int, frame int, content binary")
    assert sorted(tuple(x)[1:] for x in motion_masks.crop_boxes(masks).collect()) == [(1, 6, 4, 6, 4), (2, 6, 2, 10, 6), (3, 6, 2, 10, 6), (7, 6, 2, 10, 6)]


def test_masks_shrink_and_are_taken_twice_a_second(spark):
    assert motion_masks.grid_of(1280, 720) == (160, 90) and motion_masks.grid_of(64, 32) == (64, 32) and motion_masks.grid_of(1920, 300) == (160, 40)
    lit = np.zeros((90, 330))
    lit[[0, 44, 89], [0, 200, 329]] = 255
    small = pgm.pixels(motion_masks._smaller(image(lit), 160, 45))
    at = np.argwhere(small[2].reshape(45, 160)).tolist()
    assert small[:2] == (160, 45) and at == [[0, 0], [22, 96], [44, 159]] or at == [[0, 0], [22, 97], [44, 159]]
    masks = spark.createDataFrame([(1, k, k / 10, (k - 1) / 10, b"x") for k in range(1, 400)] + [(1, 400, 40.0, 39.9, None)], "series_id int, frame int, t double, before_t double, content binary")
    windows = spark.createDataFrame([(1, 7, 1.0, 2.0), (1, 8, 0.0, 1e12), (1, 9, 5.0, 4.0), (2, 7, 0.0, 9.0)], "series_id int, win_id int, start_s double, end_s double")
    got = sorted((x.win_id, x.frame) for x in motion_masks.mask_scan(masks, windows).collect())
    assert got == [(7, 11), (7, 15), (7, 20)] + [(8, k) for k in [1, *range(5, 116, 5)]]


def test_images_to_boxes(spark):
    """A square of 40 pixels that moves to the right over ten frames, and a window that is too short."""
    frames = np.zeros((10, 180, 320))
    for k, frame in enumerate(frames):
        frame[60:100, 40 + 8 * k : 80 + 8 * k] = 200
    images = spark.createDataFrame([(5, k, k / 2, image(f)) for k, f in enumerate(frames)], "series_id int, frame int, t double, content binary")
    windows = spark.createDataFrame([(5, 1, 0.0, 4.5), (5, 2, 0.0, 0.9), (5, 3, 50.0, 60.0)], "series_id int, win_id int, start_s double, end_s double")
    got = {x.win_id: x for x in motion_masks.window_boxes(images, windows, 320, 180).collect()}
    assert got[2].left is None and got[3].left is None
    box = got[1]
    assert box.left <= 40 and box.top <= 60 and box.left + box.w >= 152 and box.top + box.h >= 100 and box.w * box.h < 160 * 80


# --- contracts


def test_contracts(spark):
    rules = [("a", "speed", "rate", True), ("a", "speed", "text", False), ("a", "hue", "text", False), ("a", "any", None, True), ("b", None, None, None), ("c", "list", "list", True), ("c", "on", "flag", None), ("c", "o", "object", None), ("c", "n", "number", None)]
    uses = [
        (1, "a", '{"speed": 2, "any": null}'),
        (2, "a", '{"speed": 0, "any": [1]}'),
        (3, "a", '{"speed": "2", "size": 1}'),
        (4, "b", "{}"),
        (5, "b", '{"x": 1}'),
        (6, "z", '{"x": 1}'),
        (7, "a", "[]"),
        (8, "a", "{broken"),
        (9, "c", None),
        (10, "c", '{"list": [], "on": true, "o": {}, "n": 1.5}'),
        (11, "c", '{"list": {}, "on": 1, "o": [], "n": "1"}'),
        (12, None, "{}"),
    ]
    got = contracts.violations(spark.createDataFrame(uses, "series_id int, effect_id string, variables string"), spark.createDataFrame(rules, "effect_id string, name string, kind string, required boolean"))
    want = {(2, "speed", "not above zero"), (3, "speed", "wrong kind"), (3, "size", "unknown"), (3, "any", "missing"), (5, "x", "unknown"), (6, None, "unknown effect"), (7, None, "not an object"), (8, None, "not an object"), (9, "list", "missing")}
    want |= {(11, n, "wrong kind") for n in ("list", "on", "o", "n")} | {(12, None, "unknown effect")}
    assert {(r.series_id, r.name, r.problem) for r in got.collect()} == want


# --- intervals of any length


def some_intervals(r, n):
    ends = [1e12, math.inf, 1e300, 5e6]
    rows = []
    for k in range(n):
        start = r.choice([r.uniform(0, 100), r.uniform(-50, 1e6), float(r.randrange(60))])
        length = r.choice([0.0, r.uniform(0, 5), r.uniform(0, 300), r.uniform(0, 2e6), 10.0, 20.0, -3.0])
        rows.append((r.randrange(3), k, start, r.choice(ends) if r.random() < 0.05 else start + length))
    return rows


def test_overlaps_of_any_length(spark):
    r = random.Random(8)
    a, b = some_intervals(r, 150), some_intervals(r, 150) + [(1, 990, -math.inf, math.inf), (2, 991, 5.0, math.nan)]
    one = spark.createDataFrame(a, "series_id int, seg_id int, start_s double, end_s double")
    two = spark.createDataFrame(b, "series_id int, win_id int, start_s double, end_s double")
    meets = lambda x, y: x[0] == y[0] and x[3] >= x[2] and (y[3] >= y[2] or math.isnan(y[3])) and x[2] < (y[3] if y[3] == y[3] else math.inf) and x[3] > y[2]
    got = intervals.overlapping(one, two).select("seg_id", "win_id").collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == {(x[1], y[1]) for x in a for y in b if meets(x, y)}
    first = {x.seg_id: x.win_id for x in intervals.first_overlap(one, two).collect()}
    assert first == {x[1]: min((y[1] for y in b if meets(x, y)), default=None) for x in a}
    points = [(s, t) for s in range(3) for t in [*(r.uniform(-60, 400) for _ in range(60)), 1e6, 3e12, -1e9, 0.0, 10.0, 20.0]]
    at = spark.createDataFrame(points, "series_id int, t double")
    held = intervals.within(at, one.select("series_id", "seg_id", "start_s", "end_s")).select("series_id", "t", "seg_id").collect()
    assert len(held) == len(set(held)) and {tuple(x) for x in held} == {(s, t, x[1]) for s, t in points for x in a if x[0] == s and x[2] <= t <= x[3]}
    inside = {(x.series_id, x.t): x.inside for x in delivery.by_segments(at, one).collect()}
    assert inside == {(s, t): any(x[0] == s and x[2] <= t <= x[3] for x in a) for s, t in points}
    crops = subjects.segment_crops(one.withColumn("kind", F.lit("motion")), two.withColumn("box", F.col("win_id").cast("string")), spark.createDataFrame([(0, "whole")], "series_id int, box string")).collect()
    assert {c.seg_id: c.box for c in crops} == {x[1]: str(first[x[1]]) if first[x[1]] is not None else "whole" if x[0] == 0 else None for x in a}
    empty = one.where("false")
    assert intervals.overlapping(empty, two).count() == 0 and intervals.within(at, empty).count() == 0 and delivery.by_segments(at, empty).where("inside").count() == 0


def test_short_windows_have_no_box(spark):
    windows = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 0.0, 0.99), (1, 3, 0.0, 5.0), (1, 4, 0.0, 5.0)], "series_id int, win_id int, start_s double, end_s double")
    found = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", None), (1, 3, "c", "failed")], "series_id int, win_id int, box string, error string")
    assert {r.win_id: r.box for r in subjects.window_boxes(windows, found).collect()} == {1: "a", 2: None, 3: None, 4: None}


# --- requests and long audio


def test_request_problems(spark):
    rows = [
        (1, "watch", '{"path":"a","fps":"2.5","resolution":"512","roi":"1,2,3,4","view":["00:00:01","bad"],"segments":[{"start":"00:00:01","end":"00:00:02","fps":1}]}'),
        (2, "watch", '{"fps":"NaN","resolution":"","mode":"best","segments":[{"start":"x","end":"00:00:02","fps":1}],"view":5,"skip_audio":"yes","view_sample":"4"}'),
        (3, "analyze", '{"path":"a"}'),
        (4, "analyze", '{"path":"a","filters":{"motion":true,"blur":1}}'),
        (5, "configure", '{"backend":"x","default_narrative_mode":"auto","default_adaptive_sampling":"on","clear_sessions":null}'),
        (6, "other", "{}"),
        (7, "inspect", "[]"),
        (8, "inspect", None),
        (9, "measure", '{"path":"x","resolution":true,"model":5}'),
        (10, "watch", '{"path":"p","fps":"Infinity","resolution":700,"segments":[{"start":"00:00:01","fps":2}]}'),
        (11, "watch", '{"path":"p","fps":"auto","segments":[],"view":[],"resolution":1e3,"start_time":"00:00:01.5"}'),
        (12, "inspect", "{broken"),
        (13, None, "{}"),
    ]
    frame = spark.createDataFrame(rows, "series_id int, tool string, params string")
    want = {(1, "view", "out of range"), (2, "path", "missing"), (2, "mode", "out of range"), (2, "fps", "out of range"), (2, "resolution", "out of range"), (2, "skip_audio", "wrong type"), (2, "segments", "out of range"), (2, "view_sample", "wrong type"), (2, "view", "wrong type")}
    want |= {(3, "filters", "missing"), (4, "filters.blur", "wrong type"), (5, "backend", "out of range"), (5, "default_adaptive_sampling", "out of range"), (5, "clear_sessions", "wrong type"), (6, None, "unknown tool"), (7, None, "not an object"), (8, "path", "missing")}
    want |= {(9, "resolution", "out of range"), (9, "model", "wrong type"), (10, "fps", "out of range"), (10, "segments", "missing"), (12, None, "not an object"), (13, None, "unknown tool")}
    assert {(r.series_id, r.parameter, r.problem) for r in requests.problems(frame).collect()} == want
    assert [r.series_id for r in requests.accepted(frame).collect()] == [11]


def test_long_audio(spark):
    assets = spark.createDataFrame([(1, 1500.0, None, None), (2, 900.0, None, None), (3, 5000.0, 10.0, None), (4, 900.0, None, None)], "series_id int, duration_s double, start_s double, end_s double")
    plan = spark.createDataFrame([(1, 0, 3, 0.0, 500.0, "loose_threshold"), (1, 1, 3, 500.0, 1000.0, None), (1, 2, 3, 1000.0, 1500.0, None)], "series_id int, chunk int, total int, start_s double, end_s double, warning string")
    line, tag = "array<struct<start_s: double, end_s: double, text: string>>", "array<struct<start_s: double, end_s: double, tag: string>>"
    answers = [
        (1, 0, 0, None, [(-5.0, 20.0, "a"), (490.0, 600.0, "b"), (700.0, 800.0, "outside")], [(1.0, 2.0, "bell"), (499.0, 999.0, "horn"), (600.0, 601.0, "outside")]),
        (1, 1, 0, "busy", None, None),
        (1, 1, 1, None, [(1.0, 2.0, "c")], None),
        (1, 2, 0, "down", None, None),
        (1, 2, 1, "gone", None, None),
        (2, 0, 0, None, [(5.0, 5.0, "kept as it is")], None),
        (3, 0, 0, "refused", None, None),
    ]
    got = fanin.long_audio(assets, plan, spark.createDataFrame(answers, f"series_id int, chunk int, attempt int, error string, lines {line}, tags {tag}"))
    rows = {(r.series_id, r.kind, r.chunk, r.total, r.start_s, r.end_s, r.value, r.event) for r in got.collect()}
    assert rows == {
        (1, "text", 0, 3, 0.0, 20.0, "a", None), (1, "text", 0, 3, 490.0, 500.0, "b", None), (1, "tag", 0, 3, 1.0, 2.0, "bell", None), (1, "tag", 0, 3, 499.0, 500.0, "horn", None),
        (1, "warning", 0, 3, 0.0, 500.0, "matched silence using loose threshold", "loose_threshold"), (1, "warning", 1, 3, 500.0, 1000.0, "busy", "retry"), (1, "text", 1, 3, 501.0, 502.0, "c", None),
        (1, "warning", 2, 3, 1000.0, 1500.0, "down", "retry"), (1, "warning", 2, 3, 1000.0, 1500.0, "gone", "failed"), (1, "text", 2, 3, 1000.0, 1500.0, fanin.FAILED_CHUNK, None),
        (2, "text", None, None, 5.0, 5.0, "kept as it is", None), (3, "warning", None, None, 0.0, None, "refused", "failed"),
    }


def test_words_for_numbers_are_no_numbers(spark):
    rows = [(1, "NaN", "Infinity", "4"), (2, "-Infinity", "512", "NaN"), (3, " 2.5 ", "1e3", "1"), (4, "auto", None, None)]
    frame = spark.createDataFrame(rows, "series_id int, fps string, resolution string, view string").withColumns({c: F.lit(None).cast("string") for c in ("mode", "start_time", "end_time", "roi")})
    assert {tuple(r) for r in reports.request_problems(frame).collect()} == {(1, "fps"), (1, "resolution"), (2, "fps"), (2, "view")}


# --- the command line


def test_cost_command(spark, tmp_path, capsys):
    assets = spark.createDataFrame([(1, 24.0, 1920, 1080), (2, 4000.0, 1080, 1920), (3, 5.0, None, None), (4, None, 640, 360)], "series_id int, duration_s double, width int, height int")
    assets.write.parquet(str(tmp_path / "a"))
    assert cost.main([str(tmp_path / "a"), "--json", "--out", str(tmp_path / "out")], spark) == 0
    rows = json.loads(capsys.readouterr().out)
    whole = planning.cost_estimates(assets.where("duration_s > 0")).collect()
    assert [r["mode"] for r in rows] == ["low", "mid", "high", "max"] and spark.read.parquet(str(tmp_path / "out")).count() == 12
    for r in rows:
        own = [c for c in whole if c["mode"] == r["mode"]]
        assert (r["n_assets"], r["n_over_cap"], r["tokens_thorough"], r["n_compacting"]) == (3, sum(c.exceeds_cap for c in own), sum(c.tokens_thorough for c in own), sum(c.compacts for c in own))
    assert cost.main([str(tmp_path / "a"), "--mode", "high", "--start", "00:00:10", "--end", "00:00:20", "--cap", "100000"], spark) == 0
    said = capsys.readouterr().out
    assert said.startswith(" high: 2 assets") and "cap of 100000" in said and said.count("\n") == 1
    assets.drop("width").write.json(str(tmp_path / "b.json"))
    assert cost.main([str(tmp_path / "b.json")], spark) == 1 and "no width" in capsys.readouterr().err
    for bad in (["x", "--mode", "best"], ["x", "--start", "5"], ["x", "--cap", "0"], []):
        with pytest.raises(SystemExit):
            cost.main(bad, spark)


def test_narrow_window_means_have_no_rounding_of_long_sums():
    x = np.array([1e15 + 0.5, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    got = table_functions._window_means(x, 1, narrow=True)
    assert got[2:].tolist() == [(0.1 + 0.2 + 0.3) / 3, (0.2 + 0.3 + 0.4) / 3, (0.3 + 0.4 + 0.5) / 3, (0.4 + 0.5 + 0.6) / 3, (0.5 + 0.6) / 2]
