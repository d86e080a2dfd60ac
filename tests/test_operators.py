"""Hand-computed cases of operators outside ``llm``."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import rules, text
from tessella.operators import planning, signals
from tessella.sources import logs

# One text of our own for each pattern, then ordinary sentences that only resemble them.
MADE_UP = [
    "Okay, thank you for watching this one", "Subtitles by a friend", "tanya cushman reviewer, night shift", "Teksting av Ola", "Undertekster av Kari", "Tradução: Ana", " (Gentle piano) ", "(applause)", " ... ", "You.", "WOO!",
    "see www.sample.org now", "Terima  kasih semua", "vielen dank !", "¡gracias", "Merci?", "grazie.", "谢谢大家", " 好 ", "走", "I dont know.", "We'll be right back", "Редактор субтитров И. Петров", "корректор", "algo para pensar.",
]
REAL = ["we gave thanks to you all", "gentle rain on the roof", "the silence was broken", "you can go", "no doubt about it", "merci de votre visite", "the sampler at example dot org", "走路去学校", "a woolly jumper"]


def test_made_up_phrases(spark):
    rows = spark.createDataFrame([(t,) for t in MADE_UP + REAL], "text STRING").select("text", text.is_made_up(F.col("text")).alias("hit")).collect()
    assert {r.text for r in rows if r.hit} == set(MADE_UP)


def test_upper_median_takes_the_upper_middle(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 10)] + [(2, 5.0), (2, 1.0), (2, 9.0)], "series_id INT, x DOUBLE")
    assert {r.series_id: r.x for r in signals.upper_medians(rows, "x").collect()} == {1: 3.0, 2: 5.0}
    both = rows.withColumn("y", F.when(F.col("series_id") == 1, -F.col("x")))
    assert {r.series_id: (r.x, r.y) for r in signals.upper_medians(both, "x", "y").collect()} == {1: (3.0, -2.0), 2: (5.0, None)}


@pytest.mark.parametrize(("weights", "budget", "units"), [((1, 1, 1), 5, [2, 2, 1]), ((1, 1, 1), 2, [1, 1, 0]), ((0, 0), 3, [2, 1]), ((3, 1), 0, [0, 0])])
def test_budget_adds_up(spark, weights, budget, units):
    rows = spark.createDataFrame([(1, k, float(w)) for k, w in enumerate(weights)], "series_id INT, idx INT, w DOUBLE")
    assert [r.units for r in planning.distribute_budget(rows, budget).orderBy("idx").collect()] == units


def test_sparse_motion_falls_back_to_equal_slices(spark):
    windows = spark.createDataFrame([(1, 2.0, 3.0, 5.0)], "series_id INT, start_s DOUBLE, end_s DOUBLE, intensity DOUBLE")
    plan = planning.adaptive_segments(windows, spark.createDataFrame([(1, 0.0, 18.0, 2)], "series_id INT, start0 DOUBLE, end0 DOUBLE, budget INT"))
    assert [(r.start_s, r.end_s, r.kind, r.budget) for r in plan.orderBy("start_s").collect()] == [(4.0, 5.0, "uniform", 1), (13.0, 14.0, "uniform", 1)]
    assert planning.sampling_gaps(plan).first().max_gap == 9.0


def test_no_windows_give_one_static_segment(spark):
    windows = spark.createDataFrame([], "series_id INT, start_s DOUBLE, end_s DOUBLE, intensity DOUBLE")
    plan = planning.adaptive_segments(windows, spark.createDataFrame([(1, 0.0, 10.0, 6)], "series_id INT, start0 DOUBLE, end0 DOUBLE, budget INT"))
    assert [(r.start_s, r.end_s, r.kind, r.budget) for r in plan.collect()] == [(0.0, 10.0, "static", 6)]


def test_short_assets_are_one_chunk(spark):
    none = spark.createDataFrame([], "series_id INT, start_s DOUBLE, end_s DOUBLE")
    plan = planning.chunk_plan(spark.createDataFrame([(1, 900.0), (2, 1800.0)], "series_id INT, duration_s DOUBLE"), none, none)
    got = [(r.series_id, r.start_s, r.end_s, r.warning) for r in plan.orderBy("series_id", "chunk").collect()]
    assert got == [(1, 0.0, 900.0, None), (2, 0.0, 600.0, "hard_cut"), (2, 600.0, 1200.0, "hard_cut"), (2, 1200.0, 1800.0, None)]


@pytest.mark.parametrize("parse", [logs.scene_scores, logs.scene_scores_by_line, logs.black_spans, logs.silence_spans, logs.freeze_spans, logs.frame_blur, logs.frame_colours, logs.loudness, logs.subtitles, logs.speech_segments, lambda x: logs.crop_box(x, 320, 200)])
def test_parsers_take_null_and_empty_texts(spark, parse):
    assert parse(spark.createDataFrame([(1, None), (2, "")], "series_id INT, content STRING")).collect() == []


def test_summary_outranks_frames(spark):
    summary = "Spatial Information:\nAverage: 40.5\nlavfi.siti.ti=9"
    rows = spark.createDataFrame([(1, summary), (2, "lavfi.siti.si=1\nlavfi.siti.si=2")], "series_id INT, content STRING")
    assert {r.series_id: (r.si, r.ti) for r in logs.motion_means(rows).collect()} == {1: (40.5, None), 2: (1.5, None)}


def test_classes(spark):
    columns = "series_id INT, si DOUBLE, ti DOUBLE, subj_ti DOUBLE, scenes_count INT, duration_s DOUBLE, outliers_count INT, bbox_method STRING, bbox_area_pct DOUBLE, bbox_confidence DOUBLE, low_confidence BOOLEAN, has_speech BOOLEAN"
    cases = [
        (1, 200.0, 10.0, None, 0, 10.0, 0, None, None, None, None, None),
        (2, 60.0, 20.0, 20.0, 0, 10.0, 4, None, None, None, None, None),
        (3, 80.0, 30.0, 30.0, 5, 10.0, 0, "cc", 20.0, 0.9, False, True),
        (4, 50.0, 10.0, 10.0, 0, 10.0, 1, None, None, None, True, None),
        (5, 70.0, 40.0, 40.0, 1, 10.0, 0, "center-prior", None, 0.2, True, False),
        (6, None, None, None, 0, 0.0, 1, None, None, None, True, None),
        (7, 90.0, 40.0, 40.0, 2, 10.0, 1, "cc", 20.0, 0.9, True, False),
    ]
    got = {r.series_id: r.content_class for r in rules.classify(spark.createDataFrame(cases, columns)).collect()}
    assert got == {1: "ui-screen", 2: "animation", 3: "talking-head", 4: "nature", 5: "real-world", 6: "nature", 7: "generic"}


def brute_motion(xs: list[tuple[float, float]]) -> list[tuple[float, float, float]]:
    n, dur = len(xs), max(t for t, _ in xs)
    middle = lambda v: sorted(v)[len(v) // 2]
    med = middle([x for _, x in xs])
    mad = max(0.5, middle([abs(x - med) for _, x in xs]))
    half = max(2, int(n / max(1, dur) / 2 + 0.5))
    frames = [[x for _, x in xs[max(0, i - half) : i + half + 1]] for i in range(n)]
    smooth = [sum(f) / len(f) for f in frames]
    runs = []
    for i in (i for i in range(n) if smooth[i] > med + 1.5 * mad):
        if runs and (i == runs[-1][1] + 1 or xs[i][0] - xs[runs[-1][1]][0] <= 1.0):
            runs[-1][1] = i
        else:
            runs.append([i, i])
    cut = [(max(0, xs[a][0] - 0.1), min(max(0, dur - 0.5), xs[b][0] + 0.1), sum(smooth[a : b + 1]) / (b + 1 - a)) for a, b in runs if xs[b][0] - xs[a][0] >= 0.4]
    return [(s, e, m) for s, e, m in cut if e - s >= 0.4]


def test_dense_motion_is_smoothed_over_one_unit_of_time(spark):
    r = random.Random(4)
    dense = [(k / 24, r.uniform(0, 10) + (25 if 100 < k < 160 or k in (300, 301, 302, 303, 304) or 400 < k < 430 else 0)) for k in range(600)]
    short = [(k / 40, 30.0 if 8 < k < 34 else 1.0) for k in range(60)]
    sparse = [(k / 2, 40.0 if 20 < k < 30 else r.uniform(0, 10)) for k in range(80)]
    series = {1: dense, 2: short, 3: sparse, 4: dense[:7]}
    rows = [(s, t, x) for s, xs in series.items() for t, x in xs]
    got = signals.motion_windows(spark.createDataFrame(rows, "series_id INT, t DOUBLE, x DOUBLE")).orderBy("series_id", "win_id").collect()
    for s, xs in series.items():
        mine = [(w.start_s, w.end_s, w.intensity) for w in got if w.series_id == s]
        want = brute_motion(xs) if len(xs) >= 8 else []
        assert len(mine) == len(want) and bool(want) == (s < 4), s
        for a, b in zip(mine, want):
            assert a == pytest.approx(b, abs=0.0501)


def test_wide_windows_do_not_round_as_long_sums_do(spark):
    """Windows of 21 rows: values that plain running sums lose behind larger ones, and means of exactly their limit, 0.75, that they take for more."""
    large = [1e16 if k < 5 else 3.25 if 100 <= k < 140 else 1.0 for k in range(200)]
    level = [k % 3 * 3 / 100 if k < 41 else 0.75 if 100 <= k < 150 else 0.0 for k in range(200)]
    samples = spark.createDataFrame([(s, k / 20, x) for s, xs in ((1, large), (2, level)) for k, x in enumerate(xs)], "series_id INT, t DOUBLE, x DOUBLE")
    around = [large[max(0, i - 10) : i + 11] for i in range(200)]
    smooth = [math.fsum(xs) / len(xs) for xs in around]
    hot = [i for i in range(50, 200) if smooth[i] > 1.75]
    want = (1, hot[0] / 20 - 0.1, hot[-1] / 20 + 0.1, sum(smooth[i] for i in hot) / len(hot))
    got = [(r.series_id, r.start_s, r.end_s, r.intensity) for r in signals.motion_windows(samples).where("start_s > 3 OR series_id = 2").collect()]
    assert len(got) == 1 and got[0] == pytest.approx(want, abs=0.0501)


def test_chunk_plan_neither_sorts_nor_joins_goals(spark):
    """Goals can be far more than silences; before, each was joined twice and all of a series were sorted in one task."""
    assets = spark.createDataFrame([(1, 10000.0), (2, 5.0), (None, 60.0)], "series_id INT, duration_s DOUBLE")
    strict = spark.createDataFrame([(1, 2559.0, 2560.0), (1, 2561.0, 2562.0), (1, 31.0, 33.0)], "series_id INT, start_s DOUBLE, end_s DOUBLE")
    loose = spark.createDataFrame([(1, 2569.0, 2572.0), (1, 28.0, 32.0)], "series_id INT, start_s DOUBLE, end_s DOUBLE")
    plan = planning.chunk_plan(assets, strict, loose, 10.0, 0.0, 4.0)
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.series_id, r.chunk): r for r in plan.collect()}
    assert len(rows) == 1000 + 1 + 6
    cuts = {256: 2559.5, 257: 2570.5, 3: 32.0}
    for k in range(1, 1001):
        row = rows[1, k - 1]
        assert (row.start_s, row.end_s) == (0.0 if k == 1 else cuts.get(k - 1, (k - 1) * 10.0), 10000.0 if k == 1000 else cuts.get(k, k * 10.0))
        assert row.warning == (None if k in (3, 256, 1000) else "loose_threshold" if k == 257 else "hard_cut")
    assert rows[2, 0].end_s == 5.0 and rows[None, 5].warning is None


def test_written_chunk_plan_is_small(spark, tmp_path):
    """The plan can be far larger than its input; before, series followed one another, neighbours differed in three columns and a row took several bytes."""
    assets = spark.range(600).select(F.col("id").alias("series_id"), (F.col("id") * 3 + 9000.0).alias("duration_s"))
    strict = spark.range(600).select(F.col("id").alias("series_id"), (F.col("id") * 10 + 1001.0).alias("start_s"), (F.col("id") * 10 + 1002.0).alias("end_s"))
    planning.chunk_plan(assets, strict, strict.limit(0), 10.0, 0.0, 4.0).coalesce(2).write.parquet(str(tmp_path / "plan"))
    rows = spark.read.parquet(str(tmp_path / "plan"))
    whole = [max(0, int((i * 3 + 9000.0) // 10) - 1) + 1 for i in range(600)]
    assert rows.count() == sum(whole) == rows.select("series_id", "chunk").distinct().count()
    assert rows.where("warning IS NULL").count() == 1200 - sum(i + 100 >= n for i, n in enumerate(whole))
    assert sum(f.stat().st_size for f in (tmp_path / "plan").glob("*.parquet")) < sum(whole)
