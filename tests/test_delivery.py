"""The loop that trims responses, against a plain version; joins by slots against all pairs."""

import math
import random

from tessella.operators import delivery, intervals, subjects


def even(rows: list, count: int) -> list:
    n = len(rows)
    return rows if count >= n else rows[:1] if count == 1 else [rows[math.floor(i * (n - 1) / (count - 1) + 0.5)] for i in range(count)]


def tokens(rows: list) -> int:
    return math.ceil(sum(r[1] for r in rows) / 3.5) + 50 * len(rows) + 12000


def plain_trim(rows: list) -> tuple[list, str]:
    if len(rows) <= 2 or tokens(rows) <= 88000:
        return rows, "none"
    chars = sum(r[1] for r in rows)
    fit = max(2, math.floor(76000 / (chars / len(rows) / 3.5 + 50))) if chars else len(rows) - 1
    if fit >= len(rows):
        return rows, "none"
    move, still = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    if not move:
        kept, policy = even(rows, fit), "uniform"
    else:
        policy = "motion-aware"
        kept = even(move, fit) if len(move) >= fit else sorted(move + (even(still, fit - len(move)) if still else []))
    while tokens(kept) > 88000 and len(kept) > 2:
        kept = even(kept, len(kept) - 1)
    return kept, policy


def test_trimmed_responses_fit(spark):
    r = random.Random(6)
    series = {k: [(t, int(r.choice([0, 500, 9000, 40000, 90000]) * r.random() * (3 if k % 2 and t % 3 == 0 else 1)), k % 3 > 0 and r.random() < 0.4) for t in range(r.choice([1, 2, 3, 12, 60]))] for k in range(40)}
    series[90] = [(t, 0, False) for t in range(2000)]
    series[91] = [(t, 300000, True) for t in range(5)]
    table = spark.createDataFrame([(k, *x) for k, rows in series.items() for x in rows], "series_id INT, t INT, n_chars LONG, moving BOOLEAN")
    got = {}
    for x in delivery.trimmed(table).collect():
        got.setdefault(x.series_id, []).append((x.t, x.n_chars, x.moving, x.policy))
    assert {"none", "uniform", "motion-aware"} == {x[3] for rows in got.values() for x in rows}
    for k, rows in series.items():
        kept, policy = plain_trim(rows)
        assert sorted(got[k]) == [(*x, policy) for x in kept], k
    assert delivery.trimmed(table.where("false")).count() == 0


def test_slot_joins_equal_all_pairs(spark):
    r = random.Random(8)
    spans = lambda n: [(k % 3, k, *sorted((round(r.uniform(-30, 90), 1), round(r.uniform(-30, 90), 1)))) for k in range(n)]
    a, b = spans(60), spans(40)
    segments, windows = spark.createDataFrame(a, "series_id INT, seg_id INT, start_s DOUBLE, end_s DOUBLE"), spark.createDataFrame(b, "series_id INT, win_id INT, start_s DOUBLE, end_s DOUBLE")
    got = {x.seg_id: x.win_id for x in intervals.first_overlap(segments, windows).collect()}
    assert got == {k: min((j for t, j, c, d in b if t == s and x < d and y > c), default=None) for s, k, x, y in a}
    frames = spark.createDataFrame([(k % 3, k / 2.0) for k in range(-60, 180)], "series_id INT, t DOUBLE")
    inside = {(x.series_id, x.t): x.inside for x in delivery.by_segments(frames, windows).collect()}
    assert inside == {(k % 3, k / 2.0): any(s == k % 3 and c <= k / 2.0 <= d for s, _, c, d in b) for k in range(-60, 180)}
    points = spark.createDataFrame([(0, round(r.uniform(0, 50), 2)) for _ in range(80)], "series_id INT, t DOUBLE")
    goals = spark.createDataFrame([(0, k, float(k)) for k in range(-3, 55)], "series_id INT, k INT, goal DOUBLE")
    near = {x.k: x.t for x in intervals.nearest_within(goals, points, 0.5).collect()}
    times = [x.t for x in points.collect()]
    assert near == {k: min((t for t in times if abs(t - k) <= 0.5), key=lambda t: (abs(t - k), t), default=None) for k in range(-3, 55)}


def test_windows_without_any_cover_nothing(spark):
    assets = spark.createDataFrame([(1, 20.0, 0.5, 20.0), (2, 20.0, 0.5, 5.0), (3, 20.0, 0.1, 20.0), (4, 4.0, 0.9, 20.0)], "series_id INT, duration_s DOUBLE, confidence DOUBLE, subj_ti DOUBLE")
    none = spark.createDataFrame([], "series_id INT, start_s DOUBLE, end_s DOUBLE, intensity DOUBLE")
    got = subjects.subject_windows(assets, none, none).collect()
    assert [(x.series_id, x.start_s, x.end_s, x.intensity, x.tier) for x in got] == [(1, 4.0, 16.0, 20.0, "middle")]
