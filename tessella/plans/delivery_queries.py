"""Queries on frame times and on what is delivered of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import delivery, frames
from tessella.plans.base import over, register

_P = "lpad(CAST(CAST(floor({0}) AS BIGINT) AS VARCHAR), 2, '0')"
_CLOCK = f"{_P.format('{0} / 3600')} || ':' || {_P.format('floor({0} / 60) % 60')} || ':' || {_P.format('{0} % 60')}"
_MS = "floor(({0} - floor({0} / 3600) * 3600 - floor({0} % 3600 / 60) * 60) * 1000 + 0.5)"
_PRECISE = f"{_P.format('{0} / 3600')} || ':' || {_P.format('{0} % 3600 / 60')} || ':' || {_P.format(_MS + ' / 1000')} || '.' || lpad(CAST(CAST({_MS} AS BIGINT) % 1000 AS VARCHAR), 3, '0')"
_LABEL = f"CASE WHEN 1 / fps = floor(1 / fps) THEN {_CLOCK.format('t')} ELSE {_PRECISE.format('t')} END"

_REQUESTS = """SELECT event_id AS series_id, CASE event_id % 4 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1.5e0 WHEN 2 THEN 12.5e0 ELSE 1.0e0 END AS fps, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 20 AS DOUBLE) END AS start_s,
CASE WHEN event_id % 5 > 0 THEN event_id % 37 * 0.5e0 END AS end_s, 12.25e0 AS duration_s FROM events"""


@register(
    f"""WITH r AS ({_REQUESTS}), a AS (SELECT *, coalesce(start_s, 0) AS a FROM r), b AS (SELECT *, CASE WHEN end_s > a THEN least(end_s, duration_s) ELSE duration_s END AS b FROM a),
n AS (SELECT *, least(40, CAST(ceil((b - a) * fps - 1e-9) AS INT)) AS n FROM b), i AS (SELECT *, unnest(range(n)) AS i FROM n WHERE n > 0), l AS (SELECT series_id, fps, CAST(i AS INT) AS i, a + i / fps AS t FROM i)
SELECT series_id, i, t, {_LABEL} AS label FROM l"""
)
def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frame_labels(over(spark, sf_dir, _REQUESTS, "events"), most=40)


_SEGMENTS = """SELECT user_id AS series_id, event_id AS seg_id, event_id % 50 * 1.0e0 AS start_s, event_id % 50 + value / 60 AS end_s, CASE event_id % 3 WHEN 0 THEN 0.25e0 WHEN 1 THEN 1.0e0 ELSE 3.0e0 END AS fps,
CASE WHEN event_id % 4 > 0 THEN 256 * (1 + event_id % 4) END AS resolution, CASE WHEN event_id % 6 = 0 THEN '1,2,30x40' END AS crop FROM events"""


@register(
    f"""WITH s AS ({_SEGMENTS}), n AS (SELECT *, least(1000, CAST(ceil((end_s - start_s) * fps - 1e-9) AS INT)) AS n FROM s), i AS (SELECT *, unnest(range(n)) AS i FROM n WHERE n > 0), l AS (SELECT *, start_s + i / fps AS t FROM i)
SELECT series_id, seg_id, CAST(i AS INT) AS i, t, {_LABEL} AS label, CAST(coalesce(resolution, 512) AS BIGINT) AS resolution, coalesce(crop, '0,0,9x9') AS drawn_crop, crop FROM l"""
)
def segment_frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.segment_frame_labels(over(spark, sf_dir, _SEGMENTS, "events"), F.lit("0,0,9x9"))


@register(
    f"""WITH s AS ({_SEGMENTS}), n AS (SELECT *, CAST(ceil((end_s - start_s) * fps - 1e-9) AS INT) AS n FROM s), i AS (SELECT *, unnest(range(n)) AS i FROM n WHERE n > 0), l AS (SELECT *, floor(start_s + i / fps + 0.5) AS t FROM i)
SELECT series_id, seg_id, CAST(i AS INT) AS i, {_CLOCK.format("t")} AS label FROM l"""
)
def segment_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.segment_seconds(over(spark, sf_dir, _SEGMENTS, "events"))


_TILES = "SELECT o_orderkey AS series_id, CAST(floor(o_totalprice / 1000) - 20 AS DOUBLE) AS duration_s, o_orderkey % 9 AS n FROM orders"


@register(f"WITH a AS ({_TILES}), k AS (SELECT *, unnest(range(greatest(1, n))) AS k FROM a WHERE duration_s > 0) SELECT series_id, k, k * (duration_s / greatest(1, n)) AS start_s, least((k + 1) * (duration_s / greatest(1, n)), duration_s) AS end_s FROM k")
def equal_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.equal_tiles(over(spark, sf_dir, _TILES, "orders"))


_SCAN = "SELECT user_id AS series_id, event_id / 7.0e0 AS t, value AS si, value / 2 AS ti, event_type AS black, value AS blur, value AS brightness, value AS u, value AS v FROM events"


@register(
    f"""WITH s AS ({_SCAN}), g AS (SELECT series_id, floor(t * 10) AS slot, arg_min(ti, t) AS x FROM s WHERE u > 5 GROUP BY 1, 2)
SELECT * FROM (SELECT series_id, slot / 10.0e0 AS t, x, row_number() OVER (PARTITION BY series_id ORDER BY slot) AS place FROM g) WHERE place <= 12"""
)
def motion_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = frames.structural_scan(over(spark, sf_dir, _SCAN, "events"), ("exposure", "motion"))
    first = frames.first_of_each(frames.resampled(scanned.withColumnRenamed("ti", "x"), 10.0, F.col("u") > 5), 12)
    return first.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy("t")))


_SIGNAL_FRAMES = """SELECT user_id AS series_id, event_id / 7.0e0 AS t, value AS scene_score, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS black, CASE WHEN event_id % 7 = 0 THEN event_id % 2 END AS frozen, value * 2 AS si, value / 2 AS ti, CASE WHEN event_id % 3 > 0 THEN value + 1 END AS blur,
value + 2 AS brightness, value - 100 AS u, 50 - value AS v, event_id % 4 AS silence, -value AS lufs, event_type AS other FROM events"""


def _signal_query(name: str) -> None:
    """A query that scans for one signal alone."""
    columns = frames.SIGNALS[name]
    union = " UNION ALL ".join(f"SELECT series_id, t, '{c}' AS signal, CAST({c} AS DOUBLE) AS value FROM f WHERE {c} IS NOT NULL" for c in columns)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frames.signal_rows(over(spark, sf_dir, _SIGNAL_FRAMES, "events"), (name,))

    query.__name__ = f"scan_{name}"
    register(f"WITH f AS ({_SIGNAL_FRAMES}) {union}")(query)


for _name in frames.SIGNALS:
    _signal_query(_name)


_ASKED = """SELECT event_id AS series_id, CASE event_id % 6 WHEN 0 THEN 384 WHEN 1 THEN 512 WHEN 2 THEN 700 WHEN 3 THEN 1024 WHEN 4 THEN 1536 END AS resolution, CASE WHEN event_id % 7 = 0 THEN 2.5e0 END AS fps, CASE WHEN event_id % 4 > 0 THEN event_id % 40 END AS view_n,
value * (event_id % 5) * 4 AS duration_s, CASE WHEN event_id % 3 = 0 THEN 2.0e0 END AS start_s, CASE WHEN event_id % 2 = 0 THEN 9.5e0 END AS end_s, event_id % 5 = 0 AS segmented, CASE event_id % 3 WHEN 0 THEN 50000 WHEN 1 THEN 120000 ELSE 20000 END AS cap, CAST(floor(value * 900) * (event_id % 8) AS BIGINT) AS chars FROM events"""
_BY = lambda values: "CASE " + " ".join(f"WHEN resolution <= {b[0]} THEN {v}" for b, v in zip(delivery.BANDS[:-1], values)) + f" ELSE {values[-1]} END"
_TABLE = {k: _BY([f"{b[k]}e0" if isinstance(b[k], float) else b[k] for b in delivery.BANDS]) for k in range(1, 6)}
_LADDER = "CASE WHEN duration_s < 60 THEN 2.0e0 WHEN duration_s < 300 THEN 1.0e0 WHEN duration_s < 900 THEN 0.5e0 WHEN duration_s < 3600 THEN 0.2e0 ELSE 0.1e0 END"


@register(
    f"""WITH a AS ({_ASKED}), b AS (SELECT *, CASE WHEN resolution IS NOT NULL THEN {_TABLE[5]} END AS own, {_LADDER} AS ladder FROM a)
SELECT series_id, {_TABLE[3]} AS frame_tokens, {_TABLE[4]} AS thorough_fps, CAST(CASE WHEN cap >= 100000 THEN {_TABLE[1]} WHEN cap = 50000 THEN {_TABLE[2]} ELSE greatest(1, floor({_TABLE[2]} * (cap / 50000))) END AS BIGINT) AS view_budget,
coalesce(fps, own, CASE WHEN view_n > 0 AND duration_s > 0 THEN view_n / duration_s END, ladder) AS preview_fps, coalesce(fps, CASE WHEN NOT segmented THEN coalesce(own, CASE WHEN view_n > 0 THEN view_n / greatest(1, coalesce(end_s, duration_s) - coalesce(start_s, 0)) END) END, ladder) AS drawing_fps FROM b"""
)
def rate_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return over(spark, sf_dir, _ASKED, "events").select(
        "series_id", delivery.by_resolution(c("resolution"), 3).alias("frame_tokens"), delivery.by_resolution(c("resolution"), 4).alias("thorough_fps"), delivery.view_budget(c("resolution"), c("cap")).cast("long").alias("view_budget"),
        delivery.preview_rate(c("fps"), c("view_n"), c("duration_s"), c("resolution")).alias("preview_fps"),
        delivery.drawing_rate(c("fps"), c("view_n"), c("start_s"), c("end_s"), c("duration_s"), c("resolution"), c("segmented")).alias("drawing_fps"),
    )


@register(
    f"""WITH a AS ({_ASKED}), f AS (SELECT *, 1 + series_id % 30 AS n FROM a), g AS (SELECT *, CASE WHEN chars > 0 THEN greatest(2, CAST(floor(76000 / (chars / n / 3.5e0 + 50)) AS BIGINT)) END AS fit, CASE WHEN chars > 0 THEN greatest(2, CAST(floor(76000 / (chars / 3.5e0 + 50)) AS BIGINT)) END AS one FROM f)
SELECT series_id, CAST(ceil(chars / 3.5e0) + n * 50 + 12000 AS BIGINT) AS tokens, CAST(ceil(chars / 3.5e0) + n * 50 + ceil(series_id / 4.0e0) AS BIGINT) AS call_tokens, fit, CASE WHEN view_n > 2 AND view_n > fit THEN fit ELSE view_n END AS sized,
CAST(CASE WHEN one IS NULL OR view_n IS NULL THEN view_n ELSE greatest(one, least(greatest(2, ceil(greatest(0, duration_s) / 5)), view_n)) END AS BIGINT) AS probed FROM g"""
)
def view_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, _ASKED, "events").withColumn("n", 1 + F.col("series_id") % 30)
    fit = delivery.frames_that_fit(F.col("chars"), F.col("n"))
    return rows.select(
        "series_id", delivery.transport_tokens(F.col("chars"), F.col("n")).alias("tokens"), delivery.transport_tokens(F.col("chars"), F.col("n"), F.col("series_id")).alias("call_tokens"), fit.alias("fit"),
        delivery.sized_view(F.col("view_n"), fit).alias("sized"), delivery.probed_view(F.col("chars"), F.col("view_n"), F.col("duration_s")).cast("long").alias("probed"),
    )


_FRAMES = "SELECT user_id AS series_id, event_id % 997 * 0.05e0 AS t, CAST(event_id AS STRING) AS label, 30.0e0 + user_id % 20 AS duration_s FROM events"
_MOTION = "SELECT user_id AS series_id, event_id % 45 * 1.0e0 AS start_s, event_id % 45 + value / 300 AS end_s FROM events WHERE event_id % 11 = 0"


@register(
    f"""WITH f AS ({_FRAMES}), m AS ({_MOTION}), k AS (SELECT *, t <= duration_s + 0.1 AS kept FROM f)
SELECT series_id, label, t, kept, EXISTS (SELECT 1 FROM m WHERE m.series_id = k.series_id AND k.t BETWEEN m.start_s AND m.end_s) AS inside FROM k"""
)
def motion_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delivery.by_segments(delivery.in_range(over(spark, sf_dir, _FRAMES, "events")), over(spark, sf_dir, _MOTION, "events"))
    return rows.select("series_id", "label", "t", "kept", "inside")


@register(f"WITH f AS ({_FRAMES}) SELECT series_id, label, t FROM f WHERE t > duration_s + 0.1 OR t IS NULL")
def dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = over(spark, sf_dir, _FRAMES, "events")
    return delivery.dropped(every, delivery.in_range(every).where("kept")).select("series_id", "label", "t")


_ASSETS = "SELECT DISTINCT user_id AS series_id, 30 + user_id % 7 * 40 AS view_n, CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END AS trimmed, CASE WHEN user_id % 3 = 0 THEN 49.6e0 END AS end_s, 49.9e0 + user_id % 3 AS duration_s, 1.0e0 + user_id % 5 AS fps FROM events"


@register(
    f"""WITH f AS (SELECT DISTINCT series_id, t FROM ({_FRAMES})), a AS ({_ASSETS}), g AS (SELECT series_id, t, lag(t) OVER (PARTITION BY series_id ORDER BY t) AS before FROM f),
r AS (SELECT series_id, count(*) AS delivered, max(t) AS last_t FROM g GROUP BY 1), w AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t - before DESC, t) AS place FROM g WHERE before IS NOT NULL),
x AS (SELECT a.*, delivered, last_t, coalesce(end_s, duration_s) - last_t AS rest, CASE WHEN trimmed > 0 THEN 'trimmed' WHEN coalesce(end_s, duration_s) - last_t > 0 AND coalesce(end_s, duration_s) - last_t < 1 / fps + 0.005 THEN 'rate' ELSE 'cap' END AS cause FROM a JOIN r USING (series_id) WHERE delivered < view_n)
SELECT x.series_id, delivered, view_n AS requested, last_t, rest AS remaining_s, cause, CASE WHEN cause = 'trimmed' THEN coalesce(before, last_t) END AS gap_start, CASE WHEN cause = 'trimmed' THEN coalesce(t, last_t) END AS gap_end FROM x LEFT JOIN w ON x.series_id = w.series_id AND place = 1"""
)
def short_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = over(spark, sf_dir, _FRAMES, "events").select("series_id", "t").distinct()
    return delivery.short_delivery(over(spark, sf_dir, _ASSETS, "events").withColumnRenamed("view_n", "view"), drawn)


@register("SELECT user_id AS series_id, count(*) AS n_segments, count(CASE WHEN event_id % 3 = 0 THEN event_type END) AS n_cropped, count(DISTINCT CASE WHEN event_id % 3 = 0 THEN event_type END) AS n_crops FROM events GROUP BY 1")
def crop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.crop_summary(over(spark, sf_dir, "SELECT user_id AS series_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS crop FROM events", "events"))


_BLOCKS = "SELECT user_id AS series_id, CASE event_id % 2 WHEN 0 THEN 'text' ELSE 'image' END AS kind, CAST(floor(value) AS BIGINT) AS tokens FROM events"


@register(f"SELECT series_id, CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(coalesce(sum(tokens) FILTER (kind = 'text'), 0) AS BIGINT) AS text_tokens, CAST(coalesce(sum(tokens) FILTER (kind = 'image'), 0) AS BIGINT) AS image_tokens FROM ({_BLOCKS}) GROUP BY 1")
def token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.token_split(over(spark, sf_dir, _BLOCKS, "events"))


@register(
    f"""WITH f AS ({_FRAMES}), r AS (SELECT series_id, 'text' AS kind, t, label FROM f UNION ALL SELECT series_id, 'image', t, label FROM f WHERE t < 40)
SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t, CASE kind WHEN 'text' THEN 0 ELSE 1 END, label) AS INT) AS place, kind, t, label FROM r"""
)
def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, _FRAMES, "events").select("series_id", "t", "label")
    return delivery.response_rows(rows, rows.where("t < 40"))


@register()
def fitted_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the frames of one response; the loop of re-measuring has no SQL, a brute-force test stands for it."""
    rows = over(spark, sf_dir, "SELECT user_id AS series_id, event_id AS t, CAST(floor(value) AS BIGINT) * 40 AS n_chars, event_type = 'click' AS moving FROM events", "events")
    return delivery.trimmed(rows)
