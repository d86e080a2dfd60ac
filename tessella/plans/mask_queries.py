"""Queries on motion masks and on the cache of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import sources
from tessella.operators import frame_cache, masks, motion_masks
from tessella.plans.base import over, register
from tessella.sources import pgm

_GRID = {"width": 160, "height": 90}
_UNION = """pixels AS (SELECT DISTINCT user_id AS series_id, CAST(event_id % 24 AS INT) AS frame, CAST(floor(value / 8) AS INT) + 40 AS x, CAST(event_id % 30 AS INT) + 20 AS y FROM events),
lit AS (SELECT series_id, x, y, count(*) AS energy FROM pixels WHERE series_id IN (SELECT series_id FROM pixels GROUP BY 1 HAVING count(DISTINCT frame) >= 2) GROUP BY 1, 2, 3)"""
_DILATED = f"""{_UNION}, moves AS (SELECT CAST(unnest(range(-2, 3)) AS INT) AS d),
dilated AS (SELECT DISTINCT series_id, x + a.d AS x, y + b.d AS y FROM lit, moves a, moves b WHERE x + a.d BETWEEN 0 AND 159 AND y + b.d BETWEEN 0 AND 89)"""
# A blob's first run, in row order, names it; runs of neighbouring rows link where their columns overlap.
_BLOBS = f"""{_DILATED}, islands AS (SELECT *, x - row_number() OVER (PARTITION BY series_id, y ORDER BY x) AS island FROM dilated),
runs AS (SELECT series_id, y, min(x) AS a, max(x) AS b, min(y * 160 + x) AS run FROM islands GROUP BY series_id, y, island),
links AS (SELECT p.series_id, p.run AS one, q.run AS other FROM runs p JOIN runs q ON p.series_id = q.series_id AND abs(p.y - q.y) = 1 AND p.a <= q.b AND q.a <= p.b),
reached AS (SELECT series_id, run, run AS label FROM runs UNION SELECT r.series_id, l.other, r.label FROM reached r JOIN links l ON r.series_id = l.series_id AND r.run = l.one),
named AS (SELECT series_id, run, min(label) AS label FROM reached GROUP BY 1, 2),
blobs AS (SELECT r.series_id, CAST(dense_rank() OVER (PARTITION BY r.series_id ORDER BY label) AS INT) AS blob, a, b, y FROM runs r JOIN named n ON r.series_id = n.series_id AND r.run = n.run),
sized AS (SELECT series_id, blob, CAST(sum(b - a + 1) AS BIGINT) AS area, min(a) AS min_x, max(b) AS max_x, min(y) AS min_y, max(y) AS max_y FROM blobs GROUP BY 1, 2)"""


@register(f"WITH {_UNION} SELECT * FROM lit")
def union_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.union_mask(sources.mask_pixels(spark, sf_dir))


@register(f"WITH {_DILATED} SELECT * FROM dilated")
def dilated_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.dilate(union_masks(spark, sf_dir), **_GRID)


@register(f"WITH RECURSIVE {_BLOBS} SELECT * FROM sized")
def mask_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.dilated_blobs(union_masks(spark, sf_dir), **_GRID)


_BOXES = f"""WITH RECURSIVE {_BLOBS}, top AS (SELECT series_id, max(area) AS top_area FROM sized GROUP BY 1 HAVING max(area) >= 28.8 AND max(area) <= 12240),
around AS (SELECT series_id, min(min_x) * 8 AS x, min(min_y) * 8 AS y, (max(max_x) - min(min_x) + 1) * 8 AS w, (max(max_y) - min(min_y) + 1) * 8 AS h FROM sized JOIN top USING (series_id) WHERE area >= top_area * 0.5 GROUP BY 1),
pads AS (SELECT *, CAST(floor(w * 6e-2) AS BIGINT) AS px, CAST(floor(h * 6e-2) AS BIGINT) AS py FROM around),
grown AS (SELECT series_id, x - least(px, x) AS "left", y - least(py, y) AS top, least(1280 - (x - least(px, x)), w + least(px, x) + px) AS w, least(720 - (y - least(py, y)), h + least(py, y) + py) AS h FROM pads),
even AS (SELECT series_id, "left", top, w - w % 2 AS w, h - h % 2 AS h, (w - w % 2) * (h - h % 2) / 921600e0 * 100 AS share FROM grown)
SELECT series_id, CAST("left" AS BIGINT) AS "left", CAST(top AS BIGINT) AS top, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, floor(share * 10 + 0.5) / 10.0 AS area_pct, CASE WHEN share BETWEEN 10 AND 70 THEN 9e-1 WHEN share < 10 THEN 4e-1 ELSE 6e-1 END AS confidence FROM even WHERE w >= 20 AND h >= 20"""


@register(_BOXES)
def subject_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.subject_boxes(mask_blobs(spark, sf_dir), **_GRID, frame_w=1280, frame_h=720)


@register(
    f"""WITH w AS (SELECT DISTINCT user_id AS series_id, k AS win_id FROM events, (SELECT unnest(range(3)) AS k)), b AS ({_BOXES.replace("user_id AS series_id", "user_id * 3 + event_id % 24 // 12 AS series_id")})
SELECT w.series_id, CAST(win_id AS INT) AS win_id, "left", top, b.w, h, area_pct, confidence FROM w LEFT JOIN b ON b.series_id = w.series_id * 3 + win_id"""
)
def window_subject_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = sources.mask_pixels(spark, sf_dir).withColumn("t", F.col("frame").cast("double"))
    users = sources.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id")).distinct()
    windows = users.withColumn("win_id", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({"start_s": F.col("win_id") * 12.0, "end_s": F.col("win_id") * 12.0 + 11})
    return masks.boxes_by_window(pixels, windows, **_GRID, frame_w=1280, frame_h=720)


@register(
    """WITH f AS (SELECT user_id AS series_id, CASE event_type WHEN 'click' THEN 384 ELSE 512 END AS resolution, strftime(ts, '%d-%H:%M:%S') AS label FROM events)
SELECT series_id, resolution, count(*) AS frame_count, CASE WHEN count(*) > 50 THEN min(label) END AS first_label, CASE WHEN count(*) > 50 THEN max(label) END AS last_label, CASE WHEN count(*) <= 50 THEN string_agg(label, ',' ORDER BY label) END AS labels FROM f GROUP BY 1, 2"""
)
def cache_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolution = F.when(F.col("event_type") == "click", 384).otherwise(512)
    frames = sources.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), resolution.alias("resolution"), F.date_format("ts", "dd-HH:mm:ss").alias("label"))
    return frame_cache.summary(frames)


@register("SELECT event_id AS series_id FROM events WHERE event_id % 13 <> 0 AND (event_id % 11 = 0 OR date_trunc('second', ts) < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)")
def expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_cache.expired(sources.manifests(spark, sf_dir), "2024-01-31 00:00:00").select("series_id")


_SIDE_W, _SIDE_H = 24, 16
_LIT = "({x} BETWEEN {e} % 17 AND {e} % 17 + 6 AND {y} BETWEEN {v} AND {v} + 5)"
_IMAGES = """SELECT user_id AS series_id, event_id AS frame, event_id / 7.0e0 AS t, CAST(floor(value) AS BIGINT) % 10 AS v FROM events"""
_VALUE = lambda e, v: f"CASE WHEN {_LIT.format(x='k % 24', y='k // 24', e=e, v=v)} THEN 200 ELSE ({e} * k) % 8 END"
_MOVED = f"""images AS ({_IMAGES}), pairs AS (SELECT *, lag(frame) OVER w AS before, lag(t) OVER w AS before_t, lag(v) OVER w AS before_v FROM images WINDOW w AS (PARTITION BY series_id ORDER BY frame)),
moved AS (SELECT series_id, frame, t, before_t, CAST(k % 24 AS INT) AS x, CAST(k // 24 AS INT) AS y FROM pairs, (SELECT unnest(range(384)) AS k) WHERE before IS NOT NULL AND abs({_VALUE("frame", "v")} - ({_VALUE("before", "before_v")})) > 10)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, frame, t, content): each event as an image of 24 x 16 with a bright block, whose place the event's number and value tell, on noise."""
    # a row of noise has one of 15 texts, by the remainder of the frame's number, as 24 is three times 8; the block covers 7 columns of up to 6 rows
    noise = lambda r: "".join("FF" if r < 0 and r * k % 8 else f"{r * k % 8:02d}" for k in range(24))
    row = f"element_at(array({', '.join(repr(noise(r)) for r in range(-7, 8))}), CAST(frame % 8 AS INT) + 8)"
    first, end = "greatest(0, CAST(frame % 17 AS INT))", "greatest(0, CAST(frame % 17 AS INT) + 7)"
    lit = f"concat(left(noise, 2 * {first}), repeat('C8', {end} - {first}), substring(noise, 2 * ({end}) + 1))"
    above, below = (f"CAST(least(16, greatest(0, {x})) AS INT)" for x in ("v", "v + 6"))
    values = F.expr(f"CASE WHEN v IS NULL THEN repeat(noise, 16) ELSE concat(repeat(noise, {above}), repeat({lit}, {below} - {above}), repeat(noise, 16 - {below})) END")
    images = over(spark, sf_dir, _IMAGES, "events", spread=True).withColumn("noise", F.expr(row))
    return images.withColumn("content", F.concat(F.lit(b"P5 24 16\n255\n"), F.unhex(values))).select("series_id", "frame", "t", "content")


@register(f"WITH {_MOVED} SELECT series_id, frame, x, y FROM moved")
def image_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pgm.lit_pixels(motion_masks.differences(_images(spark, sf_dir)))


@register(
    f"""WITH {_MOVED}, across AS (SELECT series_id, frame, min(x) AS x0, max(x) AS x1 FROM (SELECT series_id, frame, x FROM moved GROUP BY ALL HAVING count(*) * 255 > 20 * 16) GROUP BY 1, 2), down AS (SELECT series_id, frame, min(y) AS y0, max(y) AS y1 FROM (SELECT series_id, frame, y FROM moved GROUP BY ALL HAVING count(*) * 255 > 20 * 24) GROUP BY 1, 2),
grown AS (SELECT p.series_id, p.frame, min(x0) OVER w AS x0, max(x1) OVER w AS x1, min(y0) OVER w AS y0, max(y1) OVER w AS y1 FROM pairs p LEFT JOIN (SELECT * FROM across JOIN down USING (series_id, frame)) b ON b.series_id = p.series_id AND b.frame = p.frame WHERE before IS NOT NULL WINDOW w AS (PARTITION BY p.series_id ORDER BY p.frame)),
even AS (SELECT series_id, frame, x0 + x0 % 2 AS x, y0 + y0 % 2 AS y, x1 - x0 - x0 % 2 + 1 AS w, y1 - y0 - y0 % 2 + 1 AS h FROM grown WHERE x0 IS NOT NULL)
SELECT series_id, frame, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w - w % 2 AS INT) AS w, CAST(h - h % 2 AS INT) AS h FROM even WHERE w - w % 2 > 0 AND h - h % 2 > 0"""
)
def image_crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion_masks.crop_boxes(motion_masks.differences(_images(spark, sf_dir)))


_SPANS = "SELECT DISTINCT user_id AS series_id, k.k AS win_id, k.k * 400.0e0 AS start_s, CASE WHEN k.k = 3 THEN 1200.5e0 ELSE k.k * 400.0e0 + 399.5 END AS end_s FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k"
_SCANNED = f"""{_MOVED}, spans AS ({_SPANS}), held AS (SELECT DISTINCT s.series_id, win_id, frame, t, floor((t - start_s) * 2) AS tick FROM spans s JOIN pairs p ON p.series_id = s.series_id AND t BETWEEN start_s AND end_s AND before_t >= start_s WHERE end_s - start_s >= 1),
firsts AS (SELECT series_id, win_id, tick, arg_min(frame, t) AS frame FROM held GROUP BY ALL), taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, win_id ORDER BY tick) AS place FROM firsts) WHERE place <= 24),
pixels AS (SELECT DISTINCT m.series_id * 4 + win_id AS series_id, m.frame, x, y FROM taken JOIN moved m USING (series_id, frame)),
lit AS (SELECT series_id, x, y, count(*) AS energy FROM pixels WHERE series_id IN (SELECT series_id FROM pixels GROUP BY 1 HAVING count(DISTINCT frame) >= 2) GROUP BY 1, 2, 3)"""
_SMALL = lambda sql: sql.replace(_UNION, _SCANNED).replace("AND 159", "AND 23").replace("AND 89", "AND 15").replace("y * 160 + x", "y * 24 + x").replace(">= 28.8 AND max(area) <= 12240", ">= 20 AND max(area) <= 326.4").replace(" * 8 AS ", " * 10 AS ").replace("1280 -", "240 -").replace("720 -", "160 -").replace("921600e0", "38400e0")


@register(f"WITH {_SCANNED} SELECT series_id // 4 AS series_id, CAST(series_id % 4 AS INT) AS win_id, frame, count(*) AS n_lit FROM pixels GROUP BY ALL")
def image_mask_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = over(spark, sf_dir, _SPANS, "events").where("end_s - start_s >= 1")
    scanned = motion_masks.mask_scan(motion_masks.differences(_images(spark, sf_dir)), spans)
    lit = pgm.lit_pixels(motion_masks.smaller(scanned.withColumn("series_id", F.col("series_id") * 4 + F.col("win_id")), 160, 90))
    return lit.groupBy(F.floor(F.col("series_id") / 4).alias("series_id"), (F.col("series_id") % 4).cast("int").alias("win_id"), "frame").agg(F.count(F.lit(1)).alias("n_lit"))


@register(
    f"""WITH w AS (SELECT series_id, win_id FROM ({_SPANS})), b AS ({_SMALL(_BOXES)})
SELECT w.series_id, CAST(win_id AS INT) AS win_id, "left", top, b.w, h, area_pct, confidence FROM w LEFT JOIN b ON b.series_id = w.series_id * 4 + win_id"""
)
def image_window_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # frames are said to be ten times as large as the images, so that a box can be large enough to be used
    images, spans = _images(spark, sf_dir), over(spark, sf_dir, _SPANS, "events")
    moving = motion_masks.differences(images)
    return motion_masks.boxes_of(moving, spans, grid=(_SIDE_W, _SIDE_H), frame=(240, 160))
