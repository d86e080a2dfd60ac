"""Queries on documents, colours and cached frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import sources
from tessella.operators import documents, signals
from tessella.plans.base import register

# Line numbers repeat within an order.
_POS = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos"
_LINES = f"(SELECT *, {_POS} FROM lineitem)"
_SCENES = f"""SELECT l_orderkey AS doc_id, pos, CAST(l_partkey % 9 AS STRING) AS id, CAST((pos - 1) * 10 + l_partkey % 3 - 1 AS DOUBLE) AS start_s, CAST(10 AS DOUBLE) AS duration_s,
CASE l_returnflag WHEN 'R' THEN 'crossfade' WHEN 'A' THEN 'cut' END AS transition_out, CAST(40 AS DOUBLE) AS target_s FROM {_LINES}"""


def _over(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **{name: sources.table(spark, sf_dir, name) for name in names})


@register(
    f"""WITH scenes AS ({_SCENES}),
seen AS (SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) AS nth, greatest(0, max(start_s + duration_s) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS reach, lag(transition_out) OVER w AS before FROM scenes WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, 'late_start' AS violation FROM seen WHERE k = 1 AND start_s > 1e-9 UNION ALL SELECT doc_id, pos, 'duplicate_id' FROM seen WHERE nth > 1
UNION ALL SELECT doc_id, pos, 'overlap' FROM seen WHERE k > 1 AND start_s < reach - 1e-9 AND coalesce(before, '') IN ('', 'cut') UNION ALL SELECT doc_id, pos, 'gap' FROM seen WHERE k > 1 AND start_s > reach + 1e-9
UNION ALL SELECT doc_id, NULL, 'drift' FROM scenes GROUP BY doc_id HAVING abs(greatest(0, max(start_s + duration_s)) - 40) > 0.25"""
)
def scene_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.scene_violations(_over(spark, sf_dir, _SCENES, "lineitem"))


_BEATS = f"SELECT l_orderkey AS doc_id, pos, CAST(pos * 3 - l_suppkey % 2 * 4 AS DOUBLE) AS at_s, l_quantity / CAST(10 AS DOUBLE) AS duration_s, l_partkey FROM {_LINES}"
_SHEETS = "SELECT o_orderkey AS doc_id, CAST(10 AS DOUBLE) AS duration_s, 5 AS chunk_count, o_custkey % 7 AS segments_covered, 5 - o_custkey % 2 AS subchunks_watched FROM orders"


@register(
    f"""WITH beats AS ({_BEATS}), sheets AS ({_SHEETS}), seen AS (SELECT b.*, lag(at_s) OVER w AS before, row_number() OVER w AS k FROM beats b WHERE doc_id IN (SELECT doc_id FROM sheets) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, 'unordered' AS violation FROM seen WHERE at_s < before - 1e-6 UNION ALL SELECT doc_id, pos, 'past_end' FROM seen WHERE at_s > 10.5 UNION ALL SELECT doc_id, pos, 'tail_past_end' FROM seen WHERE at_s + duration_s > 10.5
UNION ALL SELECT doc_id, pos, 'late_first' FROM seen WHERE k = 1 AND at_s > 1.0 UNION ALL SELECT doc_id, pos, 'unknown_effect' FROM beats WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
UNION ALL SELECT doc_id, NULL, 'unwatched' FROM sheets WHERE subchunks_watched <> chunk_count UNION ALL SELECT doc_id, NULL, 'excess_segments' FROM sheets WHERE segments_covered > chunk_count"""
)
def beat_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = _over(spark, sf_dir, _BEATS, "lineitem").withColumn("effect_ids", F.array("l_partkey"))
    catalog = sources.table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("effect_id"))
    return documents.beat_violations(beats, _over(spark, sf_dir, _SHEETS, "orders"), catalog)


_COLOURS = """SELECT l_suppkey AS series_id, l_orderkey * 10 + l_linenumber AS t, l_quantity AS brightness, floor(l_discount * 100 + 0.5) - 5 AS u, floor(l_tax * 100 + 0.5) - 4 AS v FROM lineitem"""
_MID = "list_sort(list({0}))[CAST(floor(count(*) / 2) AS INT) + 1]"


@register(
    f"""WITH f AS (SELECT *, sqrt(CAST(u * u + v * v AS DOUBLE)) AS s, atan2(v, u) AS hue FROM ({_COLOURS})),
m AS (SELECT series_id, {_MID.format("s")} AS ms, {_MID.format("brightness")} AS mb, {_MID.format("hue")} AS mh FROM f GROUP BY 1 HAVING count(*) >= 8),
d AS (SELECT f.series_id, t, abs(s - ms) AS ds, abs(brightness - mb) AS db, least(abs(hue - mh), 2 * pi() - abs(hue - mh)) AS dh FROM f JOIN m USING (series_id)),
g AS (SELECT series_id, greatest(1.0, {_MID.format("ds")}) AS as_, greatest(1.0, {_MID.format("db")}) AS ab, greatest(0.02, {_MID.format("dh")}) AS ah FROM d GROUP BY 1),
x AS (SELECT series_id, t, sqrt(ds / as_ * (ds / as_) + db / ab * (db / ab)) AS len, dh / ah AS turn FROM d JOIN g USING (series_id)),
y AS (SELECT series_id, t, floor(greatest(len, turn) * 10 + 0.5) / 10 AS distance FROM x WHERE len > 1.8 OR turn > 2.0)
SELECT series_id, t, distance FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY distance DESC, t) AS place FROM y) WHERE place <= 50"""
)
def colour_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _over(spark, sf_dir, _COLOURS, "lineitem").withColumn("saturation", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))
    return signals.colour_outliers(frames)


_DAY = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT)"


@register(
    f"""WITH e AS (SELECT user_id AS series_id, {_DAY} AS t, event_id, event_type, value FROM events)
SELECT series_id, t, blur, colour FROM (SELECT series_id, t, arg_max(value, event_id) AS blur FROM e WHERE event_type = 'click' GROUP BY 1, 2) FULL JOIN (SELECT series_id, t, arg_max(value, event_id) AS colour FROM e WHERE event_type = 'error' GROUP BY 1, 2) USING (series_id, t)"""
)
def merged_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = sources.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), day.alias("t"), F.col("event_id").alias("arrival"), "event_type", "value")
    of = lambda kind, name: rows.where(F.col("event_type") == kind).select("series_id", "t", "arrival", F.col("value").alias(name))
    return signals.merge_series(of("click", "blur"), of("error", "colour"))


_T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0"


@register(
    f"""WITH s AS (SELECT user_id AS series_id, {_T} AS t, value AS x FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM s)
SELECT series_id, any_value(n) AS n, {_MID.format("x")} AS med FROM r WHERE rn > floor(n * 0.8) GROUP BY 1"""
)
def tail_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.tail_median(sources.samples(spark, sf_dir))


@register(
    f"""WITH s AS (SELECT user_id AS series_id, event_id, {_T} AS t, CASE event_id % 5 WHEN 0 THEN 'png' ELSE 'jpeg' END AS bucket FROM events), a AS (SELECT DISTINCT series_id, bucket, t FROM s WHERE event_id % 2 = 0), b AS (SELECT series_id, bucket, t, CASE event_id % 3 WHEN 0 THEN 384 WHEN 1 THEN 512 ELSE 1024 END AS resolution, event_id AS file FROM s WHERE event_id % 2 = 1),
p AS (SELECT a.series_id, a.bucket, a.t, b.t AS found_t, resolution, file, row_number() OVER (PARTITION BY a.series_id, a.bucket, a.t ORDER BY resolution DESC, abs(b.t - a.t), b.t) AS place FROM a LEFT JOIN b ON a.series_id = b.series_id AND a.bucket = b.bucket AND abs(b.t - a.t) <= 0.05)
SELECT series_id, bucket, t, found_t, resolution, file FROM p WHERE place = 1"""
)
def cached_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("win_id") % 5 == 0, "png").otherwise("jpeg")
    rows = sources.windows(spark, sf_dir).select("series_id", "win_id", bucket.alias("bucket"), F.col("start_s").alias("t"))
    resolution = F.expr("CASE win_id % 3 WHEN 0 THEN 384 WHEN 1 THEN 512 ELSE 1024 END")
    cached = rows.where("win_id % 2 = 1").select("series_id", "bucket", "t", resolution.alias("resolution"), F.col("win_id").alias("file"))
    return signals.cached_lookup(rows.where("win_id % 2 = 0").select("series_id", "bucket", "t").distinct(), cached)


@register(
    """WITH e AS (SELECT user_id AS series_id, event_type || CAST(event_id % 9 AS VARCHAR) AS label, event_id AS arrival FROM events)
SELECT series_id, label, min(arrival) AS arrival FROM e WHERE arrival % 2 = 1 AND (series_id, label) NOT IN (SELECT (series_id, label) FROM e WHERE arrival % 2 = 0) GROUP BY 1, 2"""
)
def new_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("event_type", (F.col("event_id") % 9).cast("string"))
    rows = sources.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), label.alias("label"), F.col("event_id").alias("arrival"))
    return signals.new_labels(rows.where("arrival % 2 = 1"), rows.where("arrival % 2 = 0"))


@register("SELECT page_id, substr(sha256(url), 1, 12) AS url_key, CASE WHEN len(html) > 4000 THEN substr(html, 1, 4000) || '… [cut]' ELSE html END AS shown FROM pages")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.length("html") > 4000, F.concat(F.substring("html", 1, 4000), F.lit("… [cut]"))).otherwise(F.col("html"))
    return sources.table(spark, sf_dir, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 12).alias("url_key"), shown.alias("shown"))
