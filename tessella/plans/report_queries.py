"""Queries on plans and requests in words, and on small images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import rules, text
from tessella.operators import fanin, planning, reports, requests
from tessella.plans.base import over, register
from tessella.plans.delivery_queries import _PRECISE
from tessella.sources import pgm

_LEVELS = "SELECT event_id AS series_id, CASE WHEN event_id % 5 > 0 THEN value / 4 END AS si, CASE WHEN event_id % 3 > 0 THEN event_id % 50 * 1.0e0 END AS ti FROM events"
_WORDS = "CASE {0} " + " ".join(f"WHEN '{d}/{m}' THEN ' ({t})'" for (d, m), t in text.PROFILE_MEANINGS.items()) + " ELSE '' END"


@register(
    f"""WITH l AS ({_LEVELS}), c AS (SELECT *, CASE WHEN si IS NULL THEN 'unknown' WHEN si > 50 THEN 'high' WHEN si > 25 THEN 'moderate' ELSE 'low' END AS d, CASE WHEN ti IS NULL THEN 'unknown' WHEN ti > 30 THEN 'high' WHEN ti > 10 THEN 'moderate' ELSE 'low' END AS m FROM l)
SELECT series_id, CASE WHEN si IS NULL AND ti IS NULL THEN 'unknown (no motion analysis data)' ELSE d || ' visual complexity, ' || m || ' motion' || {_WORDS.format("d || '/' || m")} END AS profile FROM c"""
)
def profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, _LEVELS, "events").select("series_id", text.profile_text(F.col("si"), F.col("ti")).alias("profile"))


_PLAN = "SELECT user_id AS series_id, event_id % 90 * 1.0e0 + event_id / 8192.0e0 AS start_s, event_id % 90 + 1.5e0 + event_id / 8192.0e0 AS end_s, value / 60 AS fps, event_id % 7 AS budget, CASE event_id % 3 WHEN 0 THEN 'motion' WHEN 1 THEN 'static' ELSE 'uniform' END AS kind, CASE WHEN event_id % 6 = 0 THEN value END AS intensity FROM events WHERE event_id % 4 = 0"
_DEC = "CAST(CAST(floor({0} * {1} + 0.5) AS BIGINT) // {1} AS STRING) || '.' || lpad(CAST(CAST(floor({0} * {1} + 0.5) AS BIGINT) % {1} AS STRING), {2}, '0')"


@register(
    f"""WITH p AS ({_PLAN}), l AS (SELECT *, '  ' || {_PRECISE.format("start_s")} || '-' || {_PRECISE.format("end_s")} || ' ' || CASE kind WHEN 'motion' THEN 'motion (intensity=' || coalesce({_DEC.format("intensity", 10, 1)}, '?') || ')' WHEN 'uniform' THEN 'uniform (fallback)' ELSE 'static' END || ': ' || CAST(budget AS STRING) || ' frames @ ' || {_DEC.format("fps", 100, 2)} || 'fps' AS line FROM p)
SELECT series_id, 'segments=' || CAST(count(*) AS STRING) || ' total_frames=' || CAST(CAST(sum(budget) AS BIGINT) AS STRING) || chr(10) || string_agg(line, chr(10) ORDER BY start_s, end_s, line) AS summary FROM l GROUP BY 1"""
)
def plan_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.plan_summary(over(spark, sf_dir, _PLAN, "events"))


_CHOICES = "SELECT event_id AS series_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS asked, event_id % 2 = 0 AS suggested, event_id % 5 = 0 AS configured, concat(CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN 'x' ELSE ' ' END, CAST(event_id % 3000 AS STRING), CASE event_id % 7 WHEN 0 THEN 'k' ELSE '' END) AS cap FROM events"


@register(
    f"""WITH c AS ({_CHOICES}) SELECT series_id, CASE WHEN asked IS NOT NULL THEN CASE WHEN asked THEN 'explicit (narrative_mode=true)' ELSE 'off (explicit narrative_mode=false)' END WHEN suggested THEN 'auto-suggested (analyze data indicates high motion or dense scene cuts)' WHEN configured THEN 'server default (configure.default_narrative_mode=true)' ELSE 'off' END AS narrative,
CASE WHEN asked IS NOT NULL THEN CASE WHEN asked THEN 'explicit' ELSE 'off (explicitly disabled)' END WHEN configured AND suggested THEN 'server default (configure.default_adaptive_sampling=true)' ELSE 'off (no motion_windows or duration <= 4s)' END AS adaptive,
CASE WHEN CAST(regexp_extract(cap, '^\\s*([+-]?\\d+)', 1) AS VARCHAR) <> '' AND TRY_CAST(regexp_extract(cap, '^\\s*([+-]?\\d+)', 1) AS BIGINT) > 0 THEN TRY_CAST(regexp_extract(cap, '^\\s*([+-]?\\d+)', 1) AS BIGINT) ELSE 50000 END AS cap FROM c"""
)
def decision_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrative = rules.decide_narrative(F.col("asked"), F.col("suggested"), F.col("configured"))
    adaptive = rules.decide_adaptive(F.col("asked"), F.when(F.col("suggested"), 2).otherwise(0), F.lit(9.0), F.lit(False), F.col("configured"))
    told = [reports.provenance(narrative, reports.NARRATIVE_SOURCES).alias("narrative"), reports.provenance(adaptive, reports.ADAPTIVE_SOURCES).alias("adaptive")]
    return over(spark, sf_dir, _CHOICES, "events").select("series_id", *told, reports.output_cap(F.col("cap")).alias("cap"))


@register("SELECT user_id AS series_id, count_if(value > 100) AS n_strong, avg(CASE WHEN event_id % 3 > 0 THEN value END) AS loudness FROM events GROUP BY 1")
def strong_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, "SELECT user_id AS series_id, value / 4 AS distance, CASE WHEN event_id % 3 > 0 THEN value ELSE CAST('NaN' AS DOUBLE) END AS level FROM events", "events")
    return reports.strong_outliers(rows).join(reports.mean_loudness(rows), "series_id")


@register("SELECT event_id AS series_id, ts AS changed FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.expired_files(over(spark, sf_dir, "SELECT event_id AS series_id, ts AS changed FROM events", "events"), "2024-01-20 00:00:00")


_REQUESTS = """SELECT event_id AS series_id, CASE event_id % 7 WHEN 0 THEN 'best' WHEN 1 THEN 'max' END AS mode, CASE event_id % 6 WHEN 0 THEN 'auto' WHEN 1 THEN '0' WHEN 2 THEN '2.5' WHEN 3 THEN 'fast' END AS fps, CASE event_id % 5 WHEN 0 THEN '64' WHEN 1 THEN '512' WHEN 2 THEN 'wide' END AS resolution,
CASE event_id % 4 WHEN 0 THEN '00:00:01' WHEN 1 THEN '0:1' END AS start_time, CASE event_id % 3 WHEN 0 THEN '00:00:09.25' END AS end_time, CASE event_id % 8 WHEN 0 THEN '0' WHEN 1 THEN '4' END AS view_n, CASE event_id % 9 WHEN 0 THEN 'auto' WHEN 1 THEN '1,2,3' WHEN 2 THEN '1,2,3,4' END AS roi FROM events"""


@register(
    f"""WITH r AS ({_REQUESTS}) SELECT series_id, 'mode' AS problem FROM r WHERE mode = 'best' UNION ALL SELECT series_id, 'fps' FROM r WHERE fps IN ('0', 'fast') UNION ALL SELECT series_id, 'resolution' FROM r WHERE resolution IN ('64', 'wide') UNION ALL SELECT series_id, 'start_time' FROM r WHERE start_time = '0:1'
UNION ALL SELECT series_id, 'view' FROM r WHERE view_n = '0' UNION ALL SELECT series_id, 'roi' FROM r WHERE roi = '1,2,3'"""
)
def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.request_problems(over(spark, sf_dir, _REQUESTS, "events").withColumnRenamed("view_n", "view"))


@register("SELECT o_orderkey AS series_id, floor((sin(o_orderkey * 99.13e0 + 4.7e0) * 43758.5453e0 - floor(sin(o_orderkey * 99.13e0 + 4.7e0) * 43758.5453e0)) * 1000) AS thousandths FROM orders WHERE o_orderkey < 100000000")
def noise_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over(spark, sf_dir, "SELECT o_orderkey AS series_id FROM orders", "orders").select("series_id", F.floor(text.noise(F.col("series_id")) * 1000).cast("double").alias("thousandths"))


@register(
    """WITH e AS (SELECT event_id AS series_id, user_id AS frame, event_id % 5 AS a, event_id % 3 AS b, event_id % 11 AS broken FROM events), p AS (SELECT series_id, frame, a, b, unnest(range(12)) AS k FROM e WHERE broken > 1)
SELECT series_id, frame, CAST(k % 4 AS INT) AS x, CAST(k // 4 AS INT) AS y FROM p WHERE k % 5 = a OR k % 3 = b"""
)
def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda k: f"CASE WHEN {k} % 5 = event_id % 5 OR {k} % 3 = event_id % 3 THEN 'FF' ELSE '00' END"
    body = f"unhex(concat({', '.join(byte(k) for k in range(12))}))"
    head = "CASE event_id % 11 WHEN 0 THEN 'P6 4 3 255 ' WHEN 1 THEN 'P5 4 9 255 ' WHEN 2 THEN 'P5\n# note\n4 3 # more\n255\n' ELSE 'P5 4 3\n255 ' END"
    images = over(spark, sf_dir, f"SELECT event_id AS series_id, user_id AS frame, concat(CAST({head} AS BINARY), {body}) AS content FROM events", "events", spread=True)
    return pgm.lit_pixels(images)


_CALLS = """SELECT event_id AS series_id, CASE event_id % 7 WHEN 0 THEN 'inspect' WHEN 1 THEN 'analyze' WHEN 2 THEN 'watch' WHEN 3 THEN 'measure' WHEN 4 THEN 'configure' WHEN 5 THEN 'watch' ELSE 'paint' END AS tool, CASE WHEN event_id % 23 = 0 THEN '[]' ELSE concat('{', CASE WHEN event_id % 5 > 0 THEN '"path": "a", ' ELSE '' END, CASE event_id % 11 WHEN 0 THEN '"mode": "best", ' WHEN 1 THEN '"mode": 5, ' WHEN 2 THEN '"mode": "low", ' ELSE '' END, CASE event_id % 6 WHEN 0 THEN concat('"resolution": "', CAST(event_id % 300 AS STRING), '", ') WHEN 1 THEN '"resolution": [1], ' ELSE '' END,
CASE event_id % 4 WHEN 0 THEN concat('"fps": ', CAST(event_id % 3 - 1 AS STRING), ', ') WHEN 1 THEN '"fps": "auto", ' WHEN 2 THEN '"fps": "fast", ' ELSE '' END, CASE event_id % 9 WHEN 0 THEN '"roi": "1,2,3", ' WHEN 1 THEN '"roi": "per-window", ' ELSE '' END, CASE event_id % 8 WHEN 0 THEN '"filters": {"motion": true, "blur": "yes"}, ' WHEN 1 THEN '"filters": 1, ' WHEN 2 THEN '"filters": {}, ' ELSE '' END, CASE event_id % 10 WHEN 0 THEN '"backend": "cloud", ' WHEN 1 THEN '"default_narrative_mode": "maybe", ' WHEN 2 THEN '"default_narrative_mode": "auto", "clear_sessions": 1, ' ELSE '' END, '"x": 1}') END AS params FROM events"""


@register(
    f"""WITH c AS (SELECT *, TRY_CAST(params AS JSON) AS j FROM ({_CALLS})), k AS (SELECT *, json_type(j) = 'OBJECT' AS fits FROM c), o AS (SELECT * FROM k WHERE fits), w AS (SELECT * FROM o WHERE tool IN ('watch', 'measure'))
SELECT series_id, tool, NULL AS parameter, 'unknown tool' AS problem FROM k WHERE tool = 'paint' UNION ALL SELECT series_id, tool, NULL, 'not an object' FROM k WHERE tool <> 'paint' AND NOT fits
UNION ALL SELECT series_id, tool, 'path', 'missing' FROM o WHERE tool NOT IN ('paint', 'configure') AND NOT json_exists(j, '$.path')
UNION ALL SELECT series_id, tool, 'mode', CASE WHEN json_type(j, '$.mode') = 'VARCHAR' THEN 'out of range' ELSE 'wrong type' END FROM w WHERE json_exists(j, '$.mode') AND j ->> '$.mode' <> 'low'
UNION ALL SELECT series_id, tool, 'resolution', CASE WHEN json_type(j, '$.resolution') = 'ARRAY' THEN 'wrong type' ELSE 'out of range' END FROM w WHERE json_exists(j, '$.resolution') AND coalesce(TRY_CAST(j ->> '$.resolution' AS INT), 0) < 128
UNION ALL SELECT series_id, tool, 'fps', 'out of range' AS problem FROM o WHERE tool = 'watch' AND j ->> '$.fps' = 'fast' UNION ALL SELECT series_id, tool, 'fps', 'wrong type' FROM o WHERE tool = 'watch' AND TRY_CAST(j ->> '$.fps' AS INT) <= 0
UNION ALL SELECT series_id, tool, 'roi', 'out of range' FROM w WHERE j ->> '$.roi' = '1,2,3' UNION ALL SELECT series_id, tool, 'filters', CASE WHEN json_exists(j, '$.filters') THEN 'wrong type' ELSE 'missing' END FROM o WHERE tool = 'analyze' AND coalesce(json_type(j, '$.filters'), '') <> 'OBJECT'
UNION ALL SELECT series_id, tool, 'filters.blur', 'wrong type' FROM o WHERE tool = 'analyze' AND json_exists(j, '$.filters.blur') UNION ALL SELECT series_id, tool, 'backend', 'out of range' FROM o WHERE tool = 'configure' AND json_exists(j, '$.backend')
UNION ALL SELECT series_id, tool, 'default_narrative_mode', 'out of range' FROM o WHERE tool = 'configure' AND j ->> '$.default_narrative_mode' = 'maybe' UNION ALL SELECT series_id, tool, 'clear_sessions', 'wrong type' FROM o WHERE tool = 'configure' AND json_exists(j, '$.clear_sessions')"""
)
def tool_request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.problems(over(spark, sf_dir, _CALLS, "events"))


_SOUND = "SELECT user_id AS series_id, (user_id * 37 % 50) * 100.0e0 AS duration_s, CASE WHEN user_id % 9 = 0 THEN 5.0e0 END AS start_s, CAST(NULL AS DOUBLE) AS end_s FROM events GROUP BY user_id"
_TRIES = "SELECT user_id AS series_id, CAST(event_id % 9 AS INT) AS chunk, CAST(event_id % 2 AS INT) AS attempt, min(event_id) AS e FROM events GROUP BY user_id, event_id % 9, event_id % 2"


@register(
    f"""WITH a AS (SELECT *, CASE WHEN start_s IS NOT NULL THEN 'slice' WHEN duration_s <= 1200 THEN 'whole' ELSE 'chunks' END AS route, CAST(floor(duration_s / 600) AS INT) AS total FROM ({_SOUND})), t AS (SELECT *, e % 4 = 0 AS bad FROM ({_TRIES})),
p AS (SELECT series_id, route, chunk, total, chunk * 600.0e0 AS c0, CASE WHEN chunk = total - 1 THEN duration_s ELSE chunk * 600.0e0 + 600 END AS c1 FROM a, (SELECT CAST(unnest(range(9)) AS INT) AS chunk) WHERE route = 'chunks' AND chunk < total
UNION ALL SELECT series_id, route, 0, NULL, 0, 'Infinity'::DOUBLE FROM a JOIN (SELECT DISTINCT series_id FROM t WHERE chunk = 0) USING (series_id) WHERE route <> 'chunks'),
b AS (SELECT p.*, one.e AS e0, one.bad AS bad0, two.e AS e1, two.bad AS bad1, CASE WHEN NOT one.bad THEN one.e WHEN route = 'chunks' AND NOT two.bad THEN two.e END AS e FROM p LEFT JOIN t one ON one.series_id = p.series_id AND one.chunk = p.chunk AND one.attempt = 0 LEFT JOIN t two ON two.series_id = p.series_id AND two.chunk = p.chunk AND two.attempt = 1),
b2 AS (SELECT * REPLACE (CASE WHEN e0 IS NOT NULL AND NOT bad0 THEN e0 WHEN route = 'chunks' AND e1 IS NOT NULL AND NOT bad1 THEN e1 END AS e) FROM b),
l AS (SELECT *, 'text' AS kind, e % 700 * 1.0e0 AS s, e % 700 + e % 170 * 1.0e0 AS f, concat('line ', e) AS value FROM b2 WHERE e IS NOT NULL UNION ALL SELECT *, 'text', -20.0e0, 5.5e0, 'early' FROM b2 WHERE e IS NOT NULL UNION ALL SELECT *, 'tag', e % 650 * 1.0e0, e % 650 + 30.0e0, 'music' FROM b2 WHERE e % 3 > 0),
r AS (SELECT series_id, route, kind, chunk, total, greatest(s + c0, c0) AS start_s, least(f + c0, c1) AS end_s, value, NULL AS event FROM l WHERE route <> 'chunks' OR least(f + c0, c1) > greatest(s + c0, c0)
UNION ALL SELECT series_id, route, 'warning', chunk, total, c0, c1, 'no silence within ±30s of target boundary', 'hard_cut' FROM b2 WHERE route = 'chunks' AND chunk < total - 1
UNION ALL SELECT series_id, route, 'warning', chunk, total, c0, c1, concat('broken ', e0), 'retry' FROM b2 WHERE route = 'chunks' AND bad0
UNION ALL SELECT series_id, route, 'warning', chunk, total, c0, CASE WHEN route = 'chunks' THEN c1 END, CASE WHEN route = 'chunks' AND bad1 THEN concat('broken ', e1) WHEN bad0 THEN concat('broken ', e0) ELSE 'no answer' END, 'failed' FROM b2 WHERE e IS NULL
UNION ALL SELECT series_id, route, 'text', chunk, total, c0, c1, '[transcription failed for this segment after retry]', NULL FROM b2 WHERE e IS NULL AND route = 'chunks')
SELECT series_id, route, kind, CASE WHEN route = 'chunks' THEN chunk END AS chunk, total, start_s, end_s, value, event FROM r"""
)
def long_audio_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = over(spark, sf_dir, _SOUND, "events")
    none = assets.select("series_id", F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s")).where("false")
    plan = planning.chunk_plan(assets, none, none)
    tries = over(spark, sf_dir, _TRIES, "events")
    line = lambda start, end, value, name: f"named_struct('start_s', CAST({start} AS DOUBLE), 'end_s', CAST({end} AS DOUBLE), '{name}', {value})"
    lines = F.expr(f"array({line('e % 700', 'e % 700 + e % 170', 'concat(\"line \", e)', 'text')}, {line(-20, 5.5, '\"early\"', 'text')})")
    tags = F.expr(f"CASE WHEN e % 3 > 0 THEN array({line('e % 650', 'e % 650 + 30', '\"music\"', 'tag')}) END")
    answers = tries.select("series_id", "chunk", "attempt", F.when(F.col("e") % 4 == 0, F.concat(F.lit("broken "), F.col("e"))).alias("error"), lines.alias("lines"), tags.alias("tags"))
    return fanin.long_audio(assets, plan, answers)
