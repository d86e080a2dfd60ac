"""Queries on JSON texts. Their texts vary with the row: fields come and go, have other types, stand in other orders, or are broken; the
SQL reads the same texts with DuckDB's JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import contracts
from tessella.plans.base import over, register
from tessella.plans.shared import new_folder
from tessella.sources import json_texts, tails

_ID = "CAST(event_id AS STRING)"

_PROBES = f"""SELECT event_id AS series_id, CASE event_id % 9 WHEN 0 THEN 'no json' WHEN 1 THEN '{{"format": {{"size": "1048576"}}}}' ELSE concat('{{"streams": [',
CASE event_id % 4 WHEN 0 THEN '{{"codec_type": "audio"}},' WHEN 1 THEN '' ELSE '{{"codec_type": "data", "width": 7}},' END, '{{"codec_type": "video", "codec_name": "', event_type, '", "width": ', CAST(event_id % 4000 AS STRING), ', "height": 720, "r_frame_rate": "',
CASE event_id % 3 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25/1' ELSE '50/0' END, '", "duration": "', CAST(event_id % 77 AS STRING), '.5"}}], "format": {{', CASE event_id % 5 WHEN 0 THEN '' ELSE concat('"duration": "', CAST(event_id % 99 AS STRING), '.25",') END, '"size": "', CAST(event_id * 1000 AS STRING), '"}}}}') END AS content FROM events"""


@register(
    f"""WITH p AS ({_PROBES}), j AS (SELECT series_id, TRY_CAST(content AS JSON) AS j FROM p), s AS (SELECT *, coalesce(list_filter(CAST(json_extract(j, '$.streams[*]') AS JSON[]), lambda x: x ->> 'codec_type' = 'video')[1], NULL) AS v, len(coalesce(list_filter(CAST(json_extract(j, '$.streams[*]') AS JSON[]), lambda x: x ->> 'codec_type' = 'audio'), [])) > 0 AS has_audio FROM j),
f AS (SELECT *, string_split(coalesce(v ->> 'r_frame_rate', '30/1'), '/') AS r FROM s)
SELECT series_id, CAST(coalesce(j ->> '$.format.duration', v ->> 'duration', '0') AS DOUBLE) AS duration_s, coalesce(CAST(v ->> 'width' AS INT), 0) AS width, coalesce(CAST(v ->> 'height' AS INT), 0) AS height, coalesce(v ->> 'codec_name', 'unknown') AS codec,
CAST(floor(CAST(r[1] AS DOUBLE) / CASE r[2] WHEN '0' THEN 1 ELSE CAST(r[2] AS DOUBLE) END + 0.5) AS BIGINT) AS fps, floor(CAST(coalesce(j ->> '$.format.size', '0') AS DOUBLE) / 1048576 * 10 + 0.5) / 10 AS size_mb, has_audio FROM f"""
)
def probe_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_texts.probe_metadata(over(spark, sf_dir, _PROBES, "events"))


_INFOS = f"""SELECT event_id AS series_id, CASE event_id % 8 WHEN 0 THEN '[1, 2' WHEN 1 THEN '{{}}' ELSE concat('{{"view_count": ', CASE event_id % 3 WHEN 0 THEN '"12"' WHEN 1 THEN {_ID} ELSE 'null' END, ', "title": ', CASE event_id % 4 WHEN 0 THEN '17' WHEN 1 THEN concat('"', event_type, ' title"') ELSE 'null' END,
', "uploader": "u', {_ID}, '", "extractor": ', CASE event_id % 5 WHEN 0 THEN 'true' ELSE '"SiteX"' END, ', "description": "', repeat('long text ', CAST(event_id % 3 * 300 AS INT)), '", "subtitles": {{',
CASE event_id % 7 WHEN 0 THEN '"en-GB": [1], "en-AU": [1]' WHEN 1 THEN '"de": [1], "en-AU": [1], "en-IE": [1]' WHEN 2 THEN '"en": 0' WHEN 3 THEN '"fr": [1]' ELSE '' END, '}}, "automatic_captions": {{', CASE event_id % 6 WHEN 2 THEN '"en-orig": [2], "en": [1]' WHEN 3 THEN '"english": 1' ELSE '"it": 1' END, '}}}}') END AS content FROM events"""


@register(
    f"""WITH i AS ({_INFOS}), j AS (SELECT series_id, TRY_CAST(content AS JSON) AS j FROM i), t AS (SELECT *, CASE WHEN json_type(j, '$.description') = 'VARCHAR' THEN j ->> 'description' END AS d FROM j)
SELECT series_id, lower(CASE WHEN json_type(j, '$.extractor') = 'VARCHAR' THEN j ->> 'extractor' ELSE 'url' END) AS type, CASE WHEN json_type(j, '$.title') = 'VARCHAR' THEN j ->> 'title' END AS title, CASE WHEN json_type(j, '$.uploader') = 'VARCHAR' THEN j ->> 'uploader' END AS uploader, CAST(NULL AS STRING) AS upload_date,
CASE WHEN json_type(j, '$.view_count') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(j ->> 'view_count' AS DOUBLE) END AS view_count, CASE WHEN len(d) > 4000 THEN d[1:4000] || chr(10) || '…[truncated]' ELSE d END AS description FROM t"""
)
def source_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_texts.source_info(over(spark, sf_dir, _INFOS, "events"))


_PICK = "coalesce(CASE WHEN coalesce(j ->> '$.{0}.en', '0') NOT IN ('0', '') THEN 'en' END, CASE WHEN j ->> '$.{0}.\"en-orig\"' IS NOT NULL THEN 'en-orig' END, CASE WHEN j ->> '$.{0}.\"en-US\"' IS NOT NULL THEN 'en-US' END, CASE WHEN j ->> '$.{0}.\"en-GB\"' IS NOT NULL THEN 'en-GB' END, list_filter(json_keys(j, '$.{0}'), lambda x: x LIKE 'en%')[1])"


@register(
    f"""WITH i AS ({_INFOS}), j AS (SELECT series_id, TRY_CAST(content AS JSON) AS j FROM i), b AS (SELECT series_id, {_PICK.format("subtitles")} AS s, {_PICK.format("automatic_captions")} AS a FROM j)
SELECT series_id, CASE WHEN s IS NOT NULL THEN 'subtitles' WHEN a IS NOT NULL THEN 'automatic_captions' END AS source, coalesce(s, a) AS language FROM b"""
)
def caption_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_texts.caption_track(over(spark, sf_dir, _INFOS, "events"))


_ANSWERS = """SELECT event_id AS series_id, CASE event_id % 7 WHEN 0 THEN 'oops' WHEN 1 THEN '[1]' WHEN 2 THEN '{"transcription": 5}' WHEN 3 THEN '"text"' ELSE concat('{"audio_tags": ', CASE event_id % 2 WHEN 0 THEN '[{"start": "00:00:01", "end": "00:00:02", "tag": "music"}]' ELSE 'null' END,
', "transcription": [{"text": "', event_type, '", "start": "00:00:00", "end": "00:00:0', CAST(event_id % 10 AS STRING), '"}, {"start": "00:01:00"}]}') END AS content FROM events"""


@register(
    f"""WITH a AS ({_ANSWERS}), j AS (SELECT series_id, TRY_CAST(content AS JSON) AS j FROM a)
SELECT series_id, CASE WHEN j IS NULL THEN 'not json' WHEN json_type(j) <> 'OBJECT' THEN 'not an object' END AS error, CAST(CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.transcription') = 'ARRAY' THEN json_array_length(j, '$.transcription') ELSE 0 END AS INT) AS n_rows,
CASE WHEN json_type(j) = 'OBJECT' THEN j ->> '$.transcription[0].text' END AS first_text, CASE WHEN json_type(j) = 'OBJECT' THEN j ->> '$.transcription[0].end' END AS first_end, CASE WHEN json_type(j) = 'OBJECT' THEN j ->> '$.audio_tags[0].tag' END AS first_tag FROM j"""
)
def speech_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = json_texts.speech_answer(over(spark, sf_dir, _ANSWERS, "events"))
    first = F.try_element_at("transcription", F.lit(1))
    return read.select("series_id", "error", F.size("transcription").alias("n_rows"), first["text"].alias("first_text"), first["end"].alias("first_end"), F.try_element_at("audio_tags", F.lit(1))["tag"].alias("first_tag"))


_LOGS = f"""SELECT event_id AS series_id, concat('{{"message": {{"model": "m', {_ID}, '"}}}}', chr(10), CASE event_id % 4 WHEN 0 THEN '{{"message": {{"model": "late"}}}}' WHEN 1 THEN '{{"message": {{"model": 5}}}}' WHEN 2 THEN '{{"message": {{"model": ""}}}}' ELSE '{{"message": {{"model": "cut' END, chr(10), '{{"other": "model"}}', chr(10)) AS content FROM events WHERE event_id % 5 > 0 OR event_id % 2 = 0"""


@register(
    f"""WITH l AS ({_LOGS}), r AS (SELECT series_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS row_at FROM l), j AS (SELECT series_id, row_at, TRY_CAST(line AS JSON) AS j FROM r)
SELECT series_id, arg_max(j ->> '$.message.model', row_at) AS model FROM j WHERE json_type(j, '$.message.model') = 'VARCHAR' AND j ->> '$.message.model' <> '' GROUP BY 1"""
)
def last_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_texts.last_model(over(spark, sf_dir, _LOGS, "events"))


_MANIFESTS = f"""SELECT event_id AS series_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '{{"resolutions": ' ELSE concat('{{"resolutions": {{"512/jpeg": {{"frames": [{{"timestamp": "00:00:01", "file": "a', {_ID}, '"}}, {{"timestamp": "00:00:02"}}]}}, "', CASE event_id % 2 WHEN 0 THEN 'bad' ELSE '1024/png/roi=1,2,3x4' END, '": {{"frames": [{{"timestamp": "00:00:0', CAST(event_id % 10 AS STRING), '", "file": "b"}}]}}}}}}') END AS manifest FROM events"""


@register(
    f"""WITH m AS ({_MANIFESTS}), j AS (SELECT series_id, TRY_CAST(manifest AS JSON) AS j FROM m), k AS (SELECT series_id, j, unnest(json_keys(j, '$.resolutions')) AS key FROM j), f AS (SELECT series_id, key, unnest(CAST(json_extract(j, '$.resolutions."' || key || '".frames') AS JSON[])) AS f FROM k WHERE key LIKE '%/%')
SELECT series_id, CAST(string_split(key, '/')[1] AS INT) AS resolution, string_split(key, '/')[2] AS format, coalesce(string_split(key, '/')[3], '') AS bucket, f ->> 'timestamp' AS label, f ->> 'file' AS file FROM f"""
)
def manifest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_texts.manifest_frames(over(spark, sf_dir, _MANIFESTS, "events"))


_SUMMARIES = f"""SELECT event_id AS series_id, CASE event_id % 5 WHEN 0 THEN 'a plain </x> summary' WHEN 1 THEN concat('text ', {_ID}, ' </narrative_summary><parameter name="continuity_notes">["one", "two"]') WHEN 2 THEN concat(event_type, ' <parameter name="x">[broken') WHEN 3 THEN NULL ELSE ' lead </continuity_notes> ["x"] ' END AS summary, event_id % 7 = 0 AS noted FROM events"""


@register(
    f"""WITH s AS ({_SUMMARIES}), c AS (SELECT *, regexp_extract(summary, '(?s)(</(narrative_summary|continuity_notes)\\b|<parameter\\b).*') AS leak FROM s), a AS (SELECT *, TRY_CAST(nullif(regexp_extract(leak, '(?s)\\[.*\\]'), '') AS JSON) AS j FROM c)
SELECT series_id, CASE WHEN leak <> '' THEN trim(summary[1:len(summary) - len(leak)]) ELSE coalesce(summary, '') END AS summary, CASE WHEN noted THEN 'own' WHEN j IS NOT NULL THEN array_to_string(CAST(j AS VARCHAR[]), '|') ELSE '' END AS notes FROM a"""
)
def repaired_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, _SUMMARIES, "events").withColumn("notes", F.when(F.col("noted"), F.array(F.lit("own"))))
    return json_texts.repaired_summary(rows).withColumn("notes", F.array_join("notes", "|"))


_VARIABLES = f"""SELECT event_id AS series_id, CASE event_id % 3 WHEN 0 THEN '{{"speed": 2, "hue": "red"}}' WHEN 1 THEN '{{"hue": "blue"}}' ELSE '{{"speed": -1}}' END AS defaults, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{{"speed": "fast"}}' WHEN 2 THEN '{{"speed": 0}}' WHEN 3 THEN concat('{{"hue": "', event_type, '"}}') WHEN 4 THEN 'broken' ELSE concat('{{"speed": ', {_ID}, '.5}}') END AS overrides FROM events"""


@register(
    f"""WITH v AS ({_VARIABLES}), j AS (SELECT series_id, CAST(defaults AS JSON) AS d, TRY_CAST(overrides AS JSON) AS o FROM v), n AS (SELECT *, CASE WHEN json_type(d, '$.speed') <> 'VARCHAR' AND CAST(d ->> 'speed' AS DOUBLE) > 0 THEN CAST(d ->> 'speed' AS DOUBLE) END AS ds, CASE WHEN json_type(o, '$.speed') <> 'VARCHAR' AND TRY_CAST(o ->> 'speed' AS DOUBLE) > 0 THEN TRY_CAST(o ->> 'speed' AS DOUBLE) END AS os FROM j)
SELECT series_id, coalesce(o ->> 'hue', d ->> 'hue') AS hue, CASE WHEN coalesce(o ->> 'speed', d ->> 'speed') IS NOT NULL THEN coalesce(os, ds, 1.0) END AS speed FROM n"""
)
def merged_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_texts.merged_variables(over(spark, sf_dir, _VARIABLES, "events")).select("series_id", F.try_element_at("variables", F.lit("hue")).alias("hue"), "speed")


_EFFECTS = f"""SELECT event_id AS series_id, concat('["fade", "', event_type, '"', CASE event_id % 3 WHEN 0 THEN ', "zoom"]' WHEN 1 THEN ']' ELSE '' END) AS catalog, concat('<p>x</p><script ', CASE event_id % 4 WHEN 0 THEN 'type="a" data-effect-meta' WHEN 1 THEN 'data-effect' ELSE 'data-effect-meta type="b"' END, '>', chr(10), '{{"id": "', event_type, '", "scrubbable": ', CASE event_id % 2 WHEN 0 THEN 'true' ELSE 'false' END, ', "variables": {{"speed": ', {_ID}, '}}}}</script><script>{{}}</script>') AS page FROM events"""


@register(f"WITH e AS ({_EFFECTS}), j AS (SELECT series_id, TRY_CAST(catalog AS JSON) AS j FROM e) SELECT series_id, CAST(unnest(range(CAST(json_array_length(j) AS BIGINT))) AS INT) AS pos, unnest(CAST(j AS VARCHAR[])) AS effect_id FROM j WHERE j IS NOT NULL")
def effect_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_texts.effect_catalog(over(spark, sf_dir, _EFFECTS, "events").withColumnRenamed("catalog", "content"))


@register(
    f"""WITH e AS ({_EFFECTS}), j AS (SELECT series_id, TRY_CAST(nullif(regexp_extract(page, '(?s)<script[^>]*\\bdata-effect-meta\\b[^>]*>(.*?)</script>', 1), '') AS JSON) AS j FROM e WHERE event_id_ok)
SELECT series_id, j ->> 'id' AS effect_id, CAST(j ->> 'scrubbable' AS BOOLEAN) AS scrubbable, j ->> '$.variables.speed' AS speed FROM j""".replace(" WHERE event_id_ok", "")
)
def effect_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = json_texts.effect_meta(over(spark, sf_dir, _EFFECTS, "events").withColumnRenamed("page", "content"))
    return read.select("series_id", "effect_id", "scrubbable", F.try_element_at("variables", F.lit("speed")).alias("speed"))


_CONFIGS = """SELECT event_id AS series_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{"backend"' WHEN 2 THEN '{"default_mode": "max"}' ELSE concat('{"backend": "', event_type, '"}') END AS file, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'tiny' WHEN 2 THEN '' END AS env_mode FROM events"""


@register(f"WITH c AS ({_CONFIGS}), j AS (SELECT *, TRY_CAST(file AS JSON) AS j FROM c) SELECT series_id, coalesce(j ->> 'backend', 'local') AS backend, CASE WHEN env_mode = 'low' THEN 'low' ELSE coalesce(j ->> 'default_mode', 'high') END AS default_mode, CASE WHEN env_mode = 'tiny' THEN 'tiny' END AS ignored FROM j")
def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_texts.configuration(over(spark, sf_dir, _CONFIGS, "events"))


@register("SELECT o_orderkey AS series_id, CAST(json_object('status', o_orderstatus, 'customer', o_custkey, 'priority', CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END) AS VARCHAR) AS document FROM orders")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = over(spark, sf_dir, "SELECT o_orderkey AS series_id, o_orderstatus AS status, o_custkey AS customer, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority FROM orders", "orders")
    return json_texts.as_documents(rows)


_CONTRACTS = """SELECT DISTINCT event_type AS effect_id, v.name, CASE WHEN v.name = 'hue' THEN 'text' WHEN v.name = 'speed' THEN 'rate' WHEN v.name = 'parts' THEN 'list' END AS kind, v.name = 'hue' AND event_type <> 'click' AS required FROM events CROSS JOIN (SELECT 'hue' AS name UNION ALL SELECT 'speed' UNION ALL SELECT 'parts' UNION ALL SELECT 'note') v WHERE user_id % 2 = 0"""
_USES = f"""SELECT event_id AS series_id, CASE WHEN event_id % 17 = 0 THEN 'nowhere' ELSE event_type END AS effect_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{{"hue": "red", "speed": 2.5, "parts": []}}' WHEN 3 THEN '{{"hue": 5, "speed": "fast"}}' WHEN 4 THEN concat('{{"hue": "', event_type, '", "speed": ', CAST(event_id % 3 - 1 AS STRING), '}}') WHEN 5 THEN '{{"size": 1, "note": null, "hue": "x"}}' WHEN 6 THEN '{{broken' WHEN 7 THEN concat('{{"v', {_ID}, '": true, "parts": {{}}}}') ELSE '{{}}' END AS variables FROM events"""


@register(
    f"""WITH c AS ({_CONTRACTS}), u AS ({_USES}), j AS (SELECT u.*, TRY_CAST(variables AS JSON) AS j, effect_id IN (SELECT effect_id FROM c) AS known FROM u), ok AS (SELECT * FROM j WHERE known AND (variables IS NULL OR json_type(j) = 'OBJECT')),
g AS (SELECT series_id, effect_id, unnest(json_keys(j)) AS name, j FROM ok WHERE j IS NOT NULL), t AS (SELECT g.*, json_type(j, '$."' || name || '"') AS kind_of, TRY_CAST(j ->> ('$."' || name || '"') AS DOUBLE) AS amount FROM g),
m AS (SELECT t.*, c.name AS own, c.kind FROM t LEFT JOIN c ON c.effect_id = t.effect_id AND c.name = t.name)
SELECT series_id, effect_id, NULL AS name, 'unknown effect' AS problem FROM j WHERE NOT known UNION ALL SELECT series_id, effect_id, NULL, 'not an object' FROM j WHERE known AND variables IS NOT NULL AND coalesce(json_type(j), '') <> 'OBJECT'
UNION ALL SELECT series_id, effect_id, name, CASE WHEN own IS NULL THEN 'unknown' WHEN kind = 'text' AND kind_of <> 'VARCHAR' OR kind = 'list' AND kind_of <> 'ARRAY' OR kind = 'rate' AND kind_of NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'wrong kind' WHEN kind = 'rate' AND amount <= 0 THEN 'not above zero' END AS problem FROM m WHERE problem IS NOT NULL
UNION ALL SELECT ok.series_id, ok.effect_id, c.name, 'missing' FROM ok JOIN c USING (effect_id) WHERE required AND NOT coalesce(json_exists(j, '$.' || c.name), false)"""
)
def effect_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.violations(over(spark, sf_dir, _USES, "events"), over(spark, sf_dir, _CONTRACTS, "events"))


_TALK = f"""SELECT user_id AS series_id, event_id, CASE event_id % 5 WHEN 0 THEN concat('{{"message": {{"model": "m', {_ID}, '"}}}}') WHEN 1 THEN '{{"message": {{"model": ""}}}}' WHEN 2 THEN '{{"message": {{"model": "cut' WHEN 3 THEN '{{"other": "model"}}' ELSE concat('{{"message": {{"model": ', {_ID}, '}}}}') END AS line FROM events WHERE user_id % 11 > 0 OR event_id % 5 > 0"""


@register(f"SELECT series_id, arg_max(TRY_CAST(line AS JSON) ->> '$.message.model', event_id) AS model FROM ({_TALK}) WHERE event_id % 5 = 0 GROUP BY 1 UNION ALL SELECT series_id, NULL FROM ({_TALK}) GROUP BY 1 HAVING count_if(event_id % 5 = 0) = 0")
def tail_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's lines become a log in a shared folder, which is then read from its end."""
    folder = new_folder(spark, "talk")
    tails.write_logs(over(spark, sf_dir, _TALK, "events"), folder, "event_id")
    spark.dataSource.register(tails.TailModels)
    found = spark.read.format("tail_models").load(folder)
    return found.select(F.nullif(F.regexp_extract("file", r"series_id=(-?\d+)\.txt", 1), F.lit("")).cast("long").alias("series_id"), "model")
