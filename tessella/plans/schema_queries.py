"""Queries on JSON documents against their schemas. The documents are made of orders and their lines, with a defect in most; the SQL reads the
same texts with DuckDB's JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import sources
from tessella.operators import schemas
from tessella.plans.base import over, register

_K = "o_orderkey"
_SHEETS = f"""SELECT {_K} AS doc_id, CASE {_K} % 23 WHEN 22 THEN '{{"source": ' ELSE concat('{{"source": {{"path": "', CASE {_K} % 11 WHEN 0 THEN '' ELSE 'a.mp4' END, '", "duration_seconds": ', CASE {_K} % 13 WHEN 0 THEN '"ten"' WHEN 1 THEN '0' ELSE CAST(5 + {_K} % 10 AS STRING) END, ', "watched_at_tier": "', CASE {_K} % 7 WHEN 0 THEN 'best' ELSE 'low' END, '"}}, "narrative_summary": "n", ', CASE {_K} % 5 WHEN 0 THEN '' ELSE '"spine": "s", ' END,
'"coverage": {{"tier": "mid", "chunk_count": ', CASE {_K} % 17 WHEN 0 THEN '2.5' ELSE CAST(1 + {_K} % 3 AS STRING) END, ', "segments_covered": ', CAST(1 + {_K} % 2 AS STRING), ', "subchunks_watched": 2', CASE {_K} % 19 WHEN 0 THEN ', "more": 1' ELSE '' END, '}}, "palette_hex": ["#abc", "', CASE {_K} % 6 WHEN 0 THEN 'cream' ELSE '012345' END, '"], "beats": [',
CASE {_K} % 29 WHEN 0 THEN '' ELSE concat('{{"timestamp_seconds": ', CAST({_K} % 4 AS STRING), ', "duration_seconds": 1.5, "description": "d", "effect_ids": ["e', CAST({_K} % 8 AS STRING), '"]}}, {{"timestamp_seconds": ', CAST(2 + {_K} % 14 AS STRING), ', "duration_seconds": ', CASE {_K} % 9 WHEN 0 THEN '0' ELSE '3' END, CASE {_K} % 10 WHEN 0 THEN '' ELSE ', "description": "e"' END, '}}') END, ']}}') END AS content FROM orders""".replace("{{", "{").replace("}}", "}")

_NUM = "({0} IN ('UBIGINT', 'BIGINT', 'DOUBLE'))"
_SHAPE = f"""d AS ({_SHEETS}), j AS (SELECT doc_id, TRY_CAST(content AS JSON) AS j FROM d), b AS (SELECT doc_id, unnest(range(CAST(json_array_length(j, '$.beats') AS BIGINT))) AS k, unnest(CAST(json_extract(j, '$.beats') AS JSON[])) AS b FROM j WHERE j IS NOT NULL),
shape AS (SELECT doc_id, '' AS path, 'unreadable' AS rule FROM j WHERE j IS NULL UNION ALL SELECT doc_id, 'source.path', 'length' FROM j WHERE j ->> '$.source.path' = '' UNION ALL SELECT doc_id, 'source.duration_seconds', 'type' FROM j WHERE NOT {_NUM.format("json_type(j, '$.source.duration_seconds')")}
UNION ALL SELECT doc_id, 'source.duration_seconds', 'above' FROM j WHERE TRY_CAST(j ->> '$.source.duration_seconds' AS DOUBLE) <= 0 UNION ALL SELECT doc_id, 'source.watched_at_tier', 'enum' FROM j WHERE j ->> '$.source.watched_at_tier' NOT IN ('low', 'mid', 'high', 'max') UNION ALL SELECT doc_id, 'spine', 'missing' FROM j WHERE j IS NOT NULL AND NOT list_contains(json_keys(j), 'spine')
UNION ALL SELECT doc_id, 'coverage.chunk_count', 'type' FROM j WHERE json_type(j, '$.coverage.chunk_count') = 'DOUBLE' UNION ALL SELECT doc_id, 'coverage.' || k, 'unknown' FROM (SELECT doc_id, unnest(json_keys(j, '$.coverage')) AS k FROM j) WHERE k NOT IN ('tier', 'chunk_count', 'chunk_duration_seconds', 'segments_covered', 'subchunks_watched')
UNION ALL SELECT doc_id, 'palette_hex[' || CAST(k AS STRING) || ']', 'pattern' FROM (SELECT doc_id, unnest(range(CAST(json_array_length(j, '$.palette_hex') AS BIGINT))) AS k, unnest(CAST(json_extract(j, '$.palette_hex') AS VARCHAR[])) AS c FROM j WHERE j IS NOT NULL) WHERE NOT regexp_matches(c, '^#?[0-9a-fA-F]{{3,8}}$')
UNION ALL SELECT doc_id, 'beats', 'items' FROM j WHERE json_array_length(j, '$.beats') = 0 UNION ALL SELECT doc_id, 'beats[' || CAST(k AS STRING) || '].duration_seconds', 'above' FROM b WHERE CAST(b ->> 'duration_seconds' AS DOUBLE) <= 0 UNION ALL SELECT doc_id, 'beats[' || CAST(k AS STRING) || '].description', 'missing' FROM b WHERE b ->> 'description' IS NULL)"""


@register(f"WITH {_SHAPE} SELECT doc_id, path, rule FROM shape")
def sheet_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.conformance(over(spark, sf_dir, _SHEETS, "orders", spread=True), schemas.BEAT_SHEET)


_REPORT = f"""{_SHAPE}, g AS (SELECT doc_id, j FROM j WHERE doc_id NOT IN (SELECT doc_id FROM shape)), s AS (SELECT doc_id, CAST(j ->> '$.source.duration_seconds' AS DOUBLE) AS d, CAST(j ->> '$.coverage.chunk_count' AS INT) AS n, CAST(j ->> '$.coverage.segments_covered' AS INT) AS m, CAST(j ->> '$.coverage.subchunks_watched' AS INT) AS w FROM g),
t AS (SELECT b.doc_id, k, CAST(b ->> 'timestamp_seconds' AS DOUBLE) AS at_s, CAST(b ->> 'duration_seconds' AS DOUBLE) AS dur, b, d, lag(CAST(b ->> 'timestamp_seconds' AS DOUBLE)) OVER (PARTITION BY b.doc_id ORDER BY k) AS before FROM b JOIN s ON b.doc_id = s.doc_id), p AS (SELECT *, 'beats[' || CAST(k AS STRING) || ']' AS path FROM t),
report AS (SELECT doc_id, path, rule, 'error' AS severity FROM shape UNION ALL SELECT doc_id, 'coverage', 'unwatched', 'error' FROM s WHERE w <> n UNION ALL SELECT doc_id, 'coverage', 'excess_segments', 'error' FROM s WHERE m > n UNION ALL SELECT doc_id, path, 'unordered', 'error' FROM p WHERE at_s < before - 1e-6
UNION ALL SELECT doc_id, path, 'past_end', 'error' FROM p WHERE at_s > d + 0.5 UNION ALL SELECT doc_id, path, 'tail_past_end', 'warning' FROM p WHERE at_s + dur > d + 0.5 UNION ALL SELECT doc_id, path, 'late_first', 'warning' FROM p WHERE k = 0 AND at_s > 1
UNION ALL SELECT doc_id, path, 'unknown_effect', 'error' FROM (SELECT doc_id, path, unnest(CAST(b -> 'effect_ids' AS VARCHAR[])) AS e FROM p) WHERE e NOT IN (SELECT 'e' || CAST(p_partkey % 6 AS STRING) FROM part))"""


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = over(spark, sf_dir, _SHEETS, "orders", spread=True)
    catalog = sources.table(spark, sf_dir, "part").select(F.concat(F.lit("e"), (F.col("p_partkey") % 6).cast("string")).alias("effect_id")).distinct()
    return docs, schemas.beat_sheet_report(docs, catalog)


@register(f"WITH {_REPORT} SELECT doc_id, path, rule, severity FROM report")
def beat_sheet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)[1]


@register(f"WITH {_REPORT} SELECT d.doc_id, CAST(CASE WHEN count_if(rule = 'unreadable') > 0 THEN 2 WHEN count_if(severity = 'error') > 0 THEN 1 ELSE 0 END AS INT) AS status, coalesce(count_if(severity = 'error'), 0) AS n_errors, coalesce(count_if(severity = 'warning'), 0) AS n_warnings FROM d LEFT JOIN report USING (doc_id) GROUP BY 1")
def document_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.statuses(*_report(spark, sf_dir))


_LOCKS = """SELECT o_orderkey AS doc_id, concat('{"lockVersion": ', CASE o_orderkey % 9 WHEN 0 THEN '2' ELSE '1' END, ', "meta": {"project": "', CASE o_orderkey % 8 WHEN 0 THEN 'Bad Name' ELSE 'good-name' END, '", "title": "t", "targetDurationSeconds": ', CAST(8 + o_orderkey % 5 AS STRING), ', "stage": {"width": 1920, "height": 1080}, "render": {"width": 1920, "height": 1080, "fps": ', CASE o_orderkey % 7 WHEN 0 THEN '31' ELSE '30' END,
'}}, "palette": {"tokens": [{"token": "--a", "hex": "#fff", "use": "u"}]}, "typography": {"roles": [{"role": "body", "family": "f", "weight": "400"}]}, "motion": {"eases": [{"use": "in", "ease": "e"}], "principles": ["p"]}, "audio": {"tracks": [{"role": "r", "status": "tbd", "volume": ', CASE o_orderkey % 6 WHEN 0 THEN '1.5' ELSE '0.5' END, '}]}, "scenes": [{"id": "a", "start": ', CAST(o_orderkey % 3 AS STRING), ', "duration": 4, "storyboard": "x", "effects": [], "transitionOut": "', CASE o_orderkey % 2 WHEN 0 THEN 'cut' ELSE 'fade' END,
'"}, {"id": "', CASE o_orderkey % 10 WHEN 0 THEN 'a' ELSE 'b' END, '", "start": ', CAST(3 + o_orderkey % 4 AS STRING), ', "duration": 5', CASE o_orderkey % 11 WHEN 0 THEN '' ELSE ', "storyboard": "y"' END, ', "effects": [{"ref": "e", "vars": {"any": [1]}}]}]}') AS content FROM orders"""


@register(
    f"""WITH d AS ({_LOCKS}), j AS (SELECT doc_id, CAST(content AS JSON) AS j FROM d), s AS (SELECT doc_id, unnest(range(CAST(json_array_length(j, '$.scenes') AS BIGINT))) AS k, unnest(CAST(json_extract(j, '$.scenes') AS JSON[])) AS s FROM j), t AS (SELECT doc_id, k, s, 'scenes[' || CAST(k AS STRING) || ']' AS path, CAST(s ->> 'start' AS DOUBLE) AS a, CAST(s ->> 'duration' AS DOUBLE) AS l FROM s),
r AS (SELECT *, max(a + l) OVER w AS reach, lag(s ->> 'transitionOut') OVER (PARTITION BY doc_id ORDER BY k) AS before, row_number() OVER (PARTITION BY doc_id, s ->> 'id' ORDER BY k) AS nth FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, 'lockVersion' AS path, 'enum' AS rule, 'error' AS severity FROM j WHERE j ->> 'lockVersion' <> '1' UNION ALL SELECT doc_id, 'meta.project', 'pattern', 'error' FROM j WHERE NOT regexp_matches(j ->> '$.meta.project', '^[a-z0-9]+(-[a-z0-9]+)*$') UNION ALL SELECT doc_id, 'meta.render.fps', 'enum', 'error' FROM j WHERE CAST(j ->> '$.meta.render.fps' AS INT) NOT IN (24, 25, 30, 50, 60)
UNION ALL SELECT doc_id, 'audio.tracks[0].volume', 'between', 'error' FROM j WHERE CAST(j ->> '$.audio.tracks[0].volume' AS DOUBLE) NOT BETWEEN 0 AND 1 UNION ALL SELECT doc_id, path || '.storyboard', 'missing', 'error' FROM t WHERE s ->> 'storyboard' IS NULL UNION ALL SELECT doc_id, path, 'late_start', 'error' FROM t WHERE k = 0 AND a > 1e-9 UNION ALL SELECT doc_id, path, 'duplicate_id', 'error' FROM r WHERE nth > 1
UNION ALL SELECT doc_id, path, 'overlap', 'error' FROM r WHERE k > 0 AND a < greatest(0, reach) - 1e-9 AND coalesce(before, '') IN ('', 'cut') UNION ALL SELECT doc_id, path, 'gap', 'error' FROM r WHERE k > 0 AND a > greatest(0, reach) + 1e-9 UNION ALL SELECT doc_id, 'scenes', 'drift', 'error' FROM (SELECT doc_id, max(a + l) AS e FROM t GROUP BY 1) JOIN j USING (doc_id) WHERE abs(e - CAST(j ->> '$.meta.targetDurationSeconds' AS DOUBLE)) > 0.25"""
)
def lock_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.lock_report(over(spark, sf_dir, _LOCKS, "orders", spread=True))
