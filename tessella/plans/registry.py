"""Queries of the library outside ``llm`` and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import sources
from tessella.functions import table_functions, text
from tessella.operators import intervals, planning, signals
from tessella.plans.base import ORACLE_SQL, QUERIES
from tessella.plans.base import register as _register

_T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0"
_SAMPLES = f"samples AS (SELECT user_id AS series_id, {_T} AS t, value AS x FROM events)"
_WINDOWS = f"windows AS (SELECT user_id AS series_id, event_id AS win_id, {_T} AS start_s, {_T} + value / 1000.0 AS end_s, value AS intensity FROM events)"
_MEDIAN = "list_sort(list({0}))[CAST(floor(count(*) / 2) AS INT) + 1]"
_STATS = f"""med AS (SELECT series_id, count(*) AS n, {_MEDIAN.format("x")} AS med FROM samples GROUP BY 1),
stats AS (SELECT series_id, any_value(n) AS n, any_value(med) AS med, greatest({_MEDIAN.format("abs(x - med)")}, {{floor}}) AS mad FROM samples JOIN med USING (series_id) GROUP BY 1)"""
_MERGED = """opened AS (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY series_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM windows),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY series_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS seg FROM opened),
merged AS (SELECT series_id, CAST(seg AS BIGINT) AS seg, min(start_s) AS start_s, max(end_s) AS end_s, max(intensity) AS intensity FROM numbered GROUP BY 1, 2)"""

@_register(f"WITH {_SAMPLES}, {_STATS.format(floor='1.0')} SELECT series_id, n, med, mad FROM stats")
def robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.robust_stats(sources.samples(spark, sf_dir), 1.0)


@_register(
    f"""WITH {_SAMPLES}, {_STATS.format(floor="0.5")},
wide AS (SELECT *, max(t) OVER s AS dur, CAST(greatest(2, floor(count(*) OVER s / greatest(1, max(t) OVER s) / 2 + 0.5)) AS BIGINT) AS half FROM samples WINDOW s AS (PARTITION BY series_id)),
smooth AS (SELECT series_id, t, x, dur, row_number() OVER w AS rn, avg(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN half PRECEDING AND half FOLLOWING) AS sm FROM wide WINDOW w AS (PARTITION BY series_id ORDER BY t)),
hot AS (SELECT s.* FROM smooth s JOIN stats USING (series_id) WHERE n >= 8 AND sm > med + 1.5 * mad),
opened AS (SELECT *, CASE WHEN rn = lag(rn) OVER w + 1 OR t - lag(t) OVER w <= 1.0 THEN 0 ELSE 1 END AS opens FROM hot WINDOW w AS (PARTITION BY series_id ORDER BY t)),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM opened),
spans AS (SELECT series_id, g, min(t) AS a, max(t) AS b, min(rn) AS ra, max(rn) AS rb, any_value(dur) AS dur FROM grouped GROUP BY 1, 2 HAVING max(t) - min(t) >= 0.4),
means AS (SELECT p.series_id, g, a, b, p.dur, avg(sm) AS mean FROM spans p JOIN smooth s ON p.series_id = s.series_id AND s.rn BETWEEN ra AND rb GROUP BY ALL),
cut AS (SELECT series_id, greatest(0.0, a - 0.1) AS s, least(greatest(0.0, dur - 0.5), b + 0.1) AS e, mean FROM means)
SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY s) AS INT) AS win_id, floor(s * 1000 + 0.5) / 1000.0 AS start_s, floor(e * 1000 + 0.5) / 1000.0 AS end_s, floor(mean * 10 + 0.5) / 10.0 AS intensity FROM cut WHERE e - s >= 0.4"""
)
def motion_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.motion_windows(sources.samples(spark, sf_dir))


@_register(
    f"""WITH {_SAMPLES}, opened AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY series_id ORDER BY t) <= 0.25 THEN 0 ELSE 1 END AS opens FROM samples),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS cluster FROM opened),
placed AS (SELECT *, row_number() OVER (PARTITION BY series_id, cluster ORDER BY x DESC, t) AS place, count(*) OVER (PARTITION BY series_id, cluster) AS n_rows FROM numbered)
SELECT series_id, CAST(cluster AS BIGINT) AS cluster, t, x AS score, n_rows FROM placed WHERE place = 1"""
)
def session_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.session_clusters(sources.samples(spark, sf_dir).withColumnRenamed("x", "score"), 0.25)


@_register(
    f"""WITH {_SAMPLES}, {_STATS.format(floor="1.0")},
scored AS (SELECT series_id, t, x, floor(abs(x - med) / mad * 10 + 0.5) / 10.0 AS score FROM samples JOIN stats USING (series_id) WHERE abs(x - med) / mad > 1.8),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY score DESC, t) AS INT) AS place FROM scored)
SELECT * FROM placed WHERE place <= 50"""
)
def top_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.top_outliers(sources.samples(spark, sf_dir))


@_register(
    f"""WITH {_SAMPLES}, gaps AS (SELECT series_id, lag(t) OVER (PARTITION BY series_id ORDER BY t) AS from_t, t AS to_t FROM samples),
placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY to_t - from_t DESC, from_t) AS place FROM gaps WHERE from_t IS NOT NULL)
SELECT series_id, from_t, to_t FROM placed WHERE place = 1"""
)
def largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.largest_gap(sources.samples(spark, sf_dir))


def _sample_sql(place: str) -> str:
    return f"""WITH {_SAMPLES}, sized AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS INT) AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM samples),
wanted AS (SELECT DISTINCT series_id, CAST({place} AS INT) AS pos FROM (SELECT series_id, count(*) AS n FROM samples GROUP BY 1), (SELECT unnest(range(20)) AS i) WHERE n > 20)
SELECT series_id, pos, t, x FROM sized JOIN wanted USING (series_id, pos) UNION ALL SELECT series_id, pos, t, x FROM sized WHERE n <= 20"""


@_register(_sample_sql("floor(i * (n - 1) / 19.0 + 0.5)"))
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.even_sample(sources.samples(spark, sf_dir), 20)


@_register(_sample_sql("floor(i * n / 20.0)"))
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.even_sample(sources.samples(spark, sf_dir), 20, "floor")


@_register(
    f"""WITH {_SAMPLES}, sized AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM samples),
stepped AS (SELECT *, greatest(1, CAST(floor(n / 10.0) AS INT)) AS step FROM sized)
SELECT series_id, t, x, n FROM stepped WHERE pos % step = 0 AND pos / step < 10"""
)
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.decimate(sources.samples(spark, sf_dir), 10)


@_register(f"WITH {_WINDOWS}, {_MERGED} SELECT * FROM merged")
def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_windows(sources.windows(spark, sf_dir))


@_register(
    f"""WITH {_WINDOWS}, {_MERGED}, inner_ AS (SELECT series_id, coalesce(lag(end_s) OVER (PARTITION BY series_id ORDER BY start_s), 0.0) AS start_s, start_s AS end_s FROM merged),
tails AS (SELECT series_id, max(end_s) AS start_s, 31.0 AS end_s FROM merged GROUP BY 1)
SELECT * FROM (SELECT * FROM inner_ UNION ALL SELECT * FROM tails) WHERE end_s - start_s > 0.05"""
)
def static_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge_windows(sources.windows(spark, sf_dir))
    bounds = merged.select("series_id").distinct().select("series_id", F.lit(0.0).alias("start0"), F.lit(31.0).alias("end0"))
    return intervals.complement(merged, bounds)


@_register(
    f"""WITH {_WINDOWS} SELECT a.series_id, a.win_id AS seg_id, min(b.win_id) AS win_id FROM windows a LEFT JOIN windows b
ON a.series_id = b.series_id AND a.start_s < b.end_s AND a.end_s > b.start_s AND b.win_id % 2 = 1 WHERE a.win_id % 2 = 0 GROUP BY 1, 2"""
)
def first_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.windows(spark, sf_dir)
    return intervals.first_overlap(rows.where("win_id % 2 = 0").withColumnRenamed("win_id", "seg_id"), rows.where("win_id % 2 = 1"))


@_register(
    f"""WITH {_SAMPLES}, targets AS (SELECT series_id, CAST(k AS INT) AS k, CAST(k AS DOUBLE) AS goal FROM (SELECT DISTINCT series_id FROM samples), (SELECT unnest(range(31)) AS k)),
pairs AS (SELECT a.*, t, row_number() OVER (PARTITION BY a.series_id, k ORDER BY abs(t - goal), t) AS place FROM targets a LEFT JOIN samples b ON a.series_id = b.series_id AND abs(t - goal) <= 0.25)
SELECT series_id, k, goal, t FROM pairs WHERE place = 1"""
)
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sources.samples(spark, sf_dir)
    targets = points.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("k")).withColumn("goal", F.col("k").cast("double"))
    return intervals.nearest_within(targets, points, 0.25)


@_register(
    f"""WITH {_WINDOWS}, reach AS (SELECT series_id, win_id AS pos, start_s, max(end_s) OVER (PARTITION BY series_id ORDER BY win_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM windows)
SELECT series_id, pos, CASE WHEN start_s < reach - 1e-9 THEN 'overlap' ELSE 'gap' END AS violation FROM reach WHERE start_s < reach - 1e-9 OR start_s > reach + 1e-9"""
)
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_audit(sources.windows(spark, sf_dir).withColumnRenamed("win_id", "pos"))


@_register(f"WITH {_WINDOWS} SELECT series_id, win_id, greatest(start_s, 10.0) AS start_s, least(end_s, 20.0) AS end_s, intensity FROM windows WHERE least(end_s, 20.0) > greatest(start_s, 10.0)")
def clamp_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.clamp(sources.windows(spark, sf_dir), 10.0, 20.0)


_BUDGET_SQL = """WITH weights AS (SELECT c_nationkey AS series_id, c_custkey AS idx, CAST(floor(greatest(c_acctbal, 0)) AS DOUBLE) AS w FROM customer),
sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, sum(w) OVER (PARTITION BY series_id) AS total FROM weights),
shares AS (SELECT *, (CASE WHEN total > 0 THEN w / total ELSE 1.0 / n END) * ({budget} - n) AS share FROM sized),
placed AS (SELECT *, floor(share) AS whole, row_number() OVER (PARTITION BY series_id ORDER BY w DESC, idx) AS heavy,
  row_number() OVER (PARTITION BY series_id ORDER BY share - floor(share) DESC, idx) AS next, sum(floor(share)) OVER (PARTITION BY series_id) AS used FROM shares)
SELECT series_id, idx, CAST(CASE WHEN n > {budget} THEN CASE WHEN heavy <= {budget} THEN 1 ELSE 0 END ELSE 1 + whole + CASE WHEN next <= {budget} - n - used THEN 1 ELSE 0 END END AS BIGINT) AS units FROM placed"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("series_id"), F.col("c_custkey").alias("idx"), F.floor(F.greatest("c_acctbal", F.lit(0.0))).cast("double").alias("w"))


@_register(_BUDGET_SQL.format(budget=1000))
def distribute_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.distribute_budget(_weights(spark, sf_dir), 1000)


@_register(_BUDGET_SQL.format(budget=20))
def distribute_tight_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.distribute_budget(_weights(spark, sf_dir), 20)


@_register(
    """WITH sized AS (SELECT o_custkey AS series_id, o_orderkey AS idx, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
m AS (SELECT *, least(12, greatest(1, CAST(ceil(n / 4.0) AS INT))) AS m FROM sized)
SELECT series_id, idx, CAST(CASE WHEN pos < (n % m) * (n // m + 1) THEN pos // (n // m + 1) ELSE n % m + (pos - (n % m) * (n // m + 1)) // (n // m) END AS BIGINT) AS grp FROM m"""
)
def near_equal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.near_equal_groups(sources.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series_id"), F.col("o_orderkey").alias("idx")))


@_register(
    """WITH totals AS (SELECT o_custkey AS series_id, count(*) AS total FROM orders GROUP BY 1)
SELECT * FROM (SELECT series_id, CAST(k AS INT) AS shard, CAST(floor(k * total / 8.0) AS BIGINT) AS first, CAST(floor((k + 1) * total / 8.0) AS BIGINT) AS "end" FROM totals, (SELECT unnest(range(8)) AS k)) WHERE "end" > first"""
)
def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.shard_ranges(sources.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg(F.count(F.lit(1)).alias("total")), 8)


_MADE_UP = " OR ".join("regexp_matches(text, '(?i)" + p.replace("'", "''") + "')" for p in text.MADE_UP_PHRASES)


@_register("SELECT conv_id AS series_id, sum(len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{2,}'))) >= 3 AND sum(len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]'))) >= 15 AS has_speech FROM conversations GROUP BY 1")
def has_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.has_speech(sources.transcript(spark, sf_dir))


@_register(
    f"""WITH counts AS (SELECT conv_id AS series_id, lower(trim(text)) AS norm, count(*) AS c, min(turn) AS first FROM conversations GROUP BY 1, 2),
repeated AS (SELECT series_id, arg_min(norm, first) AS repeat_text, arg_min(c, first) AS repeat_n FROM counts WHERE c >= 3 GROUP BY 1),
hits AS (SELECT conv_id AS series_id, count(*) AS n, count_if({_MADE_UP}) AS n_made_up FROM conversations GROUP BY 1)
SELECT series_id, n, CAST(n_made_up AS BIGINT) AS n_made_up, repeat_text, repeat_n,
(coalesce(repeat_n, 0) > 0 AND coalesce(repeat_n, 0) * 2 >= n) OR (n_made_up > 0 AND n_made_up * 2 >= n) AS flagged FROM hits LEFT JOIN repeated USING (series_id)"""
)
def transcript_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.transcript_verdict(sources.transcript(spark, sf_dir))


@_register(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS plain FROM pages"""
)
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("plain"))


@_register(
    """WITH m AS (SELECT user_id AS series_id, avg(CASE WHEN event_type = 'click' THEN floor(value) END) AS si, avg(CASE WHEN event_type <> 'click' THEN floor(value) END) AS ti FROM events GROUP BY 1)
SELECT series_id, CASE WHEN si IS NULL THEN 'unknown' WHEN si > 50 THEN 'high' WHEN si > 25 THEN 'moderate' ELSE 'low' END AS detail,
CASE WHEN ti IS NULL THEN 'unknown' WHEN ti > 30 THEN 'high' WHEN ti > 10 THEN 'moderate' ELSE 'low' END AS motion FROM m"""
)
def content_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.col("event_type") == "click"
    means = sources.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("series_id")).agg(F.avg(F.when(click, F.floor("value"))).alias("si"), F.avg(F.when(~click, F.floor("value"))).alias("ti"))
    detail, motion = text.content_profile(F.col("si"), F.col("ti"))
    return means.select("series_id", detail.alias("detail"), motion.alias("motion"))


@_register(
    """SELECT event_id, lpad(CAST(CAST(floor(value * 60) AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(value * 60) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(value * 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS label,
CAST(floor(value * 60) AS DOUBLE) AS seconds FROM events"""
)
def clock_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.table(spark, sf_dir, "events").select("event_id", text.clock_label(F.col("value") * 60).alias("label"))
    return rows.withColumn("seconds", text.clock_seconds(F.col("label")))


@_register("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_matches(url, '^https?://') AS is_web FROM pages")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PROTOCOL")).isin("http", "https").alias("is_web"))


def _told(spark: SparkSession, rows: DataFrame, call: str) -> DataFrame:
    """A table function on the rows, called in SQL."""
    table_functions.register(spark)
    return spark.sql(f"SELECT * FROM {call.format('TABLE(SELECT * FROM {rows})')}", rows=rows)


@_register(ORACLE_SQL["motion_windows"])
def sql_motion_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sources.samples(spark, sf_dir), "motion_windows({} PARTITION BY series_id)")


@_register(ORACLE_SQL["session_clusters"])
def sql_session_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sources.samples(spark, sf_dir).withColumnRenamed("x", "score"), "session_clusters({} PARTITION BY series_id ORDER BY t, gap => 0.25)")


@_register(ORACLE_SQL["robust_stats"])
def sql_robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sources.samples(spark, sf_dir), "robust_stats({} PARTITION BY series_id, floor => 1.0)")


from tessella.plans import delivery_queries, document_queries, label_queries, log_queries, mask_queries, plan_queries, report_queries, rule_queries, schema_queries, source_queries, stream_queries, subject_queries  # noqa: E402, F401

__all__ = ["ORACLE_SQL", "QUERIES"]
