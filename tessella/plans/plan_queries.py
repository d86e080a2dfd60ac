"""Queries on plans: segments, gaps, chunks, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import cost, sources
from tessella.operators import planning, signals
from tessella.plans.base import ORACLE_SQL, over, register

_T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0"
_SEGMENTS = f"""windows AS (SELECT user_id AS series_id, {_T} AS start_s, {_T} + value / 1000.0 AS end_s, value AS intensity FROM events),
req AS (SELECT DISTINCT user_id AS series_id, CAST(CASE WHEN user_id % 3 = 1 THEN 4 ELSE 40 END AS BIGINT) AS budget FROM events),
cl AS (SELECT series_id, greatest(start_s, 0.0) AS start_s, least(end_s, 31.0) AS end_s, intensity FROM windows WHERE least(end_s, 31.0) > greatest(start_s, 0.0) + 0.2),
op AS (SELECT *, CASE WHEN start_s <= max(end_s) OVER (PARTITION BY series_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM cl),
nb AS (SELECT *, sum(opens) OVER (PARTITION BY series_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS seg FROM op),
mg AS (SELECT series_id, 'motion' AS kind, min(start_s) AS start_s, max(end_s) AS end_s, max(intensity) AS intensity FROM nb GROUP BY series_id, seg),
st AS (SELECT series_id, coalesce(lag(end_s) OVER (PARTITION BY series_id ORDER BY start_s), 0.0) AS a, start_s AS b FROM mg
  UNION ALL SELECT req.series_id, coalesce(max(end_s), 0.0), 31.0 FROM req LEFT JOIN mg USING (series_id) GROUP BY req.series_id),
sp AS (SELECT * FROM mg UNION ALL SELECT series_id, 'static', a, b, NULL FROM st WHERE b - a > 0.05),
sz AS (SELECT sp.*, budget, sum(CASE WHEN kind = 'motion' THEN end_s - start_s ELSE 0 END) OVER (PARTITION BY series_id) AS moving, sum(CASE WHEN kind = 'static' THEN end_s - start_s ELSE 0 END) OVER (PARTITION BY series_id) AS resting FROM sp JOIN req USING (series_id)),
pl AS (SELECT *, moving > 0 AND budget < 6 AND moving / 31.0 < 0.08 AS sparse, CASE WHEN moving = 0 THEN 0 WHEN resting = 0 THEN budget ELSE CAST(floor(budget * 0.7) AS BIGINT) END AS mpart, (end_s - start_s) * CASE WHEN kind = 'motion' THEN greatest(1, intensity) ELSE 1 END AS w FROM sz),
pt AS (SELECT *, CASE WHEN kind = 'motion' THEN mpart ELSE budget - mpart END AS part, row_number() OVER (PARTITION BY series_id, kind ORDER BY start_s) AS idx, count(*) OVER (PARTITION BY series_id, kind) AS n, sum(w) OVER (PARTITION BY series_id, kind) AS total FROM pl WHERE NOT sparse),
sh AS (SELECT *, w / total * (part - n) AS share FROM pt),
ra AS (SELECT *, row_number() OVER (PARTITION BY series_id, kind ORDER BY w DESC, idx) AS heavy, row_number() OVER (PARTITION BY series_id, kind ORDER BY share - floor(share) DESC, idx) AS nxt, sum(floor(share)) OVER (PARTITION BY series_id, kind) AS used FROM sh),
un AS (SELECT *, CAST(CASE WHEN part <= 0 THEN 0 WHEN n > part THEN CASE WHEN heavy <= part THEN 1 ELSE 0 END ELSE 1 + floor(share) + CASE WHEN nxt <= part - n - used THEN 1 ELSE 0 END END AS BIGINT) AS units FROM ra),
segments AS (SELECT series_id, start_s, end_s, kind, greatest(CASE WHEN kind = 'motion' THEN 0.5 ELSE 0.2 END, units / (end_s - start_s)) AS fps, units AS budget, intensity FROM un WHERE units > 0
  UNION ALL SELECT series_id, greatest(0.0, (i + 0.5) * 31.0 / budget - least(0.5, 15.5 / budget)), least(31.0, (i + 0.5) * 31.0 / budget + least(0.5, 15.5 / budget)), 'uniform', 1.0, 1, NULL
  FROM (SELECT DISTINCT series_id, budget FROM pl WHERE sparse), (SELECT unnest(range(4)) AS i))"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = sources.windows(spark, sf_dir).select("series_id", "start_s", "end_s", "intensity")
    users = sources.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id")).distinct()
    requests = users.select("series_id", F.lit(0.0).alias("start0"), F.lit(31.0).alias("end0"), F.when(F.col("series_id") % 3 == 1, 4).otherwise(40).cast("long").alias("budget"))
    return planning.adaptive_segments(windows, requests)


@register(f"WITH {_SEGMENTS} SELECT * FROM segments")
def adaptive_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@register(
    f"""WITH {_SEGMENTS}, su AS (SELECT series_id, min(start_s) AS a, max(end_s) AS b, CAST(sum(budget) AS BIGINT) AS n_frames, sum(CASE WHEN kind = 'motion' THEN budget ELSE 0 END) AS mf, sum(CASE WHEN kind = 'motion' THEN end_s - start_s ELSE 0 END) AS mt, sum(end_s - start_s) AS d FROM segments GROUP BY 1),
po AS (SELECT series_id, start_s + (i + 0.5) * (end_s - start_s) / budget AS t FROM (SELECT *, unnest(range(budget)) AS i FROM segments)),
ga AS (SELECT series_id, t, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS gap FROM po), mx AS (SELECT series_id, max(gap) AS g, min(t) AS t0, max(t) AS t1 FROM ga GROUP BY 1),
r AS (SELECT series_id, n_frames, greatest(g, t0 - a, b - t1) AS max_gap, mf / n_frames AS budget_share, mt / d AS time_share, b - a AS span, mt FROM su JOIN mx USING (series_id))
SELECT series_id, n_frames, max_gap, budget_share, time_share, CASE WHEN budget_share > 0.6 AND time_share < 0.3 AND mt > 0 THEN 'concentrated' WHEN max_gap > least(5.0, span * 0.3) AND span > 4 THEN 'sparse' END AS warning FROM r"""
)
def sampling_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.sampling_gaps(_segments(spark, sf_dir))


@register(
    f"""SELECT series_id, warning, CASE warning WHEN 'concentrated' THEN CAST(floor(budget_share * 100 + 0.5) AS BIGINT) END AS budget_pct, CASE warning WHEN 'concentrated' THEN CAST(floor(time_share * 100 + 0.5) AS BIGINT) END AS time_pct,
CASE warning WHEN 'concentrated' THEN 100 - CAST(floor(time_share * 100 + 0.5) AS BIGINT) END AS rest_pct, CASE warning WHEN 'sparse' THEN floor(max_gap * 10 + 0.5) / 10 END AS gap_s, n_frames FROM ({ORACLE_SQL["sampling_gaps"]}) WHERE warning IS NOT NULL"""
)
def sampling_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.warning_numbers(planning.sampling_gaps(_segments(spark, sf_dir)))


@register(
    f"""WITH w AS (SELECT user_id AS series_id, {_T} AS start_s, {_T} + value / 1000.0 AS end_s, value FROM events), assets AS (SELECT DISTINCT series_id, CAST(series_id % 8 * 5 AS DOUBLE) AS d FROM w),
sz AS (SELECT *, greatest(0, CAST(floor(d / 5.0) AS INT) - 1) AS n FROM assets), go AS (SELECT *, k * 5.0e0 AS goal FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM sz)),
a AS (SELECT g.series_id, k, arg_min((start_s + end_s) / 2, (abs((start_s + end_s) / 2 - goal), (start_s + end_s) / 2)) AS m FROM go g JOIN w USING (series_id) WHERE value > 150 AND abs((start_s + end_s) / 2 - goal) <= 0.5 GROUP BY 1, 2),
b AS (SELECT g.series_id, k, arg_min((start_s + end_s) / 2, (abs((start_s + end_s) / 2 - goal), (start_s + end_s) / 2)) AS m FROM go g JOIN w USING (series_id) WHERE value > 50 AND abs((start_s + end_s) / 2 - goal) <= 0.5 GROUP BY 1, 2),
en AS (SELECT go.series_id, n, k, coalesce(a.m, b.m, goal) AS end_s, coalesce(a.m, b.m) IS NOT NULL AS clean_cut, CASE WHEN a.m IS NOT NULL THEN NULL WHEN b.m IS NOT NULL THEN 'loose_threshold' ELSE 'hard_cut' END AS warning FROM go LEFT JOIN a USING (series_id, k) LEFT JOIN b USING (series_id, k)
  UNION ALL SELECT series_id, n, n + 1, d, true, NULL FROM sz),
fr AS (SELECT *, coalesce(lag(end_s) OVER (PARTITION BY series_id ORDER BY k), 0.0) AS start_s FROM en)
SELECT series_id, CAST(k - 1 AS INT) AS chunk, CAST(n + 1 AS INT) AS total, start_s, greatest(0.0, start_s - 0.25) AS actual_start_s, end_s, clean_cut, warning FROM fr"""
)
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    silences = sources.windows(spark, sf_dir)
    assets = silences.select("series_id").distinct().withColumn("duration_s", (F.col("series_id") % 8 * 5).cast("double"))
    return planning.chunk_plan(assets, silences.where("intensity > 150"), silences.where("intensity > 50"), 5.0, 0.25, 0.5)


_LEVELS = "SELECT user_id AS series_id, event_id / 8.0e0 AS t, -60 + value / 2 AS x FROM events"
_QUIET = """SELECT series_id, min(t) AS start_s, max(t) AS end_s FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - row_number() OVER (PARTITION BY series_id, x < {0} ORDER BY t) AS run FROM lv) WHERE x < {0} GROUP BY series_id, run HAVING max(t) - min(t) >= {1}"""


@register(f"WITH lv AS ({_LEVELS}) SELECT *, 'strict' AS kind FROM ({_QUIET.format(-40, 0.5)}) UNION ALL SELECT *, 'loose' FROM ({_QUIET.format(-30, 0.2)})")
def silence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = over(spark, sf_dir, _LEVELS, "events")
    strict, loose = (signals.quiet_spans(levels, *x) for x in (planning.STRICT_SILENCE, planning.LOOSE_SILENCE))
    return strict.withColumn("kind", F.lit("strict")).unionByName(loose.withColumn("kind", F.lit("loose")))


@register(
    f"""WITH lv AS ({_LEVELS}), st AS ({_QUIET.format(-40, 0.5)}), lo AS ({_QUIET.format(-30, 0.2)}), a AS (SELECT series_id, max(t) AS d FROM lv GROUP BY 1), n AS (SELECT *, greatest(0, CAST(floor(d / 20) AS INT) - 1) AS n FROM a), g AS (SELECT series_id, n, d, unnest(range(1, n + 1)) AS k FROM n), q AS (SELECT *, k * 20.0e0 AS goal FROM g),
p AS (SELECT q.series_id, k, arg_min(m, (abs(m - goal), m)) AS m FROM q JOIN (SELECT series_id, (start_s + end_s) / 2 AS m FROM st) s ON q.series_id = s.series_id AND abs(m - goal) <= 4 GROUP BY 1, 2), r AS (SELECT q.series_id, k, arg_min(m, (abs(m - goal), m)) AS m FROM q JOIN (SELECT series_id, (start_s + end_s) / 2 AS m FROM lo) s ON q.series_id = s.series_id AND abs(m - goal) <= 4 GROUP BY 1, 2),
e AS (SELECT q.series_id, k, coalesce(p.m, r.m, goal) AS end_s, CASE WHEN p.m IS NOT NULL THEN NULL WHEN r.m IS NOT NULL THEN 'loose_threshold' ELSE 'hard_cut' END AS warning FROM q LEFT JOIN p USING (series_id, k) LEFT JOIN r USING (series_id, k) UNION ALL SELECT series_id, n + 1, d, NULL FROM n)
SELECT series_id, CAST(k - 1 AS INT) AS chunk, coalesce(lag(end_s) OVER (PARTITION BY series_id ORDER BY k), 0) AS start_s, end_s, warning FROM e"""
)
def detected_chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = over(spark, sf_dir, _LEVELS, "events")
    assets = levels.groupBy("series_id").agg(F.max("t").alias("duration_s"))
    plan = planning.chunk_plan_by(assets, lambda level, least: signals.quiet_spans(levels, level, least), 20.0, 0.0, 4.0)
    return plan.select("series_id", "chunk", "start_s", "end_s", "warning")


_ASSETS = "SELECT o_orderkey AS series_id, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS duration_s, CASE o_orderkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1080 END AS width, CASE o_orderkey % 3 WHEN 0 THEN 1080 WHEN 1 THEN 1920 END AS height FROM orders"
_COSTS = f"""tiers AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {k}, {r}, {b}, {t}, CAST({f} AS DOUBLE))" for m, k, r, _, b, t, f in planning.TIERS)}) AS v(mode, rank, resolution, view_cap, frame_tokens, fps)),
a AS (SELECT *, greatest(1, CAST(floor(fps * duration_s + 0.5) AS BIGINT)) AS frames_drawn, CAST(ceil(resolution * coalesce(floor(resolution * (height / CAST(width AS DOUBLE)) + 0.5), floor(resolution * 9 / 16.0e0 + 0.5)) / 750.0e0) AS BIGINT) AS image_tokens, least(fps, 6.0e0) AS thorough_fps FROM ({_ASSETS}), tiers),
b AS (SELECT *, least(frames_drawn, view_cap) AS frames_returned, greatest(1, CAST(ceil(duration_s / (view_cap / thorough_fps)) AS BIGINT)) AS chunks FROM a),
c AS (SELECT *, CAST(floor((frames_returned * frame_tokens + 8000) * 1.25e0 + 0.5) AS BIGINT) AS tokens_per_call, frames_returned * image_tokens + 3000 AS conversation_per_call FROM b),
costs AS (SELECT series_id, mode, rank, resolution, fps, CAST(view_cap AS BIGINT) AS view_cap, frames_drawn, frames_returned, tokens_per_call, tokens_per_call > 50000 AS exceeds_cap, image_tokens, conversation_per_call, thorough_fps, chunks, tokens_per_call * chunks AS tokens_thorough, conversation_per_call * chunks AS conversation_thorough, conversation_per_call * chunks >= 813000 AS compacts FROM c)"""


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.cost_estimates(spark.sql(_ASSETS.replace("FROM orders", "FROM {orders}"), orders=sources.table(spark, sf_dir, "orders")))


def _costs_at(cap: int) -> str:
    """The same at another cap of tokens: frames of the table for 100,000, or a share of those for 50,000."""
    frames = {m: a if cap >= 100000 else max(1, b * cap // 50000) for m, _, _, a, b, _, _ in planning.TIERS}
    tiers = ", ".join(f"('{m}', {k}, {r}, {frames[m]}, {t}, CAST({f} AS DOUBLE))" for m, k, r, _, _, t, f in planning.TIERS)
    start, end = _COSTS.index("(VALUES ") + 8, _COSTS.index(") AS v(mode")
    return _COSTS[:start] + tiers + _COSTS[end:].replace("tokens_per_call > 50000", f"tokens_per_call > {cap}")


_CAPS = (20000, 64000, 120000)


@register(" UNION ALL ".join(f"SELECT {cap} AS cap, * FROM (WITH {_costs_at(cap)} SELECT series_id, mode, view_cap, frames_returned, tokens_per_call, exceeds_cap, chunks FROM costs)" for cap in _CAPS))
def cost_estimates_by_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = spark.sql(_ASSETS.replace("FROM orders", "FROM {orders}"), orders=sources.table(spark, sf_dir, "orders"))
    parts = [planning.cost_estimates(assets, cap).select(F.lit(cap).alias("cap"), "series_id", "mode", "view_cap", "frames_returned", "tokens_per_call", "exceeds_cap", "chunks") for cap in _CAPS]
    return parts[0].union(parts[1]).union(parts[2])


@register(f"WITH {_COSTS} SELECT mode, count(*) AS n_assets, count_if(exceeds_cap) AS n_over_cap, CAST(floor(avg(tokens_per_call) + 0.5) AS BIGINT) AS tokens_per_call, CAST(sum(tokens_thorough) AS BIGINT) AS tokens_thorough, count_if(compacts) AS n_compacting FROM costs GROUP BY mode")
def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.totals(_costs(spark, sf_dir))


@register(f"WITH {_COSTS} SELECT * FROM costs")
def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir)


@register(f"WITH {_COSTS} SELECT series_id, CASE WHEN NOT bool_or(compacts AND mode = 'high') THEN 'high' WHEN NOT bool_or(compacts AND mode = 'mid') THEN 'mid' ELSE 'low' END AS mode FROM costs GROUP BY 1")
def recommended_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.recommend_tier(_costs(spark, sf_dir))


@register(
    """WITH f AS (SELECT user_id AS series_id, event_id AS t, CAST(floor(value) * 40 AS BIGINT) AS n_chars, event_type = 'click' AS moving FROM events),
z AS (SELECT *, count(*) OVER s AS n, sum(n_chars) OVER s AS chars, count_if(moving) OVER s AS nm, row_number() OVER (PARTITION BY series_id, moving ORDER BY t) - 1 AS pos FROM f WINDOW s AS (PARTITION BY series_id)),
k AS (SELECT *, greatest(2, CAST(floor(76000 / (chars / n / 3.5e0 + 50)) AS BIGINT)) AS keep, ceil(chars / 3.5e0) + n * 50 + 12000 AS est, CASE WHEN moving THEN nm ELSE n - nm END AS size FROM z),
q AS (SELECT *, n > 2 AND est > 88000 AND keep < n AS over_, CASE WHEN nm = 0 THEN keep WHEN moving THEN least(keep, nm) ELSE greatest(0, least(keep - nm, n - nm)) END AS quota FROM k),
w AS (SELECT DISTINCT series_id, moving, CASE WHEN quota = 1 THEN 0 ELSE CAST(floor(i * (size - 1) / CAST(quota - 1 AS DOUBLE) + 0.5) AS BIGINT) END AS pos FROM (SELECT DISTINCT series_id, moving, size, quota, unnest(range(CAST(quota AS BIGINT))) AS i FROM q WHERE over_ AND quota < size))
SELECT series_id, t, n_chars, moving FROM q WHERE NOT over_ OR quota >= size UNION ALL SELECT series_id, t, n_chars, moving FROM q JOIN w USING (series_id, moving, pos) WHERE over_ AND quota < size"""
)
def trimmed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.col("event_id").alias("t"), (F.floor("value") * 40).alias("n_chars"), (F.col("event_type") == "click").alias("moving"))
    return planning.trim_frames(rows)
