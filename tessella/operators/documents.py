"""Invariants of documents as violation rows: no rows means a valid document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_EPSILON = 1e-9


def _exploded(checks: DataFrame, keys: list[str], named: dict) -> DataFrame:
    """One row for each check that holds."""
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in named.items())))
    return checks.select(*keys, F.explode(found).alias("violation"))


def scene_violations(scenes: DataFrame, drift: float = 0.25) -> DataFrame:
    """(doc_id, pos, violation) from (doc_id, pos, id, start_s, duration_s, transition_out, target_s).

    ``late_start``: the first scene starts after zero. ``duplicate_id``: an earlier scene has the id. ``overlap``: the scene starts
    before the furthest end so far and the scene before it declares no transition. ``gap``: it starts after that end. ``drift``
    (pos null): the scenes end more than ``drift`` from the target. Scenes without start or duration are left out of the timing.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    end = F.col("start_s") + F.col("duration_s")
    seen = scenes.withColumns(
        {
            "k": F.row_number().over(order),
            "nth": F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("pos")),
            "reach": F.greatest(F.lit(0.0), F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))),
            "before": F.lag("transition_out").over(order),
        }
    )
    later = (F.col("k") > 1) & end.isNotNull()
    planned = F.coalesce(~F.col("before").isin("", "cut"), F.lit(False))
    named = {
        "late_start": (F.col("k") == 1) & (F.col("start_s") > _EPSILON),
        "duplicate_id": F.col("nth") > 1,
        "overlap": later & (F.col("start_s") < F.col("reach") - _EPSILON) & ~planned,
        "gap": later & (F.col("start_s") > F.col("reach") + _EPSILON),
    }
    ends = scenes.groupBy("doc_id").agg(F.greatest(F.lit(0.0), F.max(end)).alias("total"), F.first("target_s", ignorenulls=True).alias("target"))
    off = ends.where(F.abs(F.col("total") - F.col("target")) > drift).select("doc_id", F.lit(None).cast("int").alias("pos"), F.lit("drift").alias("violation"))
    return _exploded(seen, ["doc_id", "pos"], named).unionByName(off)


def beat_violations(beats: DataFrame, sheets: DataFrame, catalog: DataFrame, slack: float = 0.5) -> DataFrame:
    """(doc_id, pos, violation) from beats (doc_id, pos, at_s, duration_s, effect_ids), sheets (doc_id, duration_s, chunk_count,
    segments_covered, subchunks_watched) and a catalog (effect_id).

    ``unordered``: before the beat above it. ``past_end``, ``tail_past_end``: the beat, or its end, lies over ``slack`` after the asset.
    ``late_first``: the first beat starts after one second. ``unknown_effect``: an effect that the catalog lacks. With pos null:
    ``unwatched``, ``excess_segments``.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    seen = beats.withColumns({"before": F.lag("at_s").over(order), "k": F.row_number().over(order)}).join(sheets.select("doc_id", F.col("duration_s").alias("whole_s")), "doc_id")
    limit = F.col("whole_s") + slack
    named = {
        "unordered": F.col("at_s") < F.col("before") - 1e-6,
        "past_end": F.col("at_s") > limit,
        "tail_past_end": F.col("at_s") + F.col("duration_s") > limit,
        "late_first": (F.col("k") == 1) & (F.col("at_s") > 1.0),
    }
    used = beats.select("doc_id", "pos", F.explode("effect_ids").alias("effect_id"))
    unknown = used.join(catalog.select("effect_id"), "effect_id", "left_anti").select("doc_id", "pos", F.lit("unknown_effect").alias("violation"))
    of_sheet = _exploded(
        sheets.withColumn("pos", F.lit(None).cast("int")),
        ["doc_id", "pos"],
        {"unwatched": F.col("subchunks_watched") != F.col("chunk_count"), "excess_segments": F.col("segments_covered") > F.col("chunk_count")},
    )
    return _exploded(seen, ["doc_id", "pos"], named).unionByName(unknown).unionByName(of_sheet)
