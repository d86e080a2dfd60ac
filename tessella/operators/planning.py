"""Integer apportionment and contiguous grouping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import intervals


def distribute_budget(weights: DataFrame, budget: int | str, floor: int = 1, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(*keys, idx, units): shares of an integer budget (a number, or a column of it) that add up to it exactly.

    Each row gets ``floor`` units, its share of the rest rounded down, and leftovers go to the largest fractions, ties to the smaller
    idx. Where the floors exceed the budget, the heaviest rows get one unit each. Weights that are all zero count as equal.

    Three passes: sums of each group; counts by slots of scores, partial before the shuffle, which tell the slot where the leftovers end; and the rows, ranked
    within their slot. A group's rows never meet in one task unless their scores are alike.
    """
    key, slots = list(keys), 1024
    sums = weights.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"), F.max("w").alias("top"), (F.max(budget) if isinstance(budget, str) else F.max(F.lit(budget))).alias("budget"))
    rest = F.col("budget") - floor * F.col("n")
    share = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1.0 / F.col("n")) * rest
    sized = weights.select(*key, "idx", "w").join(sums, key).withColumns({"tight": rest < 0, "whole": F.floor(share), "fraction": share - F.floor(share)})
    score = F.when(~F.col("tight"), F.col("fraction")).when(F.col("top") > 0, F.col("w") / F.col("top")).otherwise(0.0)
    rated = sized.withColumn("score", score).withColumn("slot_", F.floor(F.col("score") * (slots - 1)))
    counts = rated.groupBy(*key, "slot_").agg(F.count(F.lit(1)).alias("c_"), F.sum("whole").alias("whole_"), F.first("tight").alias("tight_"), F.first("budget").alias("budget_"), F.first(rest).alias("rest_"))
    group = Window.partitionBy(*key)
    above = F.coalesce(F.sum("c_").over(group.orderBy(F.desc("slot_")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.when(F.col("budget_") <= 0, 0).when(F.col("tight_"), F.col("budget_")).otherwise(F.col("rest_") - F.sum("whole_").over(group))
    left = counts.select(*key, "slot_", (more - above).alias("left_"))
    rank = F.row_number().over(Window.partitionBy(*key, "slot_").orderBy(F.desc("score"), "idx"))
    least = F.when((F.col("budget") <= 0) | F.col("tight"), 0).otherwise(floor + F.col("whole"))
    placed = rated.select(*key, "idx", "slot_", "score", least.alias("least")).withColumn("rank_", rank).join(left, [*key, "slot_"])
    return placed.select(*key, "idx", (F.col("least") + (F.col("rank_") <= F.col("left_")).cast("long")).cast("long").alias("units"))


def near_equal_groups(rows: DataFrame, most: int = 12, per: int = 4) -> DataFrame:
    """Contiguous groups of each series, the first ones larger by one: M = min(most, max(1, ceil(n / per)))."""
    series = Window.partitionBy("series_id")
    sized = rows.withColumns({"n": F.count(F.lit(1)).over(series), "pos": F.row_number().over(series.orderBy("idx")) - 1})
    m = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("n") / float(per)).cast("int")))
    base, extra = F.floor(F.col("n") / F.col("m")), F.col("n") % F.col("m")
    group = F.when(F.col("pos") < extra * (base + 1), F.floor(F.col("pos") / (base + 1))).otherwise(extra + F.floor((F.col("pos") - extra * (base + 1)) / base))
    return sized.withColumn("m", m).select("series_id", "idx", group.cast("long").alias("grp"))


def shard_ranges(totals: DataFrame, shards: int) -> DataFrame:
    """(series_id, shard, first, end): [floor(k T / N), floor((k + 1) T / N)) for each series' total, empty ranges dropped."""
    k = totals.select("series_id", "total", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    first, end = (F.floor((F.col("shard") + d) * F.col("total") / float(shards)) for d in (0, 1))
    return k.select("series_id", "shard", first.alias("first"), end.alias("end")).where(F.col("end") > F.col("first"))


def adaptive_segments(windows: DataFrame, requests: DataFrame) -> DataFrame:
    """(series_id, start_s, end_s, kind, fps, budget, intensity): where to spend a frame budget.

    ``windows`` are (series_id, start_s, end_s, intensity), ``requests`` (series_id, start0, end0, budget). Windows are clamped to the
    request; those of 0.2 or less go, the others merge. Seventy percent of the budget goes to them, by length times intensity, the
    rest to the spans between, by length; all of it to one side where the other has none. Where less than 8 % of the time is covered
    and the budget is under six, equal slices with a frame in the middle of each are taken instead (kind 'uniform').
    """
    clamped = windows.join(requests, "series_id").select("series_id", F.greatest("start_s", "start0").alias("start_s"), F.least("end_s", "end0").alias("end_s"), "intensity")
    merged = intervals.merge_windows(clamped.where(F.col("end_s") > F.col("start_s") + 0.2))
    still = intervals.complement(merged, requests.select("series_id", "start0", "end0"), 0.05)
    motion = merged.select("series_id", F.lit("motion").alias("kind"), "start_s", "end_s", "intensity")
    spans = motion.unionByName(still.select("series_id", F.lit("static").alias("kind"), "start_s", "end_s", F.lit(None).cast("double").alias("intensity")))
    series, length = Window.partitionBy("series_id"), F.col("end_s") - F.col("start_s")
    of_kind = lambda kind: F.sum(F.when(F.col("kind") == kind, length).otherwise(0.0)).over(series)
    sized = spans.join(requests, "series_id").withColumns({"moving": of_kind("motion"), "resting": of_kind("static"), "idx": F.row_number().over(Window.partitionBy("series_id", "kind").orderBy("start_s"))})
    sparse = (F.col("moving") > 0) & (F.col("budget") < 6) & (F.col("budget") > 0) & (F.col("moving") / (F.col("end0") - F.col("start0")) < 0.08)
    first = F.when(F.col("moving") == 0, 0).when(F.col("resting") == 0, F.col("budget")).otherwise(F.floor(F.col("budget") * 0.7))
    part = F.when(F.col("kind") == "motion", first).otherwise(F.col("budget") - first)
    weight = length * F.when(F.col("kind") == "motion", F.greatest(F.lit(1.0), "intensity")).otherwise(1.0)
    plan = sized.withColumns({"sparse": sparse, "part": part, "w": weight})
    units = distribute_budget(plan.where("NOT sparse").select("series_id", "kind", "idx", "w", "part"), "part", 1, ("series_id", "kind"))
    least = F.when(F.col("kind") == "motion", 0.5).otherwise(0.2)
    split = plan.where("NOT sparse").drop("budget").join(units.where("units > 0"), ["series_id", "kind", "idx"])
    split = split.select("series_id", "start_s", "end_s", "kind", F.greatest(least, F.col("units") / length).alias("fps"), F.col("units").alias("budget"), "intensity")
    tiles = plan.where("sparse").select("series_id", "start0", "end0", "budget").distinct().withColumn("i", F.explode(F.expr("sequence(0, CAST(budget AS INT) - 1)")))
    step = (F.col("end0") - F.col("start0")) / F.col("budget")
    middle, half = F.col("start0") + (F.col("i") + 0.5) * step, F.least(F.lit(0.5), step / 2)
    uniform = tiles.select(
        "series_id", F.greatest("start0", middle - half).alias("start_s"), F.least("end0", middle + half).alias("end_s"),
        F.lit("uniform").alias("kind"), F.lit(1.0).alias("fps"), F.lit(1).cast("long").alias("budget"), F.lit(None).cast("double").alias("intensity"),
    )
    return split.unionByName(uniform)


def sampling_gaps(segments: DataFrame) -> DataFrame:
    """(series_id, n_frames, max_gap, budget_share, time_share, warning) of a plan's frames, which lie at the middle of equal parts.

    ``max_gap`` counts from the first segment's start to the last one's end. ``concentrated``: over 60 % of the frames lie on under
    30 % of the time. Else ``sparse``: a span of over 4 has a gap of over 5, or of over 30 % of it.
    """
    by_time, length = Window.partitionBy("series_id").orderBy("t"), F.col("end_s") - F.col("start_s")
    moving = F.col("kind") == "motion"
    sums = segments.groupBy("series_id").agg(
        F.min("start_s").alias("first"), F.max("end_s").alias("last"), F.sum("budget").alias("n_frames"), F.sum(length).alias("time"),
        F.sum(F.when(moving, F.col("budget")).otherwise(0)).alias("moving_frames"), F.sum(F.when(moving, length).otherwise(0.0)).alias("moving_time"),
    )
    points = segments.where("budget > 0").withColumn("i", F.explode(F.expr("sequence(0, CAST(budget AS INT) - 1)"))).select("series_id", (F.col("start_s") + (F.col("i") + 0.5) * length / F.col("budget")).alias("t"))
    inner = points.withColumn("gap", F.col("t") - F.lag("t").over(by_time)).groupBy("series_id").agg(F.max("gap").alias("inner"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    read = sums.join(inner, "series_id", "left")
    span = F.col("last") - F.col("first")
    gap = F.when(F.col("t0").isNull(), span).otherwise(F.greatest("inner", F.col("t0") - F.col("first"), F.col("last") - F.col("t1")))
    rated = read.select("series_id", "n_frames", gap.alias("max_gap"), (F.col("moving_frames") / F.col("n_frames")).alias("budget_share"), (F.col("moving_time") / F.col("time")).alias("time_share"), span.alias("span"), "moving_time")
    concentrated = (F.col("budget_share") > 0.6) & (F.col("time_share") < 0.3) & (F.col("moving_time") > 0)
    sparse = (F.col("max_gap") > F.least(F.lit(5.0), F.col("span") * 0.3)) & (F.col("span") > 4)
    return rated.select("series_id", "n_frames", "max_gap", "budget_share", "time_share", F.when(concentrated, "concentrated").when(sparse, "sparse").alias("warning"))


def warning_numbers(gaps: DataFrame) -> DataFrame:
    """(series_id, warning, budget_pct, time_pct, rest_pct, gap_s, n_frames) of ``sampling_gaps`` with a warning, rounded as warnings tell them: shares
    for concentrated plans, the gap in tenths for sparse ones."""
    whole = lambda c: F.floor(F.col(c) * 100 + 0.5)
    dense, sparse = F.col("warning") == "concentrated", F.col("warning") == "sparse"
    return gaps.where("warning IS NOT NULL").select(
        "series_id", "warning", F.when(dense, whole("budget_share")).alias("budget_pct"), F.when(dense, whole("time_share")).alias("time_pct"), F.when(dense, 100 - whole("time_share")).alias("rest_pct"),
        F.when(sparse, F.floor(F.col("max_gap") * 10 + 0.5) / 10.0).alias("gap_s"), "n_frames",
    )


#: Chunks whose cuts meet in one row; series whose chunks are told in step.
_BLOCK, _ABREAST = 256, 256


def chunk_plan(assets: DataFrame, strict: DataFrame, loose: DataFrame, size: float = 600.0, overlap: float = 0.0, tolerance: float = 30.0) -> DataFrame:
    """(series_id, chunk, total, start_s, actual_start_s, end_s, clean_cut, warning): cuts near every ``size`` of (series_id, duration_s).

    Each cut moves to the middle of the nearest strict silence (series_id, start_s, end_s) within ``tolerance``, else of a loose one
    ('loose_threshold'), else it stays ('hard_cut'). The last chunk may be nearly twice as long.

    The plan has a row for each chunk of each series, so it can be far larger than its input. About ``_ABREAST`` series are told in step, all their first
    chunks, then their second ones: most cuts stay at their goal, so neighbours are alike and column files of the plan small.
    """
    n_cuts = F.greatest(F.lit(0), F.floor(F.col("duration_s") / size).cast("int") - 1)
    sized = assets.select("series_id", "duration_s", n_cuts.alias("n"))
    k = F.col("k")
    # a silence tells the few goals near it, so goals, which can be many more than silences, are neither joined nor sorted
    found = strict.select("series_id", "start_s", "end_s", F.lit(True).alias("strict")).unionByName(loose.select("series_id", "start_s", "end_s", F.lit(False).alias("strict")))
    middles = found.select("series_id", "strict", ((F.col("start_s") + F.col("end_s")) / 2).alias("t")).where("t IS NOT NULL")
    around = F.sequence(F.floor((F.col("t") - tolerance) / size), F.ceil((F.col("t") + tolerance) / size))
    off = F.abs(F.col("t") - k * size)
    near = middles.withColumn("k", F.explode(around)).where((k >= 1) & (off <= tolerance))
    best = lambda kind: F.min_by(F.when(kind, F.col("t")), F.when(kind, F.struct(off, "t")))
    cuts = near.groupBy("series_id", "k").agg(best(F.col("strict")).alias("a"), best(~F.col("strict")).alias("b"))
    # the cuts of _BLOCK chunks in turn, and the one before them, meet those chunks in one row
    part = lambda x: F.floor(x / _BLOCK)
    told = cuts.select("series_id", F.explode(F.array_distinct(F.array(part(k), part(k + 1)))).alias("part"), F.struct(k.cast("int").alias("k"), F.struct("a", "b").alias("cut")).alias("e"))
    known = told.groupBy("series_id", "part").agg(F.map_from_entries(F.collect_list("e")).alias("cuts"))
    # series are dealt by hash to rows of about _ABREAST of them, one for each block
    rows_of = F.broadcast(sized.agg(F.ceil((F.count(F.lit(1)) + 1) / _ABREAST).alias("of")))
    dealt = F.pmod(F.xxhash64("series_id"), F.col("of"))
    together = sized.crossJoin(rows_of).groupBy(dealt.alias("dealt")).agg(F.sort_array(F.collect_list(F.struct("series_id", "duration_s", "n"))).alias("all"), (F.max("n") + 1).alias("most"))
    blocks = together.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), part(F.col("most"))))).withColumn("all", F.filter("all", lambda x: x["n"] + 1 >= F.col("part") * _BLOCK))
    # a few bytes of blocks make many rows, so their number of tasks is not left to their bytes
    blocks = blocks.repartition(8 * assets.sparkSession.sparkContext.defaultParallelism, "dealt", "part")
    theirs = known.where("series_id IS NOT NULL").crossJoin(rows_of).groupBy(dealt.alias("dealt"), "part").agg(F.map_from_entries(F.collect_list(F.struct("series_id", "cuts"))).alias("known"))
    joined = blocks.join(theirs, ["dealt", "part"], "left").select("part", "most", F.transform("all", lambda x: F.struct(x["series_id"].alias("series_id"), x["duration_s"].alias("duration_s"), x["n"].alias("n"), F.try_element_at("known", x["series_id"]).alias("cuts"))).alias("all"))
    first, last = F.greatest(F.lit(1), (F.col("part") * _BLOCK).cast("int")), F.least("most", (F.col("part") * _BLOCK + (_BLOCK - 1)).cast("int"))
    rows = joined.select("all", F.explode(F.sequence(first, last)).alias("k")).select("k", F.explode("all").alias("of")).select("k", "of.*").where(k <= F.col("n") + 1)
    rows = rows.select("series_id", "duration_s", "n", "k", F.try_element_at("cuts", k).alias("own"), F.try_element_at("cuts", k - 1).alias("before"))
    inner = k <= F.col("n")
    end = F.when(inner, F.coalesce("own.a", "own.b", k * size)).otherwise(F.col("duration_s"))
    start = F.when(k > 1, F.coalesce("before.a", "before.b", (k - 1) * size)).otherwise(0.0)
    clean = ~inner | F.coalesce("own.a", "own.b").isNotNull()
    warning = F.when(~inner | F.col("own.a").isNotNull(), None).when(F.col("own.b").isNotNull(), "loose_threshold").otherwise("hard_cut")
    plan = rows.select("series_id", (k - 1).alias("chunk"), (F.col("n") + 1).alias("total"), start.alias("start_s"), end.alias("end_s"), clean.alias("clean_cut"), warning.alias("warning"))
    return plan.select("series_id", "chunk", "total", "start_s", F.greatest(F.lit(0.0), F.col("start_s") - overlap).alias("actual_start_s"), "end_s", "clean_cut", "warning")


# Level and length of silences that cuts are looked for in, the strict ones first.
STRICT_SILENCE, LOOSE_SILENCE = (-40.0, 0.5), (-30.0, 0.2)


def chunk_plan_by(assets: DataFrame, silences: Callable[[float, float], DataFrame], size: float = 600.0, overlap: float = 0.0, tolerance: float = 30.0) -> DataFrame:
    """``chunk_plan`` with silences from any detector: ``silences(level, least seconds)`` gives (series_id, start_s, end_s)."""
    return chunk_plan(assets, silences(*STRICT_SILENCE), silences(*LOOSE_SILENCE), size, overlap, tolerance)


# Fixed values: (mode, rank, resolution, frames at a cap of 100,000 tokens, frames at 50,000, tokens of a frame, frames a second).
TIERS = (("low", 0, 384, 25, 200, 2700, 1.5), ("mid", 1, 512, 17, 150, 3800, 3.0), ("high", 2, 1024, 4, 30, 11000, 6.0), ("max", 3, 1536, 2, 20, 21000, 12.5))
STATIC_TOKENS, CONVERSATION_TOKENS, MARGIN, DIVISOR, COMPACTION = 8000, 3000, 1.25, 750, 813000


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def cost_estimates(assets: DataFrame, cap: int = 50000) -> DataFrame:
    """One row for each of (series_id, duration_s, width, height) and tier: frames, tokens a call and for thorough coverage."""
    names = ("mode", "rank", "resolution", "at_100k", "at_50k", "frame_tokens", "fps")
    tiers = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, tier))) for tier in TIERS))
    rows = assets.select("series_id", "duration_s", "width", "height", F.inline(tiers))
    scaled = F.floor(F.col("at_50k") * (cap / 50000))
    frames = F.col("at_100k") if cap >= 100000 else F.greatest(F.lit(1), scaled)
    drawn = F.greatest(F.lit(1), _half_up(F.col("fps") * F.col("duration_s")))
    height = F.coalesce(_half_up(F.col("resolution") * (F.col("height") / F.nullif("width", F.lit(0)))), _half_up(F.col("resolution") * 9 / 16))
    rows = rows.withColumns({"view_cap": frames.cast("long"), "frames_drawn": drawn, "image_tokens": F.ceil(F.col("resolution") * height / float(DIVISOR))})
    rows = rows.withColumns({"frames_returned": F.least("frames_drawn", "view_cap"), "thorough_fps": F.least("fps", F.lit(6.0))})
    rows = rows.withColumns(
        {
            "tokens_per_call": _half_up((F.col("frames_returned") * F.col("frame_tokens") + STATIC_TOKENS) * MARGIN),
            "conversation_per_call": F.col("frames_returned") * F.col("image_tokens") + CONVERSATION_TOKENS,
            "chunks": F.greatest(F.lit(1), F.ceil(F.col("duration_s") / (F.col("view_cap") / F.col("thorough_fps")))),
        }
    )
    total = F.col("conversation_per_call") * F.col("chunks")
    return rows.select(
        "series_id", "mode", "rank", "resolution", "fps", "view_cap", "frames_drawn", "frames_returned", "tokens_per_call", (F.col("tokens_per_call") > cap).alias("exceeds_cap"), "image_tokens",
        "conversation_per_call", "thorough_fps", "chunks", (F.col("tokens_per_call") * F.col("chunks")).alias("tokens_thorough"), total.alias("conversation_thorough"), (total >= COMPACTION).alias("compacts"),
    )


def recommend_tier(costs: DataFrame, current: str = "high") -> DataFrame:
    """(series_id, mode): the current tier or the next cheaper one whose thorough coverage fits; 'low' where none does."""
    rank = {tier[0]: tier[1] for tier in TIERS}[current]
    fits = F.when(~F.col("compacts"), F.struct("rank", "mode"))
    return costs.where(F.col("rank") <= rank).groupBy("series_id").agg(F.coalesce(F.max(fits)["mode"], F.lit("low")).alias("mode"))


def trim_frames(frames: DataFrame, cap: int = 88000, texts: int = 12000, per_frame: int = 50, per_token: float = 3.5) -> DataFrame:
    """Frames (series_id, t, n_chars, moving) whose transport fits a token cap, by one choice from their mean size.

    A series of over two frames whose estimate exceeds ``cap`` keeps as many as its mean size lets fit: moving frames first, then
    still ones, evenly spaced. Larger frames among those kept may leave the sum above ``cap``; ``delivery.trimmed`` measures again until it
    fits. ``texts`` are the tokens of a response beside its frames.
    """
    series = Window.partitionBy("series_id")
    n, chars = F.count(F.lit(1)).over(series), F.sum("n_chars").over(series)
    sized = frames.withColumns({"n": n, "chars": chars, "n_moving": F.count_if("moving").over(series)})
    estimate = F.ceil(F.col("chars") / per_token) + F.col("n") * per_frame + texts
    keep = F.greatest(F.lit(2), F.floor((cap - texts) / (F.col("chars") / F.col("n") / per_token + per_frame)))
    over = (F.col("n") > 2) & (estimate > cap) & (keep < F.col("n"))
    pos = F.row_number().over(Window.partitionBy("series_id", "moving").orderBy("t")) - 1
    marked = sized.withColumns({"over": over, "keep": keep, "pos": pos})
    quota = F.when(F.col("n_moving") == 0, F.col("keep")).when(F.col("moving"), F.least("keep", "n_moving")).otherwise(F.greatest(F.lit(0), F.least(F.col("keep") - F.col("n_moving"), F.col("n") - F.col("n_moving"))))
    size = F.when(F.col("moving"), F.col("n_moving")).otherwise(F.col("n") - F.col("n_moving"))
    quoted = marked.withColumns({"quota": quota, "size": size})
    return quoted.where(~F.col("over") | _evenly_kept(F.col("pos"), F.col("size"), F.col("quota"))).select("series_id", "t", "n_chars", "moving")


def _evenly_kept(pos: Column, size: Column, count: Column) -> Column:
    """Is the position among round(i (size - 1) / (count - 1)) for i below count? The nearest i is tried; all where count is size or more."""
    near = F.floor(pos * (count - 1) / F.greatest(F.lit(1), size - 1) + 0.5)
    hit = lambda i: (i >= 0) & (i < count) & (_half_up(i * (size - 1) / F.greatest(F.lit(1), count - 1)) == pos)
    return F.when(count >= size, True).when(count <= 0, False).when(count == 1, pos == 0).otherwise(hit(near) | hit(near - 1) | hit(near + 1))
