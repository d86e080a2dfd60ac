"""Operators on series of samples: every one takes all series at once and is keyed by ``series_id``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import intervals


def rounded(x: Column, digits: int = 3) -> Column:
    """Half-up rounding by floor, the same in every engine."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / F.lit(float(scale))


def upper_medians(rows: DataFrame, *columns: str) -> DataFrame:
    """(series_id, one column for each of ``columns``): the middle value, or the upper of the two middle ones, never their mean; nulls do not count.

    Values are counted first, with partial counts before the shuffle; running counts over the distinct values of a series then tell its
    middle one. Nothing of a series is held in memory: its distinct values stream, sorted, through one task.
    """
    values = rows.select("series_id", F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns)))).where("v IS NOT NULL")
    counted = values.groupBy("series_id", "name", "v").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("series_id", "name")
    ranked = counted.withColumns({"upto": F.sum("c").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(whole)})
    middle = F.floor(F.col("n") / 2) + 1
    found = ranked.where((F.col("upto") >= middle) & (F.col("upto") - F.col("c") < middle))
    return found.groupBy("series_id").agg(*(F.max(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in columns))


def robust_stats(samples: DataFrame, floor: float) -> DataFrame:
    """(series_id, n, med, mad): upper median and upper median of absolute deviations, at least ``floor``.

    One pass over the samples: distinct values are counted, with partial counts before the shuffle; both medians come from the counts of a series, which
    stream, sorted by value and then by distance, through one task.
    """
    whole = Window.partitionBy("series_id")
    counted = samples.groupBy("series_id", F.col("x").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    known = F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)
    upto = lambda by: F.sum("known").over(whole.orderBy(F.col(by).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("known", known).withColumns({"n": F.sum("c").over(whole), "middle": F.floor(F.sum("known").over(whole) / 2) + 1, "upto": upto("v")})
    here = (F.col("upto") >= F.col("middle")) & (F.col("upto") - F.col("known") < F.col("middle"))
    away = ranked.withColumn("med", F.max(F.when(here, F.col("v"))).over(whole)).withColumn("off", F.abs(F.col("v") - F.col("med")))
    return away.withColumn("upto", upto("off")).where(here).select("series_id", "n", "med", F.greatest("off", F.lit(floor)).alias("mad"))


def session_clusters(scenes: DataFrame, gap: float) -> DataFrame:
    """Rows no more than ``gap`` after the row before form a cluster; of each the row with the highest score stays, the earliest of equals."""
    by_time = Window.partitionBy("series_id").orderBy("t")
    opened = scenes.withColumn("opens", F.when(F.col("t") - F.lag("t").over(by_time) <= gap, 0).otherwise(1))
    numbered = opened.withColumn("cluster", F.sum("opens").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy("series_id", "cluster").orderBy(F.desc("score"), "t"))
    size = F.count(F.lit(1)).over(Window.partitionBy("series_id", "cluster"))
    return numbered.withColumns({"place": best, "n_rows": size}).where("place = 1").select("series_id", "cluster", "t", "score", "n_rows")


def _centred_means(samples: DataFrame, half: int) -> DataFrame:
    """The samples with rn, dur and sm, the mean over each row's window, as a difference of running sums; a window with a value that is not finite has NaN.

    Long running sums would round, and a mean that equals a limit would come out above or below it. So each value is split at a bit that its whole series
    shares: running sums of the upper parts are exact, and the rests are 2^50 times smaller than the series' largest value.
    """
    whole, by_time = Window.partitionBy("series_id"), Window.partitionBy("series_id").orderBy("t", F.col("x").asc_nulls_last())
    so_far = by_time.rowsBetween(Window.unboundedPreceding, 0)
    finite = F.abs("x") < float("inf")  # false for NaN, which is the largest
    value, bits = F.when(finite, F.col("x").cast("double")).otherwise(0.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.max(F.when(finite, F.abs("x"))).over(whole) * F.count(F.lit(1)).over(whole))) + 2)
    upper = F.when(bits < float("inf"), (value + bits) - bits).otherwise(value)
    columns = samples.columns
    samples = samples.withColumn("upper_", upper).withColumn("rest_", value - F.col("upper_"))
    sums = {"ru": F.sum("upper_"), "rr": F.sum("rest_"), "rc": F.count("x"), "rb": F.sum(F.when(finite | F.col("x").isNull(), 0).otherwise(1))}
    # most series have the least width, whose frame is a literal: a mean of its own values, without the rounding of long sums
    width = F.greatest(F.lit(half), F.floor(F.col("n_") / F.greatest(F.lit(1.0), F.col("dur")) / 2 + 0.5))
    near = F.avg("x").over(by_time.rowsBetween(-half, half))
    numbered = samples.withColumns({"rn": F.row_number().over(by_time), "dur": F.max("t").over(whole), "n_": F.count(F.lit(1)).over(whole), "near": near, **{k: f.over(so_far) for k, f in sums.items()}, **{f"all_{k}": f.over(whole) for k, f in sums.items()}})
    # a row of a wider series tells its running sums to the rows whose windows end or begin there, in the same part of the same shuffle
    row = F.struct(*columns, "rn", "dur", "n_", "width", "near", *(f"all_{k}" for k in sums))
    told = F.struct(*sums).cast("struct<ru: double, rr: double, rc: bigint, rb: bigint>")

    def at(place: Column, what: str) -> Column:
        return F.struct(place.cast("long").alias("at_"), *(F.when(F.lit(k == what), v).alias(k) for k, v in (("row", row), ("hi", told), ("lo", told))))

    own = at(F.col("rn"), "row")
    ends = F.array(own, at(F.col("rn") - F.col("width"), "hi"), at(F.col("rn") + F.col("width") + 1, "lo"))
    spread = numbered.withColumn("width", width).select("series_id", F.explode(F.when(F.col("width") > half, ends).otherwise(F.array(own))).alias("p")).select("series_id", "p.*")
    met = spread.groupBy("series_id", "at_").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("row", "hi", "lo"))).where("row IS NOT NULL")
    last = F.col("row.rn") + F.col("row.width") >= F.col("row.n_")
    part = {k: F.when(last, F.col(f"row.all_{k}")).otherwise(F.col(f"hi.{k}")) - F.coalesce(F.col(f"lo.{k}"), F.lit(0)) for k in sums}
    mean = F.when(part["rb"] > 0, F.lit(float("nan"))).when(part["rc"] > 0, (part["ru"] + part["rr"]) / part["rc"])
    return met.select(*(F.col(f"row.{c}").alias(c) for c in columns), F.col("row.rn").alias("rn"), F.when(F.col("row.width") == half, F.col("row.near")).otherwise(mean).alias("sm"), F.col("row.dur").alias("dur"))


def motion_windows(samples: DataFrame, min_rows: int = 8, k: float = 1.5, mad_floor: float = 0.5, half: int = 2, join_gap: float = 1.0, min_length: float = 0.4, pad: float = 0.1, tail: float = 0.5) -> DataFrame:
    """(series_id, win_id, start_s, end_s, intensity): runs where the centred rolling mean exceeds median + k * MAD of the raw series.

    The mean takes max(``half``, round(n / max(1, duration) / 2)) samples on either side: one unit of time in dense series. Series with fewer than ``min_rows`` samples have none. Runs no more than ``join_gap`` apart join; windows shorter than
    ``min_length`` go, the others are padded and clamped to [0, duration - tail]. intensity is the mean of the smoothed values over
    all rows of the joined window.
    """
    by_time = Window.partitionBy("series_id").orderBy("rn")  # in order of t, and of equal times as they were numbered
    stats = robust_stats(samples, mad_floor).where(F.col("n") >= min_rows)
    smooth = _centred_means(samples, half)
    marked = smooth.join(stats, "series_id").withColumn("hot", F.coalesce(F.col("sm") > F.col("med") + k * F.col("mad"), F.lit(False)))
    of_hot = lambda c: F.when(F.col("hot"), F.col(c))
    earlier, so_far = by_time.rowsBetween(Window.unboundedPreceding, -1), by_time.rowsBetween(Window.unboundedPreceding, 0)
    near = (F.col("rn") == F.last(of_hot("rn"), ignorenulls=True).over(earlier) + 1) | (F.col("t") - F.last(of_hot("t"), ignorenulls=True).over(earlier) <= join_gap)
    opened = marked.withColumn("opens", (F.col("hot") & ~F.coalesce(near, F.lit(False))).cast("int"))
    grouped = opened.withColumn("g", F.sum("opens").over(so_far)).where("g > 0").withColumn("rb", F.max(of_hot("rn")).over(Window.partitionBy("series_id", "g")))
    means = (
        grouped.where("rn <= rb")  # from a run's first row to its last one, the rows between joined runs included
        .groupBy("series_id", "g")
        .agg(F.min(of_hot("t")).alias("a"), F.max(of_hot("t")).alias("b"), F.first("dur").alias("dur"), F.avg("sm").alias("mean"))
        .where(F.col("b") - F.col("a") >= min_length)
    )
    start = F.greatest(F.lit(0.0), F.col("a") - pad)
    end = F.least(F.greatest(F.lit(0.0), F.col("dur") - tail), F.col("b") + pad)
    out = means.select("series_id", start.alias("s"), end.alias("e"), "mean").where(F.col("e") - F.col("s") >= min_length)
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("s"))
    return out.select("series_id", number.alias("win_id"), rounded(F.col("s")).alias("start_s"), rounded(F.col("e")).alias("end_s"), rounded(F.col("mean"), 1).alias("intensity"))


def hot_runs(samples: DataFrame, join_s: float = 1.0, idle_s: float = 60.0, least_s: float = 0.4) -> DataFrame:
    """(series_id, start_us, end_us, n_hot, peak): runs of hot samples (series_id, at timestamp, hot boolean, value).

    Hot samples with none but hot ones between them are one run if no more than ``idle_s`` apart, with others between them if no more than ``join_s``
    apart. Runs shorter than ``least_s`` go; samples with a null time, flag or value are passed over. ``streaming.stateful.hot_runs`` tells the same
    of a stream.
    """
    rows = samples.where("at IS NOT NULL AND hot IS NOT NULL AND value IS NOT NULL").select("series_id", F.unix_micros("at").alias("us"), "hot", F.col("value").cast("double").alias("value"))
    by_time = Window.partitionBy("series_id").orderBy("us", F.desc("hot"), "value")
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    last_hot = F.last(F.when(F.col("hot"), F.col("us")), ignorenulls=True).over(earlier)
    between = F.coalesce(~F.lag("hot").over(by_time), F.lit(False))
    limit = F.when(between, F.lit(round(join_s * 1e6))).otherwise(F.lit(round(idle_s * 1e6)))
    opened = rows.withColumns({"gap": F.col("us") - last_hot, "limit": limit}).where("hot").withColumn("opens", F.when(F.col("gap") <= F.col("limit"), 0).otherwise(1))
    grouped = opened.withColumn("run", F.sum("opens").over(Window.partitionBy("series_id").orderBy("us", "value").rowsBetween(Window.unboundedPreceding, 0)))
    runs = grouped.groupBy("series_id", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n_hot"), F.max("value").alias("peak"))
    return runs.where(F.col("end_us") - F.col("start_us") >= round(least_s * 1e6)).drop("run")


def top_outliers(samples: DataFrame, floor: float = 1.0, limit_score: float = 1.8, most: int = 50) -> DataFrame:
    """Samples whose distance from the median is more than ``limit_score`` MADs; the ``most`` farthest of each series, earliest of equals."""
    stats = robust_stats(samples, floor)
    scored = samples.join(stats, "series_id").withColumn("score", rounded(F.abs(F.col("x") - F.col("med")) / F.col("mad"), 1)).where(F.abs(F.col("x") - F.col("med")) / F.col("mad") > limit_score)
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("score"), "t"))
    return scored.withColumn("place", place).where(F.col("place") <= most).select("series_id", "t", "x", "score", "place")


def quiet_spans(samples: DataFrame, limit: float, least_s: float) -> DataFrame:
    """(series_id, start_s, end_s): runs of samples (series_id, t, x) below ``limit`` that last ``least_s`` at least, from the first to the last of them."""
    by_time = Window.partitionBy("series_id").orderBy("t")
    marked = samples.withColumn("quiet", F.coalesce(F.col("x") < limit, F.lit(False)))
    numbered = marked.withColumn("run", F.row_number().over(by_time) - F.row_number().over(Window.partitionBy("series_id", "quiet").orderBy("t")))
    spans = numbered.where("quiet").groupBy("series_id", "run").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"))
    return spans.where(F.col("end_s") - F.col("start_s") >= least_s).select("series_id", "start_s", "end_s")


def largest_gap(samples: DataFrame) -> DataFrame:
    """The longest stretch between two samples of each series, the first of equals."""
    by_time = Window.partitionBy("series_id").orderBy("t")
    gaps = samples.select("series_id", F.lag("t").over(by_time).alias("from_t"), F.col("t").alias("to_t")).where("from_t IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(F.col("to_t") - F.col("from_t")), "from_t"))
    return gaps.withColumn("place", place).where("place = 1").select("series_id", "from_t", "to_t")


def even_sample(samples: DataFrame, count: int, stride: str = "round") -> DataFrame:
    """``count`` evenly spaced rows of each series, or all: positions round(i (n - 1) / (count - 1)), or floor(i n / count)."""
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("t")) - 1
    sized = samples.withColumns({"pos": number, "n": F.count(F.lit(1)).over(Window.partitionBy("series_id"))})
    i = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    place = F.floor(F.col("i") * (F.col("n") - 1) / float(count - 1) + 0.5) if stride == "round" and count > 1 else F.floor(F.col("i") * F.col("n") / float(count))
    wanted = samples.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > count).select("series_id", "n", i.alias("i")).select("series_id", place.cast("int").alias("pos")).distinct()
    few = sized.where(F.col("n") <= count).select("series_id", "pos", "t", "x")
    return sized.join(wanted, ["series_id", "pos"]).select("series_id", "pos", "t", "x").unionByName(few)


def decimate(samples: DataFrame, most: int = 60) -> DataFrame:
    """Every step-th row of each series, step = max(1, floor(n / most)), ``most`` rows at most, with the series' row count."""
    rn = F.row_number().over(Window.partitionBy("series_id").orderBy("t")) - 1
    sized = samples.withColumns({"pos": rn, "n": F.count(F.lit(1)).over(Window.partitionBy("series_id"))})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / float(most)).cast("int"))
    return sized.withColumn("step", step).where("pos % step = 0").where(F.col("pos") / F.col("step") < most).select("series_id", "t", "x", "n")


def colour_outliers(frames: DataFrame, most: int = 50) -> DataFrame:
    """(series_id, t, distance): frames (series_id, t, brightness, saturation, u, v) whose colour is far from their series' middle.

    Brightness and saturation are measured in MADs (1 at least) and joined as a length; hue, where every frame has chroma, along the
    shorter arc in MADs (0.02 at least). Over 1.8 in length or 2 in hue counts. Series of under eight frames have none; the ``most``
    farthest of a series stay, the earliest of equals.
    """
    valid = frames.where("saturation IS NOT NULL AND brightness IS NOT NULL").withColumn("hue", F.atan2("v", "u"))
    arc = lambda d: F.least(d, 2 * math.pi - d)
    away = {"saturation": F.abs(F.col("saturation") - F.col("mid_saturation")), "brightness": F.abs(F.col("brightness") - F.col("mid_brightness")), "hue": arc(F.abs(F.col("hue") - F.col("mid_hue")))}
    sizes = valid.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("hue").isNotNull()).alias("hued")).where("n >= 8")
    mids = sizes.join(upper_medians(valid, *away).select("series_id", *(F.col(c).alias(f"mid_{c}") for c in away)), "series_id")
    far = valid.join(mids, "series_id").withColumns({f"off_{c}": x for c, x in away.items()})
    floors = {"saturation": 1.0, "brightness": 1.0, "hue": 0.02}
    spread = upper_medians(far, *(f"off_{c}" for c in away)).select("series_id", *(F.greatest(f"off_{c}", F.lit(floors[c])).alias(f"mad_{c}") for c in away))
    part = lambda c: F.col(f"off_{c}") / F.col(f"mad_{c}")
    length = F.sqrt(part("saturation") * part("saturation") + part("brightness") * part("brightness"))
    turn = F.when(F.col("hued"), part("hue")).otherwise(0.0)
    found = far.join(spread, "series_id").withColumns({"length": length, "turn": turn}).where("length > 1.8D OR turn > 2.0D").withColumn("distance", rounded(F.greatest("length", "turn"), 1))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("distance"), "t"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("series_id", "t", "distance")


def merge_series(left: DataFrame, right: DataFrame, order: str = "arrival") -> DataFrame:
    """Two series (series_id, t, order, ...) side by side, rows of either kept; of a series' rows at one time the last by ``order`` counts, as a whole."""

    def last(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in ("series_id", "t", order)]
        return df.groupBy("series_id", "t").agg(F.max_by(F.struct(*rest), order).alias("v")).select("series_id", "t", "v.*")

    return last(left).join(last(right), ["series_id", "t"], "full")


def tail_median(samples: DataFrame, share: float = 0.8) -> DataFrame:
    """(series_id, n, med): upper median of what follows the first ``share`` of each series."""
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("t"))
    sized = samples.withColumns({"rn": number, "n": F.count(F.lit(1)).over(Window.partitionBy("series_id"))})
    tail = sized.where(F.col("rn") > F.floor(F.col("n") * share))
    return tail.groupBy("series_id").agg(F.first("n").alias("n")).join(upper_medians(tail, "x").withColumnRenamed("x", "med"), "series_id", "left")


def cached_lookup(targets: DataFrame, cached: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """For each (series_id, bucket, t) the cached frame (series_id, bucket, t, resolution, file) at that time, else the nearest within ``tolerance``;
    the highest resolution that has one wins, null where none has. ``bucket`` stands for format and crop: frames of another one never match.

    Frames lie in time slots of twice the tolerance; a target meets those that its range touches, two at most.
    """
    length = 2 * tolerance
    a = targets.select("series_id", "bucket", F.col("t"), intervals.slots(F.col("t") - tolerance, F.col("t") + tolerance, length).alias("slot_"))
    b = cached.select("series_id", "bucket", F.col("t").alias("found_t"), "resolution", "file", F.floor(F.col("t") / length).alias("slot_"))
    pairs = a.join(b, ["series_id", "bucket", "slot_"]).withColumn("off", F.abs(F.col("found_t") - F.col("t"))).where(F.col("off") <= tolerance)
    best = F.max_by(F.struct("found_t", "resolution", "file"), F.struct("resolution", -F.col("off"), -F.col("found_t")))
    found = pairs.groupBy("series_id", "bucket", "t").agg(best.alias("best"))
    return targets.select("series_id", "bucket", "t").distinct().join(found, ["series_id", "bucket", "t"], "left").select("series_id", "bucket", "t", "best.found_t", "best.resolution", "best.file")


def new_labels(arriving: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (series_id, label, arrival, ...) whose label their series does not have yet; of equals the first to arrive."""
    first = F.row_number().over(Window.partitionBy("series_id", "label").orderBy("arrival"))
    fresh = arriving.join(kept.select("series_id", "label"), ["series_id", "label"], "left_anti")
    return fresh.withColumn("nth", first).where("nth = 1").drop("nth")
