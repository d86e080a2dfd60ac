"""Plans and requests in words, and what is wrong with requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import labels, text
from tessella.sources.json_texts import MODES

_LABEL = r"^\d{2}:\d{2}:\d{2}(\.\d+)?$"
DEFAULT_CAP = 50000


def plan_summary(segments: DataFrame) -> DataFrame:
    """(series_id, summary): a line with the number of segments and frames, and one for each segment (series_id, start_s, end_s, fps, budget, kind,
    intensity) by start. A plan has as many segments as its budget at most, so its lines fit one row."""
    tag = F.when(F.col("kind") == "motion", F.concat(F.lit("motion (intensity="), F.coalesce(text.decimals(F.col("intensity"), 1), F.lit("?")), F.lit(")"))).when(F.col("kind") == "uniform", "uniform (fallback)").otherwise("static")
    line = F.concat(F.lit("  "), labels.precise_label(F.col("start_s")), F.lit("-"), labels.precise_label(F.col("end_s")), F.lit(" "), tag, F.lit(": "), F.col("budget").cast("string"), F.lit(" frames @ "), text.decimals(F.col("fps")), F.lit("fps"))
    sums = segments.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("budget").alias("frames"), F.array_sort(F.collect_list(F.struct("start_s", "end_s", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("segments="), F.col("n").cast("string"), F.lit(" total_frames="), F.col("frames").cast("string"))
    return sums.select("series_id", F.concat_ws("\n", head, F.array_join("lines.line", "\n")).alias("summary"))


# What is said of a decision, by whether it is on and where it came from.
NARRATIVE_SOURCES = {
    (True, "explicit"): "explicit (narrative_mode=true)",
    (True, "auto"): "auto-suggested (analyze data indicates high motion or dense scene cuts)",
    (True, "config"): "server default (configure.default_narrative_mode=true)",
    (False, "explicit"): "off (explicit narrative_mode=false)",
    (False, "default"): "off",
}
ADAPTIVE_SOURCES = {
    (True, "explicit"): "explicit",
    (True, "config"): "server default (configure.default_adaptive_sampling=true)",
    (False, "explicit"): "off (explicitly disabled)",
    (False, "default"): "off (no motion_windows or duration <= 4s)",
}


def provenance(decision: Column, said: dict[tuple[bool, str], str]) -> Column:
    """A decision STRUCT<on, source> in the words of one of the tables above."""
    return F.coalesce(*(F.when((decision["on"] == on) & (decision["source"] == source), F.lit(words)) for (on, source), words in said.items()))


def strong_outliers(outliers: DataFrame, limit: float = 25.0) -> DataFrame:
    """(series_id, n_strong) of outliers (series_id, distance): those farther than ``limit``; series without any outlier have no row."""
    return outliers.groupBy("series_id").agg(F.count_if(F.col("distance") > limit).alias("n_strong"))


def mean_loudness(rows: DataFrame) -> DataFrame:
    """(series_id, loudness) of (series_id, level): the mean of the levels that are numbers, null without one."""
    level = F.col("level")
    return rows.groupBy("series_id").agg(F.avg(F.when(~F.isnan(level) & (F.abs(level) < float("inf")), level)).alias("loudness"))


def expired_files(files: DataFrame, now: str, max_age_days: int = 7) -> DataFrame:
    """The files (series_id, changed timestamp, ...) last changed more than ``max_age_days`` before ``now``."""
    return files.where(F.col("changed") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(max_age_days)))


def output_cap(raw: Column) -> Column:
    """The token cap that a setting gives: its leading whole number, else, or where that is not above zero, the default."""
    n = F.try_element_at(F.regexp_extract_all(raw, F.lit(r"^\s*([+-]?\d+)"), F.lit(1)), F.lit(1)).try_cast("long")
    return F.when(n > 0, n).otherwise(DEFAULT_CAP)


def request_problems(requests: DataFrame) -> DataFrame:
    """(series_id, problem): each parameter of (series_id, mode, fps, resolution, start_time, end_time, view, roi), all texts, that is out of its range.

    Null means that a parameter is not given; 'NaN' and 'Infinity' are no numbers. fps is a number above zero or 'auto'; resolution lies in 128 to 2048; view is 1 at least.
    """
    number = lambda c: F.when(F.col(c).rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.col(c).try_cast("double"))
    tests = {
        "mode": ~F.col("mode").isin(*MODES),
        "fps": (F.col("fps") != "auto") & ~F.coalesce(number("fps") > 0, F.lit(False)),
        "resolution": ~F.coalesce(number("resolution").between(128, 2048), F.lit(False)),
        "start_time": ~F.col("start_time").rlike(_LABEL),
        "end_time": ~F.col("end_time").rlike(_LABEL),
        "view": ~F.coalesce(number("view") >= 1, F.lit(False)),
        "roi": ~F.col("roi").isin("auto", "per-window") & ~F.col("roi").rlike(r"^\d+,\d+,\d+,\d+$"),
    }
    found = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & test, F.lit(c)) for c, test in tests.items())))
    return requests.select("series_id", F.explode(found).alias("problem"))


def accepted_requests(requests: DataFrame) -> DataFrame:
    """The requests without a problem."""
    return requests.join(request_problems(requests).select("series_id").distinct(), "series_id", "left_anti")

