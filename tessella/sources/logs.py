"""Log and subtitle texts as rows.

Each parser takes (series_id, content), one text a row, and works within the row: nothing is shuffled, except by
``scene_scores_by_line``, which carries times from line to line. A null or unparsable text gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import plain_text

_FRAME = r"(?:^|\n)#?\s*frame:"


def _number(text: Column) -> Column:
    """The leading number of a run of digits and points; null where there is none."""
    return F.regexp_extract(text, r"^-?\d*\.?\d*", 0).try_cast("double")


def _numbers(pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all("content", F.lit(pattern), group), _number)


def _first(text: str, pattern: str) -> Column:
    return _number(F.regexp_extract(text, pattern, 1))


def _zipped(logs: DataFrame, **arrays: Column) -> DataFrame:
    """One row for each position of the arrays; shorter ones are filled with nulls."""
    return logs.select("series_id", *(a.alias(k) for k, a in arrays.items())).select("series_id", F.inline(F.arrays_zip(*arrays)))


def scene_scores(logs: DataFrame) -> DataFrame:
    """(series_id, t, score) of lines that hold a score and its time."""
    pattern = r"lavfi\.scd\.score=([\d.]+)\s+lavfi\.scd\.time=([\d.]+)"
    return _zipped(logs, t=_numbers(pattern, 2), score=_numbers(pattern, 1))


def scene_scores_by_line(logs: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(series_id, t, score): scores of at least ``threshold``, each at the time last named on its line or above. One log for each series."""
    lines = logs.select("series_id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    read = lines.select("series_id", "line", _first("text", r"pts_time:([\d.]+)").alias("pts"), _first("text", r"lavfi\.scd\.score=([\d.]+)").alias("score"))
    before = Window.partitionBy("series_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    timed = read.where("pts IS NOT NULL OR score IS NOT NULL").withColumn("t", F.last("pts", ignorenulls=True).over(before))
    return timed.where(F.col("t").isNotNull() & (F.col("score") >= threshold)).select("series_id", "t", "score")


def black_spans(logs: DataFrame) -> DataFrame:
    """(series_id, start_s, end_s, duration_s) of black stretches."""
    pattern = r"black_start:([\d.]+)\s+black_end:([\d.]+)\s+black_duration:([\d.]+)"
    return _zipped(logs, start_s=_numbers(pattern, 1), end_s=_numbers(pattern, 2), duration_s=_numbers(pattern, 3))


def silence_spans(logs: DataFrame) -> DataFrame:
    """(series_id, start_s, end_s, duration_s): starts and ends by position; a start without an end has no length."""
    ends = r"silence_end:\s*([\d.]+)\s*\|\s*silence_duration:\s*([\d.]+)"
    rows = _zipped(logs, start_s=_numbers(r"silence_start:\s*([\d.]+)"), till=_numbers(ends, 1), lasted=_numbers(ends, 2)).where("start_s IS NOT NULL")
    return rows.select("series_id", "start_s", F.coalesce("till", "start_s").alias("end_s"), F.coalesce("lasted", F.lit(0.0)).alias("duration_s"))


def freeze_spans(logs: DataFrame) -> DataFrame:
    """(series_id, start_s, end_s, duration_s): a missing end is start plus duration, a missing duration is zero."""
    parts = {k: _numbers(rf"freeze_{name}:\s*([\d.]+)") for k, name in (("start_s", "start"), ("till", "end"), ("lasted", "duration"))}
    lasted = F.coalesce("lasted", F.lit(0.0))
    return _zipped(logs, **parts).where("start_s IS NOT NULL").select("series_id", "start_s", F.coalesce("till", F.col("start_s") + lasted).alias("end_s"), lasted.alias("duration_s"))


def motion_means(logs: DataFrame) -> DataFrame:
    """(series_id, si, ti): those of the summary if it names either, else means over the frames; null where nothing is named."""
    summary = {k: _first("content", rf"{name} Information:\s*\n\s*Average:\s*([\d.]+)") for k, name in (("s", "Spatial"), ("t", "Temporal"))}
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(x), F.lit(0))
    read = logs.select("series_id", summary["s"].alias("s"), summary["t"].alias("t"), _numbers(r"lavfi\.siti\.si=([\d.]+)").alias("ss"), _numbers(r"lavfi\.siti\.ti=([\d.]+)").alias("ts"))
    summed = F.col("s").isNotNull() | F.col("t").isNotNull()
    return read.select("series_id", F.when(summed, F.col("s")).otherwise(mean(F.col("ss"))).alias("si"), F.when(summed, F.col("t")).otherwise(mean(F.col("ts"))).alias("ti"))


def _frames(logs: DataFrame) -> DataFrame:
    blocks = F.split("content", _FRAME)
    return logs.select("series_id", F.explode(F.slice(blocks, F.lit(2), F.size(blocks))).alias("block")).withColumn("t", _first("block", r"pts_time:([\d.]+)")).where("t IS NOT NULL")


def frame_blur(logs: DataFrame) -> DataFrame:
    """(series_id, t, blur) of frames that name both."""
    return _frames(logs).select("series_id", "t", _first("block", r"lavfi\.blur=([\d.]+)").alias("blur")).where("blur IS NOT NULL")


def frame_colours(logs: DataFrame) -> DataFrame:
    """(series_id, t, brightness, u, v, saturation): chroma around zero, saturation its length; null without both chroma values."""
    named = {k: _first("block", rf"lavfi\.signalstats\.{k}AVG=([\d.]+)") for k in "YUV"}
    both = named["U"].isNotNull() & named["V"].isNotNull()
    rows = _frames(logs).select("series_id", "t", named["Y"].alias("brightness"), F.when(both, named["U"] - 128).alias("u"), F.when(both, named["V"] - 128).alias("v"))
    return rows.withColumn("saturation", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))


def loudness(logs: DataFrame) -> DataFrame:
    """(series_id, mean_lufs, range_lu) of texts that name both."""
    rows = logs.select("series_id", _first("content", r"(?i)I:\s*([-\d.]+)\s*LUFS").alias("mean_lufs"), _first("content", r"(?i)LRA:\s*([\d.]+)\s*LU").alias("range_lu"))
    return rows.where("mean_lufs IS NOT NULL AND range_lu IS NOT NULL")


def crop_box(logs: DataFrame, frame_w: int, frame_h: int, nearly: float = 0.95, least: int = 20) -> DataFrame:
    """(series_id, x, y, w, h, area_pct): upper medians of the last fifth of all crops; none where they are nearly the frame or tiny."""
    pattern = r"crop=(\d+):(\d+):(\d+):(\d+)"
    names = ("w", "h", "x", "y")
    read = logs.select("series_id", *(F.regexp_extract_all("content", F.lit(pattern), k + 1).cast("array<int>").alias(n) for k, n in enumerate(names)))
    first = F.floor(F.size("w") * 0.8).cast("int") + 1
    tail = lambda n: F.sort_array(F.slice(n, first, F.size(n)))
    middle = [F.get(tail(n), F.floor(F.size(tail(n)) / 2).cast("int")).alias(n) for n in names]
    boxes = read.where(F.size("w") > 0).select("series_id", *middle)
    kept = boxes.where(~((F.col("w") >= frame_w * nearly) & (F.col("h") >= frame_h * nearly)) & (F.col("w") >= least) & (F.col("h") >= least))
    return kept.select("series_id", "x", "y", "w", "h", (F.floor(F.col("w") * F.col("h") / float(frame_w * frame_h) * 1000 + 0.5) / 10.0).alias("area_pct"))


def _subtitle_seconds(label: Column) -> Column:
    """Seconds of [HH:]MM:SS,mmm, rounded down; zero for any other form."""
    pattern = r"(?:(\d+):)?(\d{2}):(\d{2})[,.](\d{3})"
    h, m, s = (F.coalesce(F.regexp_extract(label, pattern, k).try_cast("double"), F.lit(0.0)) for k in (1, 2, 3))
    return h * 3600 + m * 60 + s


def subtitles(logs: DataFrame) -> DataFrame:
    """(series_id, seq, start_s, end_s, text) of blocks with a time line; markup is dropped, empty texts go."""
    blocks = logs.select("series_id", F.posexplode(F.split(F.regexp_replace("content", "\r", ""), r"\n{2,}")).alias("seq", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    placed = blocks.select("series_id", "seq", lines.alias("lines")).withColumn("at", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True).cast("int")).where("at > 0")
    times = F.split(F.get("lines", F.col("at") - 1), "-->")
    rows = placed.select("series_id", "seq", F.trim(F.get(times, 0)).alias("a"), F.trim(F.get(times, 1)).alias("b"), plain_text(F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), " ")).alias("text"))
    return rows.where("a <> '' AND b <> '' AND text <> ''").select("series_id", "seq", _subtitle_seconds(F.col("a")).alias("start_s"), _subtitle_seconds(F.col("b")).alias("end_s"), "text")


_SEGMENTS = "ARRAY<STRUCT<start: DOUBLE, `end`: DOUBLE, `from`: DOUBLE, `to`: DOUBLE, text: STRING>>"


def speech_segments(logs: DataFrame) -> DataFrame:
    """(series_id, seq, start_s, end_s, text) of a recogniser's output: its JSON, else its time-stamped lines, else the whole text at zero."""
    read = F.from_json("content", f"segments {_SEGMENTS}, transcription {_SEGMENTS}")
    row = lambda a, b, text: F.struct(a.cast("double").alias("start_s"), b.cast("double").alias("end_s"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))
    from_json = F.transform(
        F.coalesce(read["segments"], read["transcription"], F.from_json(F.lit("[]"), _SEGMENTS)),
        lambda x: row(F.floor(F.coalesce(x["start"], x["from"], F.lit(0.0))), F.floor(F.coalesce(x["end"], x["to"], F.lit(0.0))), F.coalesce(x["text"], F.lit(""))),
    )
    stamped = r"^\[([\d:.]+)\s*-->\s*([\d:.]+)\]\s*(.*)"
    seconds = lambda x: F.aggregate(F.split(F.regexp_replace(x, r"\.\d+$", ""), ":"), F.lit(0.0), lambda a, b: a * 60 + F.coalesce(b.try_cast("double"), F.lit(0.0)))
    lines = F.transform(F.filter(F.split("content", "\n"), lambda x: x.rlike(stamped)), lambda x: row(seconds(F.regexp_extract(x, stamped, 1)), seconds(F.regexp_extract(x, stamped, 2)), F.regexp_extract(x, stamped, 3)))
    whole = F.filter(F.array(row(F.lit(0), F.lit(0), F.col("content"))), lambda x: x["text"] != "")
    rows = F.when(F.try_parse_json("content").isNotNull(), from_json).when(F.size(lines) > 0, lines).otherwise(whole)
    return logs.where("content IS NOT NULL").select("series_id", F.posexplode(rows).alias("seq", "r")).select("series_id", "seq", "r.start_s", "r.end_s", "r.text")
