"""Views of the given tables in the shapes that the operators take."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t in days since the start of 2024, x): the events of each user as a series."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 86400000000.0D")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), t.alias("t"), F.col("value").alias("x"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, win_id, start_s, end_s, intensity): each event as an interval as long as its value says."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 86400000000.0D")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.col("event_id").alias("win_id"), t.alias("start_s"), (t + F.col("value") / 1000.0).alias("end_s"), F.col("value").alias("intensity"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, seq, text): the turns of each conversation."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("series_id"), F.col("turn").alias("seq"), "text")


def media_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, content): for each event a log text in the shapes that ``logs`` reads, its numbers taken from the event."""
    row = table(spark, sf_dir, "events").select(F.col("event_id").alias("series_id"), F.floor("value").alias("k"), (F.col("event_id") % 7).alias("j"))
    lines = (
        "lavfi.scd.score={k}.5 lavfi.scd.time={j}.25",
        "lavfi.scd.score={k+3}.5 lavfi.scd.time={j+2}.75",
        "black_start:{j} black_end:{j+2}.5 black_duration:2.5",
        "silence_start: {j}.5",
        "silence_end: {j+1}.75 | silence_duration: 1.25",
        "silence_start: {j+4}.125",
        "freeze_start: {j+1}",
        "freeze_duration: 2.5",
        "crop={k+100}:{j+200}:{j}:{k}",
        "crop={k+50}:{j+150}:{j+1}:{k}",
        "I: -{k}.5 LUFS",
        "LRA: {j}.5 LU",
        "# frame:0 pts_time:{j}.5",
        "lavfi.blur={k}.25",
        "lavfi.siti.si={k}.5",
        "lavfi.siti.ti={j}.5",
        "lavfi.scd.score={j}",
        "lavfi.signalstats.YAVG={k}",
        "lavfi.signalstats.UAVG={j+120}",
        "lavfi.signalstats.VAVG=125",
        "frame:1 pts_time:{j+1}.5",
        "lavfi.blur={k+1}.25",
        "lavfi.siti.si={k+1}.5",
        "lavfi.siti.ti={j+1}.5",
        "lavfi.signalstats.YAVG={k+1}",
    )
    parts = [F.expr(p) if i % 2 else F.lit(p) for i, p in enumerate(re.split(r"[{}]", "\n".join(lines)))]
    return row.select("series_id", F.concat(*parts).alias("content"))


def subtitle_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, content): two subtitle blocks for each event, and one without a text."""
    e = "CAST(event_id % 50 AS STRING)"
    pad = f"lpad({e}, 2, '0')"
    content = F.expr(
        f"concat('1\r\n00:', {pad}, ':01,500 --> 00:', {pad}, ':03,250\r\n<i>', event_type, '</i> &amp;lt;\r\n  ', {e}, '\r\n\r\n2\r\n', {pad}, ':05.000 --> ', {pad}, ':09.900\r\n&quot;', {e}, '&quot;\r\n\r\n3\r\n00:00:01,000 --> 00:00:02,000\r\n<b></b>')"
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("series_id"), content.alias("content"))


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, frame, x, y) on a grid of 160 x 90: each event lights one pixel of one of its user's 24 frames."""
    x, y = F.floor(F.col("value") / 8).cast("int") + 40, (F.col("event_id") % 30).cast("int") + 20
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), (F.col("event_id") % 24).cast("int").alias("frame"), x.alias("x"), y.alias("y")).distinct()


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, manifest): a session for each event, created at its time; some manifests are missing or broken."""
    text = F.expr("CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN concat('{', props) ELSE concat('{\"created_at\": \"', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '\"}') END")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("series_id"), text.alias("manifest"))
