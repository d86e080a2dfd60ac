"""A cache of sampled frames, (series_id, resolution, label, file, ...): summaries, expiry, and a folder that it is kept in."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What tells frames apart, as far as a table has these columns; ``format`` and ``bucket`` (its crop) keep other pictures of one moment apart.
KEYS = ("series_id", "resolution", "format", "bucket", "label")
#: Folders by hash of the series, so that a batch is compared with the folders of its own series alone.
PARTS = 16


def summary(frames: DataFrame, shown: int = 50) -> DataFrame:
    """(series_id, resolution, frame_count, first_label, last_label, labels): labels in order, joined by commas, or null where there are
    more than ``shown``; then the first and the last are told instead. Only short lists are ever gathered."""
    sizes = frames.groupBy("series_id", "resolution").agg(F.count("label").alias("frame_count"), F.min("label").alias("first"), F.max("label").alias("last"))
    small = sizes.where(F.col("frame_count") <= shown).select("series_id", "resolution")
    listed = frames.join(small, ["series_id", "resolution"], "left_semi").groupBy("series_id", "resolution").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    many = F.col("frame_count") > shown
    return sizes.join(listed, ["series_id", "resolution"], "left").select(
        "series_id", "resolution", "frame_count", F.when(many, F.col("first")).alias("first_label"), F.when(many, F.col("last")).alias("last_label"), "labels"
    )


def expired(sessions: DataFrame, now: str, max_age_days: int = 7) -> DataFrame:
    """The rows of (series_id, manifest) that are to go: manifests created more than ``max_age_days`` before ``now``, and those that are no JSON.

    A session without a manifest (null), and one whose manifest has no readable time of creation, stay.
    """
    parsed = F.try_parse_json("manifest")
    created = F.try_to_timestamp(F.try_variant_get(parsed, "$.created_at", "string"))
    old = created < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max_age_days))
    return sessions.where(F.col("manifest").isNotNull() & (parsed.isNull() | F.coalesce(old, F.lit(False))))


def stored(frames: DataFrame, path: str) -> DataFrame:
    """What the folder holds; no rows, in the shape of ``frames``, where it does not exist yet."""
    try:
        return frames.sparkSession.read.schema(frames.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return frames.limit(0)


def insert_absent(frames: DataFrame, path: str, arrival: str = "arrival") -> None:
    """Append the frames whose key the folder lacks; of rows with one key the first by ``arrival`` is written.

    Files lie by resolution and by a hash of the series; only the hashes that the batch holds are read. A run that is repeated after a failure
    finds its own rows and writes only what is missing.
    """
    keys = [k for k in KEYS if k in frames.columns]
    parted = frames.withColumn("part", F.pmod(F.xxhash64("series_id"), F.lit(PARTS)).cast("int"))
    touched = [r.part for r in parted.select("part").distinct().collect()]  # PARTS numbers at most
    held = stored(parted, path).where(F.col("part").isin(touched)).select(*keys)
    first = Window.partitionBy(*keys).orderBy(arrival)
    new = parted.join(held, keys, "left_anti").withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")
    new.write.mode("append").partitionBy("resolution", "part").parquet(path)
