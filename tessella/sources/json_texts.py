"""JSON texts as rows: media probes, source descriptions, recogniser answers, manifests, transcripts, catalogs.

A text that is no JSON, or a field of another type than expected, gives nulls or no rows as each function says; nothing fails a job.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import labels

_PROBE = "streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: INT, height: INT, r_frame_rate: STRING, duration: STRING>>, format STRUCT<duration: STRING, size: STRING>"
# Languages of captions in the order in which they are wanted, and the defaults of the configuration.
PREFERRED_CAPTIONS = ("en", "en-orig", "en-US", "en-GB")
MODES = ("low", "mid", "high", "max")


def probe_metadata(probes: DataFrame) -> DataFrame:
    """(series_id, duration_s, width, height, codec, fps, size_mb, has_audio) of (series_id, content).

    The first video stream tells; without one, sides are 0, the codec 'unknown', the rate 30. A duration is the container's, else
    the stream's, else 0.
    """
    p = F.from_json("content", _PROBE)
    of = lambda kind: F.filter(F.coalesce(p["streams"], F.array()), lambda s: s["codec_type"] == kind)
    rows = probes.select("series_id", p["format"].alias("f"), F.try_element_at(of("video"), F.lit(1)).alias("v"), (F.size(of("audio")) > 0).alias("has_audio"))
    filled = lambda *x: F.coalesce(*(F.nullif(c, F.lit("")) for c in x), F.lit("0")).try_cast("double")
    size = filled(F.col("f.size")) / (1024 * 1024)
    return rows.select(
        "series_id", filled(F.col("f.duration"), F.col("v.duration")).alias("duration_s"), F.coalesce("v.width", F.lit(0)).alias("width"), F.coalesce("v.height", F.lit(0)).alias("height"),
        F.coalesce(F.nullif(F.col("v.codec_name"), F.lit("")), F.lit("unknown")).alias("codec"), labels.whole_fps(F.col("v.r_frame_rate")).alias("fps"), (F.floor(size * 10 + 0.5) / 10).alias("size_mb"), "has_audio",
    )


def _typed(doc: Column, name: str, kind: str) -> Column:
    """A field as text where it has the type, else null."""
    value = F.try_variant_get(doc, f"$.{name}", "variant")
    types = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "FLOAT")}[kind]
    schema = F.schema_of_variant(value)
    fits = schema.isin(*types) | (schema.startswith("DECIMAL") if kind == "number" else F.lit(False))
    return F.when(fits, F.try_variant_get(doc, f"$.{name}", "string"))


def source_info(infos: DataFrame, longest: int = 4000, mark: str = "\n…[truncated]") -> DataFrame:
    """(series_id, type, title, uploader, upload_date, view_count, description) of (series_id, content); fields of a wrong type are null, long
    descriptions cut, a missing type is 'url'."""
    doc = F.try_parse_json("content")
    text = _typed(doc, "description", "string")
    cut = F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit(mark))).otherwise(text)
    return infos.select(
        "series_id", F.lower(F.coalesce(_typed(doc, "extractor", "string"), F.lit("url"))).alias("type"), *(_typed(doc, k, "string").alias(k) for k in ("title", "uploader", "upload_date")),
        _typed(doc, "view_count", "number").cast("double").alias("view_count"), cut.alias("description"),
    )


def caption_track(infos: DataFrame) -> DataFrame:
    """(series_id, source, language) of (series_id, content): a wanted language of the manual captions, any English one, then the same of the
    automatic ones; nulls where there is none."""

    def best(kind: str) -> Column:
        part = F.get_json_object("content", f"$.{kind}")
        there = lambda lang: ~F.coalesce(F.get_json_object(part, f"$['{lang}']"), F.lit("")).isin("", "0", "false")
        english = F.try_element_at(F.filter(F.coalesce(F.json_object_keys(part), F.array()), lambda k: k.startswith("en")), F.lit(1))
        return F.coalesce(*(F.when(there(lang), F.lit(lang)) for lang in PREFERRED_CAPTIONS), english)

    kinds = ("subtitles", "automatic_captions")
    found = infos.select("series_id", *(best(k).alias(k) for k in kinds))
    return found.select("series_id", F.coalesce(*(F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds)).alias("source"), F.coalesce(*kinds).alias("language"))


def speech_answer(answers: DataFrame) -> DataFrame:
    """(series_id, error, transcription, audio_tags) of (series_id, content): arrays of structs, empty where the answer lacks them; error
    is 'not json' or 'not an object', with empty arrays."""
    doc = F.try_parse_json("content")
    whole = F.from_json("content", "transcription ARRAY<STRUCT<start: STRING, end: STRING, text: STRING>>, audio_tags ARRAY<STRUCT<start: STRING, end: STRING, tag: STRING>>")
    error = F.when(doc.isNull(), "not json").when(~F.schema_of_variant(doc).startswith("OBJECT"), "not an object")
    part = lambda name: F.when(error.isNull(), whole[name])
    return answers.select("series_id", error.alias("error"), *(F.coalesce(part(k), F.array().cast(kind)).alias(k) for k, kind in (("transcription", "array<struct<start:string,end:string,text:string>>"), ("audio_tags", "array<struct<start:string,end:string,tag:string>>"))))


def last_model(transcripts: DataFrame) -> DataFrame:
    """(series_id, model): of the lines of (series_id, content) that are JSON with a text at message.model, the last one's; series without
    one have no row."""
    lines = transcripts.select("series_id", F.posexplode(F.split("content", "\n")).alias("at", "line")).where(F.col("line").contains('"model"'))
    found = lines.withColumn("model", _typed(F.try_parse_json("line"), "message.model", "string")).where("model <> ''")
    return found.groupBy("series_id").agg(F.max_by("model", "at").alias("model"))


def manifest_frames(manifests: DataFrame) -> DataFrame:
    """(series_id, resolution, format, bucket, label, file) of (series_id, manifest): each frame under each well-formed cache key."""
    doc = F.from_json("manifest", "resolutions MAP<STRING, STRUCT<frames: ARRAY<STRUCT<timestamp: STRING, file: STRING>>>>")
    keyed = manifests.select("series_id", F.explode(doc["resolutions"]).alias("key", "held")).withColumn("parts", labels.cache_key_parts(F.col("key"))).where("parts IS NOT NULL")
    rows = keyed.select("series_id", "parts.*", F.explode("held.frames").alias("frame"))
    return rows.select("series_id", "resolution", "format", "bucket", F.col("frame.timestamp").alias("label"), F.col("frame.file").alias("file"))


def repaired_summary(answers: DataFrame) -> DataFrame:
    """(series_id, summary, notes) of (series_id, summary, notes array): markup that leaked into the summary is cut off, and an array in it
    stands for empty notes."""
    leak = r"</(?:narrative_summary|continuity_notes)\b|<parameter\b"
    at = F.regexp_instr("summary", F.lit(leak))
    leaked = F.when(at > 0, F.substr("summary", at))
    array = F.from_json(F.nullif(F.regexp_extract(leaked, r"(?s)\[.*\]", 0), F.lit("")), "array<string>")
    own = F.coalesce("notes", F.array().cast("array<string>"))
    notes = F.when((F.size(own) == 0) & array.isNotNull(), array).otherwise(own)
    kept = F.when(at > 0, F.trim(F.substr("summary", F.lit(1), at - 1))).otherwise(F.coalesce("summary", F.lit("")))
    return answers.select("series_id", kept.alias("summary"), notes.alias("notes"))


def merged_variables(rows: DataFrame) -> DataFrame:
    """(series_id, variables map, speed) of (series_id, defaults, overrides), both JSON objects: an override stands for the default of its name.

    ``speed`` must be a number above zero; one that is not gives way to the default, and that to 1. Broken overrides change nothing.
    """
    read = lambda c: F.coalesce(F.from_json(c, "map<string, string>"), F.create_map().cast("map<string,string>"))
    number = lambda c: F.when(_typed(F.try_parse_json(c), "speed", "number").cast("double") > 0, _typed(F.try_parse_json(c), "speed", "number").cast("double"))
    merged = F.map_zip_with(read("overrides"), read("defaults"), lambda _, o, d: F.coalesce(o, d))
    speed = F.when(F.map_contains_key(merged, "speed"), F.coalesce(F.when(F.map_contains_key(read("overrides"), "speed"), number("overrides")), number("defaults"), F.lit(1.0)))
    return rows.select("series_id", merged.alias("variables"), speed.alias("speed"))


def effect_catalog(texts: DataFrame) -> DataFrame:
    """(series_id, pos, effect_id) of (series_id, content): the names in a JSON array, in its order."""
    return texts.select("series_id", F.posexplode(F.from_json("content", "array<string>")).alias("pos", "effect_id"))


def effect_meta(pages: DataFrame) -> DataFrame:
    """(series_id, effect_id, cat, scrubbable, variables map) of (series_id, content): the JSON in a page's script that is marked as an effect's
    description; nulls where there is none or it is broken."""
    body = F.regexp_extract("content", r"(?s)<script[^>]*\bdata-effect-meta\b[^>]*>(.*?)</script>", 1)
    meta = F.from_json(body, "id STRING, cat STRING, scrubbable BOOLEAN, variables MAP<STRING, STRING>")
    return pages.select("series_id", meta["id"].alias("effect_id"), meta["cat"].alias("cat"), meta["scrubbable"].alias("scrubbable"), meta["variables"].alias("variables"))


def configuration(rows: DataFrame, default_mode: str = "high") -> DataFrame:
    """(series_id, backend, default_mode, ignored) of (series_id, file, env_mode): defaults, then the file's JSON, then the environment.

    A broken file counts as empty; a mode that the environment gives must be known, or it is told in ``ignored`` and changes nothing.
    """
    doc = F.from_json("file", "backend STRING, default_mode STRING")
    known = F.col("env_mode").isin(*MODES)
    mode = F.when(known, F.col("env_mode")).otherwise(F.coalesce(doc["default_mode"], F.lit(default_mode)))
    return rows.select("series_id", F.coalesce(doc["backend"], F.lit("local")).alias("backend"), mode.alias("default_mode"), F.when((F.col("env_mode") != "") & ~known, F.col("env_mode")).alias("ignored"))


def as_documents(rows: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, document): all other columns of each row as one JSON object, nulls included."""
    rest = [c for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("document"))


def _write(frames: DataFrame, path: str) -> None:
    """A folder for each series; those of other series stay as they are."""
    rows = frames.repartition("series_id").sortWithinPartitions("series_id", "resolution", "label")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series_id").parquet(path)


def _first_of_label(frames: DataFrame, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("series_id", "resolution", "label").orderBy(*order))
    return frames.withColumn("_place", place).where("_place = 1").drop("_place")


def write_manifests(frames: DataFrame, path: str) -> None:
    """Replace the manifest of each series that ``frames`` (series_id, resolution, label, file, arrival) has; of rows with one label the last to arrive counts.

    Manifests of other series stay. Rows without a series are left out. Two writers at once must not have a series in common.
    """
    _write(_first_of_label(frames.where("series_id IS NOT NULL"), F.desc("arrival"), F.col("file")), path)


def read_manifests(like: DataFrame, path: str) -> DataFrame:
    """The manifests of a folder, in the shape of ``like``; no rows where it does not exist yet."""
    try:
        return like.sparkSession.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def _held_of(new: DataFrame, path: str, most: int = 1000) -> DataFrame:
    """The manifests of the series that ``new`` has. Up to ``most`` of them are named in the scan, which then lists and reads their folders only."""
    held, series = read_manifests(new, path), new.select("series_id").distinct()
    named = [r.series_id for r in series.limit(most + 1).collect()]
    return held.where(F.col("series_id").isin(named)) if len(named) <= most else held.join(series, "series_id", "left_semi").select(*new.columns)


def merge_manifests(frames: DataFrame, path: str) -> None:
    """Add frames (series_id, resolution, label, file, arrival) to the manifests of a folder: a label that a manifest has at a resolution keeps its frame, of new rows
    with one label the first to arrive is taken.

    Only the manifests of the batch's series are read and written again, so the work follows the batch. Repeating a batch changes nothing. Rows without a series are left out.
    """
    new = frames.where("series_id IS NOT NULL")
    both = _held_of(new, path).withColumn("_old", F.lit(0)).unionByName(new.withColumn("_old", F.lit(1)))
    _write(_first_of_label(both, F.col("_old"), F.col("arrival"), F.col("file")).drop("_old"), path)
