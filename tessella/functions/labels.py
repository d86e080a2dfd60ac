"""Time labels, crops, cache keys and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clock_label, clock_seconds

# Media types by file extension, and speech models by memory in GB (up to, model).
IMAGE_TYPES = {"png": "image/png", "webp": "image/webp"}
SOUND_TYPES = {"wav": "audio/wav", "mp3": "audio/mp3", "aac": "audio/aac", "flac": "audio/flac", "ogg": "audio/ogg", "aiff": "audio/aiff"}
SPEECH_MODELS = ((4, "tiny"), (8, "small"), (16, "large-v3-turbo"))
LARGEST_SPEECH_MODEL = "large-v3"
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("long").cast("string"), 2, "0")


def _seconds(ms: Column) -> Column:
    return F.concat(_two(F.floor(ms / 1000)), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def precise_label(seconds: Column) -> Column:
    """HH:MM:SS.fff, not below zero. Seconds are rounded within their minute and not carried, so 59.9996 gives 60.000."""
    s = F.greatest(F.lit(0.0), seconds)
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.concat_ws(":", _two(h), _two(m), _seconds(F.floor((s - h * 3600 - m * 60) * 1000 + 0.5)))


def carried_label(seconds: Column) -> Column:
    """HH:MM:SS.fff, not below zero, rounded to a whole millisecond before it is split."""
    ms = F.floor(F.greatest(F.lit(0.0), seconds) * 1000 + 0.5)
    return F.concat_ws(":", _two(F.floor(ms / 3600000)), _two(F.floor(ms / 60000) % 60), _seconds(ms % 60000))


def shifted_label(label: Column, offset: Column) -> Column:
    """The label moved by some seconds, in whole seconds; as it is where the offset is zero, null where it is no label."""
    return F.when(offset == 0, label).otherwise(clock_label(clock_seconds(label) + offset))


def padded_label(label: Column) -> Column:
    """Without a fraction, filled with zeros to eight characters; longer ones stay whole."""
    whole = F.regexp_replace(label, r"[.,]\d+$", "")
    return F.when(F.length(whole) < 8, F.lpad(whole, 8, "0")).otherwise(whole)


def crop_of(text: Column) -> Column:
    """STRUCT<x, y, w, h> of "x,y,w,h"; null for any other text."""
    found = F.regexp_extract_all(text, F.lit(r"^(\d+),(\d+),(\d+),(\d+)$"), F.lit(0))
    part = F.split(F.try_element_at(found, F.lit(1)), ",")
    return F.when(F.size(found) == 1, F.struct(*(part[k].cast("int").alias(name) for k, name in enumerate("xywh"))))


def crop_label(crop: Column) -> Column:
    return F.concat(crop["x"].cast("string"), F.lit(","), crop["y"].cast("string"), F.lit(","), crop["w"].cast("string"), F.lit("x"), crop["h"].cast("string"))


def crop_bucket(crop: Column) -> Column:
    """The part of a cache key that a crop gives; empty for the whole frame."""
    return F.coalesce(F.concat(F.lit("roi="), crop_label(crop)), F.lit(""))


def cache_key(resolution: Column, kind: Column, bucket: Column) -> Column:
    return F.concat_ws("/", resolution.cast("string"), kind, F.nullif(bucket, F.lit("")))


def cache_key_parts(key: Column) -> Column:
    """STRUCT<resolution, format, bucket> of a cache key; null where it has no second part or does not start with a number."""
    parts = F.split(key, "/")
    resolution = F.try_element_at(F.regexp_extract_all(parts[0], F.lit(r"^\s*([+-]?\d+)"), F.lit(1)), F.lit(1)).cast("int")
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.lit(1), F.size(parts))), "/")
    return F.when((F.size(parts) >= 2) & resolution.isNotNull(), F.struct(resolution.alias("resolution"), parts[1].alias("format"), rest.alias("bucket")))


def fingerprint(content: Column, size: Column, duration_s: Column, head: int = 256 * 1024) -> Column:
    """Twelve hexadecimal digits that tell files apart: of their first bytes, size and, where it is known, duration in milliseconds."""
    known = ~F.isnan(duration_s) & (F.abs(duration_s) < float("inf"))
    ms = F.when(known, F.floor(duration_s * 1000 + 0.5).cast("string")).otherwise("")
    body = F.concat(F.substring(content.cast("binary"), 1, head), size.cast("string").cast("binary"), F.coalesce(ms, F.lit("")).cast("binary"))
    return F.substring(F.sha2(body, 256), 1, 12)


def frame_file(label: Column, extension: Column) -> Column:
    return F.concat(F.replace(label, F.lit(":"), F.lit("-")), F.lit("."), extension)


def media_type(file: Column, types: dict[str, str], otherwise: str) -> Column:
    end = F.lower(F.element_at(F.split(file, r"\."), -1))
    return F.coalesce(*(F.when(end == k, F.lit(v)) for k, v in types.items()), F.lit(otherwise))


def speech_model(memory_gb: Column) -> Column:
    return F.coalesce(*(F.when(memory_gb < limit, F.lit(name)) for limit, name in SPEECH_MODELS), F.lit(LARGEST_SPEECH_MODEL))


def whole_fps(rate: Column) -> Column:
    """Frames a second, rounded, of "num/den"; a missing rate is 30/1, a missing or zero denominator 1."""
    part = F.split(F.coalesce(F.nullif(rate, F.lit("")), F.lit("30/1")), "/")
    den = F.coalesce(F.try_element_at(part, F.lit(2)).try_cast("double"), F.lit(0.0))
    return F.floor(part[0].try_cast("double") / F.when(den == 0, 1.0).otherwise(den) + 0.5)


def is_colour(text: Column) -> Column:
    """Is the trimmed text three to eight hexadecimal digits, with or without a number sign?"""
    return F.coalesce(F.trim(text).rlike("^#?[0-9a-fA-F]{3,8}$"), F.lit(False))


def is_video_host(url: Column) -> Column:
    """Is it a web address on one of the listed hosts?"""
    web = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
    return F.coalesce(web & F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*VIDEO_HOSTS), F.lit(False))


def stage_scale(width: Column, height: Column, stage_width: Column, stage_height: Column) -> Column:
    """The whole number by which a rendering enlarges its stage; null where the sides differ in it or it is none."""
    k = width / stage_width
    return F.when((k == height / stage_height) & (k == F.floor(k)) & (k >= 1), k.cast("int"))
