"""Text rules for transcripts, markup and time labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of phrases that speech recognition makes up on noise or music.
MADE_UP_PHRASES = (
    r"thank you( for watching| for listening|\.|$)",
    r"subtitles by",
    r"tanya cushman reviewer",
    r"teksting av",
    r"undertekster av",
    r"tradução[: ]",
    r"^\s*\(?(upbeat|gentle|calm|inspiring|dramatic|soft|sad|happy|cheerful)\s+(music|musik|piano|guitar|sound)\)?\s*$",
    r"^\s*\(?(applause|laughter|silence|music)\)?\s*$",
    r"^\s*\.+\s*$",
    r"^\s*you\s*\.?\s*$",
    r"^\s*woo!?\s*$",
    r"www\.[a-z]+\.(com|org|net)",
    r"^\s*terima\s*kasih",
    r"^\s*vielen\s*dank[\s.!?]*$",
    r"^\s*[¡!¿]*gracias[\s.!?]*$",
    r"^\s*merci[\s.!?]*$",
    r"^\s*grazie[\s.!?]*$",
    r"^\s*谢谢",
    r"^\s*好\s*$",
    r"^\s*走\s*$",
    r"^\s*(yes|no|i don'?t know)\.?\s*$",
    r"^\s*we'?ll be right back\.?\s*$",
    r"редактор субтитров",
    r"корректор",
    r"para pensar\.?\s*$",
)


def is_made_up(text: Column) -> Column:
    return text.rlike("(?iuU)(" + "|".join(MADE_UP_PHRASES) + ")")


def has_speech(segments: DataFrame) -> DataFrame:
    """(series_id, has_speech): three words of two letters and fifteen letters in all over a series' texts."""
    words, letters = F.regexp_count("text", F.lit("[A-Za-zÀ-ÿ]{2,}")), F.regexp_count("text", F.lit("[A-Za-zÀ-ÿ]"))
    return segments.groupBy("series_id").agg(((F.sum(words) >= 3) & (F.sum(letters) >= 15)).alias("has_speech"))


def transcript_verdict(segments: DataFrame) -> DataFrame:
    """(series_id, n, n_made_up, repeat_text, repeat_n, flagged): texts that repeat (three times or more, half of all rows; the first such
    text counts) or match made-up phrases (half of all rows)."""
    text = F.lower(F.trim("text"))
    counts = segments.groupBy("series_id", text.alias("norm")).agg(F.count(F.lit(1)).alias("c"), F.min("seq").alias("first"))
    repeated = counts.where("c >= 3").groupBy("series_id").agg(F.min_by("norm", "first").alias("repeat_text"), F.min_by("c", "first").alias("repeat_n"))
    hits = segments.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_made_up(F.col("text"))).alias("n_made_up"))
    half = lambda x: F.coalesce(F.col(x), F.lit(0)) * 2 >= F.col("n")
    flagged = (F.coalesce(F.col("repeat_n"), F.lit(0)) > 0) & half("repeat_n") | (F.col("n_made_up") > 0) & half("n_made_up")
    return hits.join(repeated, "series_id", "left").select("series_id", "n", "n_made_up", "repeat_text", "repeat_n", flagged.alias("flagged"))


def plain_text(markup: Column) -> Column:
    """Tags dropped, five character references decoded (&amp; first), white space collapsed."""
    out = F.regexp_replace(markup, "<[^>]+>", "")
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\x0B\f\r]+", " "))


def content_profile(si: Column, ti: Column) -> tuple[Column, Column]:
    """Levels of detail (limits 50 and 25) and of motion (30 and 10); null is unknown."""
    level = lambda x, high, mid: F.when(x.isNull(), "unknown").when(x > high, "high").when(x > mid, "moderate").otherwise("low")
    return level(si, 50, 25), level(ti, 30, 10)


def clock_label(seconds: Column) -> Column:
    """HH:MM:SS of seconds, rounded down, not below zero."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(s / 60) % 60), part(s % 60))


def clock_seconds(label: Column) -> Column:
    """Seconds of HH:MM:SS[.fff]; null where the label has another form."""
    part = lambda k: F.try_element_at(F.split(label, ":"), F.lit(k)).cast("double")
    return F.when(label.rlike(r"^\d{2}:\d{2}:\d{2}(\.\d+)?$"), part(1) * 3600 + part(2) * 60 + part(3))

# What a level of detail (high, moderate, low) and one of motion mean together.
PROFILE_MEANINGS = {
    ("high", "high"): "busy action scenes",
    ("high", "moderate"): "detailed moving shots",
    ("high", "low"): "detailed static shots",
    ("moderate", "high"): "action with mid-detail scenes",
    ("moderate", "moderate"): "typical narrative content",
    ("moderate", "low"): "static mid-detail shots",
    ("low", "high"): "simple fast-moving scenes or animations",
    ("low", "moderate"): "simple scenes with some movement",
    ("low", "low"): "simple static shots, slides, or graphics",
}


def profile_text(si: Column, ti: Column) -> Column:
    """The two levels in words, with their meaning where both are known."""
    detail, motion = content_profile(si, ti)
    meaning = F.coalesce(*(F.when((detail == d) & (motion == m), F.lit(f" ({text})")) for (d, m), text in PROFILE_MEANINGS.items()), F.lit(""))
    told = F.concat(detail, F.lit(" visual complexity, "), motion, F.lit(" motion"), meaning)
    return F.when(si.isNull() & ti.isNull(), "unknown (no motion analysis data)").otherwise(told)


def decimals(x: Column, digits: int = 2) -> Column:
    """A number of no less than zero with so many decimals, rounded half up."""
    scale = 10**digits
    n = F.floor(x * scale + 0.5).cast("long")
    return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def noise(seed: Column) -> Column:
    """A number from 0 to 1 that looks random and depends on the seed alone."""
    x = F.sin(seed * 99.13 + 4.7) * 43758.5453
    return x - F.floor(x)
