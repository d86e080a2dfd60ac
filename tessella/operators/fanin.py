"""Results of parts brought together: chunks of sound, watched segments, their beats and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import labels, text

# Text in place of a chunk that could not be read, and the length in seconds beyond which sound is cut into chunks.
FAILED_CHUNK = "[transcription failed for this segment after retry]"
LONG_AUDIO_S = 1200.0


def chunk_results(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """(series_id, chunk, start_s, end_s, text, failed): what was read of each chunk (series_id, chunk, start_s, end_s).

    results: (series_id, chunk, ok, start_s, end_s, text), a row for each line read, or one with ok false. Lines are cut to their chunk, empty
    ones go. A chunk that failed, or has no result at all, has one row over its whole span.
    """
    c, r = chunks.alias("c"), results.alias("r")
    joined = c.join(r, ["series_id", "chunk"], "left")
    fine = F.coalesce(F.col("r.ok"), F.lit(False))
    start, end = F.greatest("r.start_s", "c.start_s"), F.least("r.end_s", "c.end_s")
    read = joined.where(fine).select("series_id", "chunk", start.alias("start_s"), end.alias("end_s"), "r.text", F.lit(False).alias("failed")).where("end_s > start_s")
    lost = joined.where(~fine).select("series_id", "chunk", F.col("c.start_s").alias("start_s"), F.col("c.end_s").alias("end_s"), F.lit(FAILED_CHUNK).alias("text"), F.lit(True).alias("failed")).distinct()
    return read.unionByName(lost)


# What a plan's warnings say.
PLAN_DETAILS = {"loose_threshold": "matched silence using loose threshold", "hard_cut": "no silence within ±30s of target boundary"}


def long_audio(assets: DataFrame, plan: DataFrame, answers: DataFrame) -> DataFrame:
    """(series_id, route, kind, chunk, total, start_s, end_s, value, event): all that is known of the sound of assets (series_id, duration_s, start_s, end_s), from route to rows.

    ``plan`` has the chunks (series_id, chunk, total, start_s, end_s, warning) of assets that are cut. ``answers`` (series_id, chunk, attempt, error, lines
    array<struct<start_s, end_s, text>>, tags array<struct<start_s, end_s, tag>>) has a row for each try, 0 first, with times from the begin of what was sent; what is
    sent at once, a slice or a whole asset, is chunk 0.

    kind is 'text', 'tag' or 'warning'. Lines and tags of chunks are moved to their chunk and cut to it, empty ones go. A first try that failed is a warning 'retry' with
    its error; a chunk whose second try failed too, or that has no answer, is a warning 'failed' and a text in place of its words. The plan's warnings are told
    too. What is sent at once is not tried again: its error is a warning 'failed', without a text. A series without an answer to what is sent at once has no row.
    """
    routed = assets.select("series_id", sliced_route(F.col("start_s"), F.col("end_s"), F.col("duration_s")).alias("route"))
    nothing = F.lit(None)
    whole = routed.where("route <> 'chunks'").select("series_id", "route", F.lit(0).alias("chunk"), nothing.cast("int").alias("total"), F.lit(0.0).alias("c0"), F.lit(float("inf")).alias("c1"), nothing.cast("string").alias("planned"))
    cut = routed.where("route = 'chunks'").join(plan, "series_id").select("series_id", "route", F.col("chunk").cast("int"), F.col("total").cast("int"), F.col("start_s").alias("c0"), F.col("end_s").alias("c1"), F.col("warning").alias("planned"))
    tries = answers.groupBy("series_id", F.col("chunk").cast("int").alias("chunk")).agg(*(F.max_by(F.struct("error", "lines", "tags"), F.when(F.col("attempt") == k, F.lit(1))).alias(f"try{k}") for k in (0, 1)))
    both = whole.join(tries, ["series_id", "chunk"]).unionByName(cut.join(tries, ["series_id", "chunk"], "left"))
    in_chunks = F.col("route") == "chunks"
    fine = lambda k: F.col(f"try{k}").isNotNull() & F.col(f"try{k}.error").isNull()
    best = F.when(fine(0), F.col("try0")).when(in_chunks & fine(1), F.col("try1"))
    row = lambda kind, start, end, value, event=nothing: F.struct(F.lit(kind).alias("kind"), start.cast("double").alias("start_s"), end.cast("double").alias("end_s"), value.cast("string").alias("value"), event.cast("string").alias("event"))
    empty = F.array().cast("array<struct<kind: string, start_s: double, end_s: double, value: string, event: string>>")

    def read(name: str, kind: str, said: str) -> Column:
        moved = F.transform(best[name], lambda x: row(kind, F.greatest(x["start_s"] + F.col("c0"), F.col("c0")), F.least(x["end_s"] + F.col("c0"), F.col("c1")), x[said]))
        return F.coalesce(F.filter(moved, lambda x: ~in_chunks | (x["end_s"] > x["start_s"])), empty)

    span = (F.col("c0"), F.when(in_chunks, F.col("c1")))
    warn = lambda event, detail: row("warning", *span, detail, event)
    lost = best.isNull()
    last_error = F.coalesce(F.when(in_chunks, F.col("try1.error")), F.when(~in_chunks | F.col("try1").isNull(), F.col("try0.error")), F.lit("no answer"))
    told = F.array_compact(
        F.array(
            F.when(F.col("planned").isNotNull(), warn(F.lit(None), F.coalesce(*(F.when(F.col("planned") == k, F.lit(v)) for k, v in PLAN_DETAILS.items()))).withField("event", F.col("planned"))),
            F.when(in_chunks & F.col("try0.error").isNotNull(), warn(F.lit("retry"), F.col("try0.error"))),
            F.when(lost, warn(F.lit("failed"), last_error)),
            F.when(lost & in_chunks, row("text", *span, F.lit(FAILED_CHUNK))),
        )
    )
    rows = both.select("series_id", "route", "chunk", "total", F.inline(F.concat(read("lines", "text", "text"), read("tags", "tag", "tag"), told)))
    return rows.select("series_id", "route", "kind", F.when(F.col("route") == "chunks", F.col("chunk")).alias("chunk"), "total", "start_s", "end_s", "value", "event")


def audio_route(asked: Column, has_audio: Column, refusal: Column, has_captions: Column, backend: Column, doubtful: Column) -> Column:
    """How the words of an asset are found: 'none', 'captions', the backend's name, or 'suppressed' where a local reading was doubted before."""
    local = F.when(F.coalesce(doubtful, F.lit(False)), "suppressed").otherwise("local")
    return F.when(~F.coalesce(asked, F.lit(True)) | ~F.coalesce(has_audio, F.lit(False)), "none").when(F.coalesce(has_captions, F.lit(False)) & refusal.isNull(), "captions").when(backend == "gemini-api", "gemini-api").when(backend == "local", local).otherwise("none")


def usable_backend(wanted: Column, has_key: Column, has_tool: Column) -> Column:
    """The backend that can run: the local one needs its tool, the remote one a key; each gives way to the other, the local one else to none."""
    first = F.when((wanted == "local") & ~has_tool, F.when(has_key, "gemini-api").otherwise("none")).otherwise(wanted)
    return F.when((first == "gemini-api") & ~has_key, "local").otherwise(first)


def sliced_route(start_s: Column, end_s: Column, duration_s: Column) -> Column:
    """'slice' where a range is asked for, 'whole' up to the length that is read at once, else 'chunks'."""
    return F.when(start_s.isNotNull() | end_s.isNotNull(), "slice").when(duration_s <= LONG_AUDIO_S, "whole").otherwise("chunks")


def coverage(rows: DataFrame) -> DataFrame:
    """(series_id, coverage_s): the latest end of (series_id, end label); labels of another form are passed over, none gives 0."""
    return rows.groupBy("series_id").agg(F.greatest(F.lit(0.0), F.coalesce(F.max(text.clock_seconds(F.col("end"))), F.lit(0.0))).alias("coverage_s"))


def merged_beats(segments: DataFrame) -> DataFrame:
    """(series_id, pos, segment, at_s, text): the beats of segments (series_id, segment, beats array<struct<at_s, text>>) by time, those at
    one time in the order of segments and beats."""
    rows = segments.select("series_id", "segment", F.posexplode("beats").alias("k", "b"))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy("b.at_s", "segment", "k"))
    return rows.select("series_id", place.alias("pos"), "segment", "b.at_s", "b.text")


def merged_palette(segments: DataFrame) -> DataFrame:
    """(series_id, pos, colour): the well-formed colours of segments (series_id, segment, palette array<string>), trimmed, each once, in the order in
    which they come first."""
    rows = segments.select("series_id", "segment", F.posexplode("palette").alias("k", "c")).where(labels.is_colour(F.col("c")))
    once = rows.groupBy("series_id", F.trim("c").alias("colour")).agg(F.min(F.struct("segment", "k")).alias("at"))
    return once.select("series_id", F.row_number().over(Window.partitionBy("series_id").orderBy("at")).alias("pos"), "colour")


def watched_parts(planned: DataFrame, returned: DataFrame) -> DataFrame:
    """(series_id, n_parts, n_watched, n_lost): parts of the planned segments (series_id, segment, n_parts), and those of segments that returned."""
    back = returned.select("series_id", "segment").distinct().withColumn("back", F.lit(True))
    rows = planned.join(back, ["series_id", "segment"], "left")
    watched = F.sum(F.when(F.col("back"), F.col("n_parts")).otherwise(0))
    return rows.groupBy("series_id").agg(F.sum("n_parts").alias("n_parts"), watched.alias("n_watched"), F.count_if(F.col("back").isNull()).alias("n_lost"))
