"""JSON documents against closed schemas, as violation rows, and the reports that follow from them.

A schema is a table of (path, required, type, rule); ``[]`` in a path stands for the items of an array. Objects are closed: keys that the
table does not list are violations, but for objects of the type 'open'. Rules: ('length', n) and ('items', n) at least n; ('enum', values);
('pattern', expression); ('least', x); ('above', x); ('between', x, y).
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import documents

_TIERS = ("low", "mid", "high", "max")
_SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"

# The fields of a beat sheet.
BEAT_SHEET = (
    ("source", True, "object", None),
    ("source.path", True, "string", ("length", 1)),
    ("source.duration_seconds", True, "number", ("above", 0)),
    ("source.watched_at_tier", True, "string", ("enum", _TIERS)),
    ("source.has_audio", False, "boolean", None),
    ("source.original_fps", False, "number", ("above", 0)),
    ("source.resolution", False, "string", None),
    ("spine", True, "string", ("length", 1)),
    ("narrative_summary", True, "string", ("length", 1)),
    ("coverage", True, "object", None),
    ("coverage.tier", True, "string", ("enum", _TIERS)),
    ("coverage.chunk_count", True, "integer", ("least", 1)),
    ("coverage.chunk_duration_seconds", False, "number", ("above", 0)),
    ("coverage.segments_covered", True, "integer", ("least", 1)),
    ("coverage.subchunks_watched", True, "integer", ("least", 1)),
    ("palette_hex", False, "array", None),
    ("palette_hex[]", False, "string", ("pattern", "^#?[0-9a-fA-F]{3,8}$")),
    ("scene_cuts_seconds", False, "array", None),
    ("scene_cuts_seconds[]", False, "number", ("least", 0)),
    ("audio", False, "object", None),
    ("audio.has_speech", False, "boolean", None),
    ("audio.summary", False, "string", None),
    ("beats", True, "array", ("items", 1)),
    ("beats[]", False, "object", None),
    ("beats[].timestamp_seconds", True, "number", ("least", 0)),
    ("beats[].duration_seconds", True, "number", ("above", 0)),
    ("beats[].description", True, "string", ("length", 1)),
    ("beats[].energy", False, "string", None),
    ("beats[].effect_category_tags", False, "array", None),
    ("beats[].effect_category_tags[]", False, "string", ("enum", ("Camera", "Chat", "Data Viz", "Layer", "Motion", "Reveal", "Text", "UI"))),
    ("beats[].effect_ids", False, "array", None),
    ("beats[].effect_ids[]", False, "string", ("length", 1)),
    ("beats[].motion_notes", False, "string", None),
    ("beats[].text_on_screen", False, "string", None),
    ("beats[].segment_index", False, "integer", ("least", 0)),
    ("continuity_notes", False, "array", None),
    ("continuity_notes[]", False, "string", None),
)

# The fields of a design document.
DESIGN_LOCK = (
    ("lockVersion", True, "integer", ("enum", (1,))),
    ("meta", True, "object", None),
    ("meta.project", True, "string", ("pattern", _SLUG)),
    ("meta.title", True, "string", ("length", 1)),
    ("meta.tagline", False, "string", None),
    ("meta.targetDurationSeconds", True, "number", ("above", 0)),
    ("meta.stage", True, "object", None),
    ("meta.stage.width", True, "integer", ("above", 0)),
    ("meta.stage.height", True, "integer", ("above", 0)),
    ("meta.render", True, "object", None),
    ("meta.render.width", True, "integer", ("above", 0)),
    ("meta.render.height", True, "integer", ("above", 0)),
    ("meta.render.fps", True, "integer", ("enum", (24, 25, 30, 50, 60))),
    ("meta.render.output", False, "string", None),
    ("meta.lockedOn", False, "string", ("pattern", r"^\d{4}-\d{2}-\d{2}$")),
    ("meta.lockedWith", False, "string", None),
    ("palette", True, "object", None),
    ("palette.tokens", True, "array", ("items", 1)),
    ("palette.tokens[]", False, "object", None),
    ("palette.tokens[].token", True, "string", ("pattern", "^--[a-z0-9-]+$")),
    ("palette.tokens[].hex", True, "string", ("pattern", "^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")),
    ("palette.tokens[].use", True, "string", ("length", 1)),
    ("palette.shadow", False, "string", None),
    ("palette.bans", False, "array", None),
    ("palette.bans[]", False, "string", None),
    ("typography", True, "object", None),
    ("typography.roles", True, "array", ("items", 1)),
    ("typography.roles[]", False, "object", None),
    ("typography.roles[].role", True, "string", ("length", 1)),
    ("typography.roles[].family", True, "string", ("length", 1)),
    ("typography.roles[].weight", True, "string", ("length", 1)),
    ("typography.roles[].tracking", False, "string", None),
    ("typography.roles[].notes", False, "string", None),
    ("typography.banned", False, "array", None),
    ("typography.banned[]", False, "string", None),
    ("typography.fonts", False, "array", None),
    ("typography.fonts[]", False, "object", None),
    ("typography.fonts[].family", True, "string", None),
    ("typography.fonts[].source", True, "string", None),
    ("heroElements", False, "array", None),
    ("heroElements[]", False, "object", None),
    ("heroElements[].id", True, "string", ("pattern", _SLUG)),
    ("heroElements[].kind", True, "string", ("enum", ("svg", "sprite", "dom", "image"))),
    ("heroElements[].description", True, "string", None),
    ("heroElements[].svgPath", False, "string", None),
    ("heroElements[].viewBox", False, "string", None),
    ("heroElements[].css", False, "string", None),
    ("heroElements[].sizes", False, "array", None),
    ("heroElements[].sizes[]", False, "object", None),
    ("heroElements[].sizes[].context", True, "string", None),
    ("heroElements[].sizes[].width", True, "number", None),
    ("heroElements[].sizes[].height", True, "number", None),
    ("heroElements[].sizes[].notes", False, "string", None),
    ("texture", False, "object", None),
    ("texture.description", False, "string", None),
    ("texture.css", False, "string", None),
    ("texture.svg", False, "string", None),
    ("motion", True, "object", None),
    ("motion.eases", True, "array", ("items", 1)),
    ("motion.eases[]", False, "object", None),
    ("motion.eases[].use", True, "string", ("length", 1)),
    ("motion.eases[].ease", True, "string", ("length", 1)),
    ("motion.principles", True, "array", ("items", 1)),
    ("motion.principles[]", False, "string", ("length", 1)),
    ("motion.breatheSeconds", False, "number", None),
    ("audio", False, "object", None),
    ("audio.tracks", True, "array", None),
    ("audio.tracks[]", False, "object", None),
    ("audio.tracks[].role", True, "string", None),
    ("audio.tracks[].status", True, "string", ("enum", ("locked", "tbd", "none"))),
    ("audio.tracks[].asset", False, "string", None),
    ("audio.tracks[].volume", False, "number", ("between", 0, 1)),
    ("audio.tracks[].notes", False, "string", None),
    ("scenes", True, "array", ("items", 1)),
    ("scenes[]", False, "object", None),
    ("scenes[].id", True, "string", ("pattern", _SLUG)),
    ("scenes[].title", False, "string", None),
    ("scenes[].start", True, "number", ("least", 0)),
    ("scenes[].duration", True, "number", ("above", 0)),
    ("scenes[].energy", False, "string", None),
    ("scenes[].storyboard", True, "string", ("length", 1)),
    ("scenes[].content", False, "open", None),
    ("scenes[].effects", True, "array", None),
    ("scenes[].effects[]", False, "object", None),
    ("scenes[].effects[].ref", True, "string", ("length", 1)),
    ("scenes[].effects[].vars", False, "open", None),
    ("scenes[].effects[].role", False, "string", None),
    ("scenes[].effects[].notes", False, "string", None),
    ("scenes[].transitionOut", False, "string", None),
    ("scenes[].notes", False, "string", None),
    ("idioms", False, "array", None),
    ("idioms[]", False, "string", None),
    ("outOfScope", False, "array", None),
    ("outOfScope[]", False, "string", None),
    ("references", False, "array", None),
    ("references[]", False, "object", None),
    ("references[].label", True, "string", None),
    ("references[].path", False, "string", None),
    ("references[].url", False, "string", None),
    ("references[].notes", False, "string", None),
)
#: Violations that do not make a document invalid.
WARNINGS = ("tail_past_end", "late_first")

Schema = tuple[tuple, ...]


_LINE_END = "(?=(?:\\r\\n|[\\n\\r\\u0085\\u2028\\u2029])?\\Z)"


class _Node(NamedTuple):
    """A value's type and rule, the fields of an object and which it needs, and the items of an array."""

    kind: str
    rule: tuple | None
    fields: dict[str, _Node]
    needed: frozenset[str]
    item: _Node | None


def _node(schema: Schema, path: str, kind: str, rule: tuple | None) -> _Node:
    """The schema below ``path``, which ends with a dot for objects, as a tree."""
    if rule and rule[0] == "pattern":
        rule = ("pattern", re.compile(rule[1].removesuffix("$") + (_LINE_END if rule[1].endswith("$") else ""), re.ASCII))
    elif rule and rule[0] == "enum":
        rule = ("enum", frozenset(map(str, rule[1])))
    below = lambda name, k: f"{name}." if k == "object" else name
    own = [f for f in schema if kind == "object" and f[0].startswith(path) and f[0] != path and not {".", "["} & set(f[0][len(path) :])]
    item = next((f for f in schema if kind == "array" and f[0] == f"{path}[]"), None)
    fields = {name[len(path) :]: _node(schema, below(name, k), k, r) for name, _, k, r in own}
    needed = frozenset(name[len(path) :] for name, required, _, _ in own if required)
    return _Node(kind, rule, fields, needed, item and _node(schema, below(item[0], item[2]), *item[2:]))


def _pairs(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key occurs twice")
    return found


def _refuse(name: str):
    raise ValueError(name)


def _decimal(text: str) -> Decimal | float:
    return float(text) if "e" in text or "E" in text or sum(c.isdigit() for c in text) > 38 else Decimal(text)


_JSON = json.JSONDecoder(object_pairs_hook=_pairs, parse_constant=_refuse, parse_float=_decimal)


_TYPES = {"array": {list}, "object": {dict}, "open": {dict}, "string": {str}, "boolean": {bool}, "number": {int, float, Decimal}, "integer": {int, float, Decimal}}


def _breaks(v, rule: tuple) -> bool:
    name, *args = rule
    if name in ("items", "length"):
        return len(v) < args[0]
    if name == "enum":
        return (format(v.normalize(), "f") if isinstance(v, Decimal) else str(v)) not in args[0]
    if name == "pattern":
        return not args[0].search(v)
    number = float(v)
    return number < args[0] if name == "least" else number <= args[0] if name == "above" else not args[0] <= number <= args[1]


def _violations(v, node: _Node, shown: str, out: list[tuple[str, str]]) -> None:
    """Add (path, rule) for a value; ``shown`` is the path that is told."""
    kind, rule, fields, needed, item = node
    if type(v) not in _TYPES[kind] or kind == "integer" and float(v) % 1 != 0:
        out.append((shown, "type"))
        return
    if rule and _breaks(v, rule):
        out.append((shown, rule[0]))
    if kind == "object":
        at = f"{shown}." if shown else ""
        out.extend((at + name, "missing") for name in needed - v.keys())
        for name, x in v.items():
            if name in fields:
                _violations(x, fields[name], at + name, out)
            else:
                out.append((at + name.encode(errors="replace").decode(), "unknown"))
    elif item:
        for k, x in enumerate(v):
            _violations(x, item, f"{shown}[{k}]", out)


def _found(content: str | None, root: _Node) -> list[tuple[str, str]]:
    """(path, rule) for each violation of a text."""
    out: list[tuple[str, str]] = []
    try:
        value = _JSON.raw_decode(content, len(content) - len(content.lstrip(" \t\r\n")))[0] if content is not None else _refuse("null")
        _violations(value, root, "", out)
    except (ValueError, OverflowError, RecursionError):
        return [("", "unreadable")]
    return out


def _checked(docs: DataFrame, schema: Schema) -> DataFrame:
    """The documents with ``found``, an array of (path, rule); each is read once."""
    root, kept = _node(schema, "", "object", None), ["doc_id", "content"]

    def run(batches):
        for batch in batches:
            told = [_found(text, root) for text in batch.column("content").to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, told)]), pa.int32())
            paths, rules = (pa.array([x[k] for out in told for x in out], pa.string()) for k in (0, 1))
            found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([paths, rules], ["path", "rule"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], [*kept, "found"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept).mapInArrow(run, f"{kinds}, found array<struct<path:string,rule:string>>")


def _told(checked: DataFrame) -> DataFrame:
    return checked.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.path", "f.rule")


def conformance(docs: DataFrame, schema: Schema) -> DataFrame:
    """(doc_id, path, rule) for each violation of documents (doc_id, content); no JSON at all has the rule 'unreadable'. An object's keys that are
    null count as there, and of the wrong type."""
    return _told(_checked(docs, schema))


def _with_severity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("severity", F.when(F.col("rule").isin(*WARNINGS), "warning").otherwise("error"))


def beat_sheet_report(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(doc_id, path, rule, severity) of beat sheets (doc_id, content): schema violations, and for sheets without any, those of coverage and beats.

    catalog: (effect_id). Only late first beats and ends past the asset are warnings.
    """
    checked = _checked(docs, BEAT_SHEET)
    shape = _told(checked)
    doc = F.from_json(
        "content",
        "source STRUCT<duration_seconds: DOUBLE>, coverage STRUCT<chunk_count: BIGINT, segments_covered: BIGINT, subchunks_watched: BIGINT>, beats ARRAY<STRUCT<timestamp_seconds: DOUBLE, duration_seconds: DOUBLE, effect_ids: ARRAY<STRING>>>",
    )
    read = checked.where(F.size("found") == 0).select("doc_id", doc.alias("d"))
    sheets = read.select("doc_id", F.col("d.source.duration_seconds").alias("duration_s"), "d.coverage.*")
    rows = read.select("doc_id", F.posexplode_outer("d.beats").alias("pos", "b")).where("pos IS NOT NULL")  # a plain one would have texts read again by filters
    beats = rows.select("doc_id", "pos", F.col("b.timestamp_seconds").alias("at_s"), F.col("b.duration_seconds").alias("duration_s"), F.coalesce("b.effect_ids", F.array().cast("array<string>")).alias("effect_ids"))
    found = documents.beat_violations(beats, sheets, catalog)
    path = F.coalesce(F.concat(F.lit("beats["), F.col("pos").cast("string"), F.lit("]")), F.lit("coverage"))
    return _with_severity(shape.unionByName(found.select("doc_id", path.alias("path"), F.col("violation").alias("rule"))))


def lock_report(docs: DataFrame) -> DataFrame:
    """(doc_id, path, rule, severity) of design documents (doc_id, content): schema violations, and those of the timeline of scenes, which are
    looked for in every readable document."""
    shape = conformance(docs, DESIGN_LOCK)
    doc = F.from_json("content", "meta STRUCT<targetDurationSeconds: DOUBLE>, scenes ARRAY<STRUCT<id: STRING, start: DOUBLE, duration: DOUBLE, transitionOut: STRING>>")
    rows = docs.select("doc_id", doc.alias("d")).select("doc_id", F.col("d.meta.targetDurationSeconds").alias("target_s"), F.posexplode_outer("d.scenes").alias("pos", "s")).where("s IS NOT NULL")
    scenes = rows.select("doc_id", "pos", "s.id", F.col("s.start").alias("start_s"), F.col("s.duration").alias("duration_s"), F.col("s.transitionOut").alias("transition_out"), "target_s")
    path = F.coalesce(F.concat(F.lit("scenes["), F.col("pos").cast("string"), F.lit("]")), F.lit("scenes"))
    found = documents.scene_violations(scenes).select("doc_id", path.alias("path"), F.col("violation").alias("rule"))
    return _with_severity(shape.unionByName(found))


def statuses(docs: DataFrame, report: DataFrame) -> DataFrame:
    """(doc_id, status, n_errors, n_warnings): 0 for valid documents, 1 for invalid ones, 2 for those that cannot be read."""
    sums = report.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"), F.bool_or(F.col("rule") == "unreadable").alias("bad"))
    rows = docs.select("doc_id").join(sums, "doc_id", "left")
    status = F.when(F.coalesce("bad", F.lit(False)), 2).when(F.coalesce("e", F.lit(0)) > 0, 1).otherwise(0)
    return rows.select("doc_id", status.alias("status"), F.coalesce("e", F.lit(0)).alias("n_errors"), F.coalesce("w", F.lit(0)).alias("n_warnings"))
