"""Documents against schemas: one document for each rule, and a plain reading of the same table."""

import copy
import json

from tessella.operators import schemas

SHEET = {
    "source": {"path": "a.mp4", "duration_seconds": 20, "watched_at_tier": "high"},
    "spine": "s",
    "narrative_summary": "n",
    "coverage": {"tier": "high", "chunk_count": 3, "segments_covered": 1, "subchunks_watched": 3},
    "palette_hex": ["#fff", "00aa11"],
    "beats": [{"timestamp_seconds": 0, "duration_seconds": 2.5, "description": "d", "effect_ids": ["fade"], "effect_category_tags": ["Text"]}, {"timestamp_seconds": 3, "duration_seconds": 1, "description": "e"}],
}


def changed(*path, to="drop"):
    doc = copy.deepcopy(SHEET)
    at = doc
    for k in path[:-1]:
        at = at[k]
    if to == "drop":
        del at[path[-1]]
    else:
        at[path[-1]] = to
    return json.dumps(doc)


CASES = [
    (json.dumps(SHEET), []),
    ("{oops", [("", "unreadable")]),
    (None, [("", "unreadable")]),
    ("[1]", [("", "type")]),
    (changed("spine"), [("spine", "missing")]),
    (changed("spine", to=""), [("spine", "length")]),
    (changed("spine", to=5), [("spine", "type")]),
    (changed("extra", to=1), [("extra", "unknown")]),
    (changed("source", "tier", to="x"), [("source.tier", "unknown")]),
    (changed("source", "watched_at_tier", to="best"), [("source.watched_at_tier", "enum")]),
    (changed("source", "duration_seconds", to=0), [("source.duration_seconds", "above")]),
    (changed("coverage", "chunk_count", to=1.5), [("coverage.chunk_count", "type")]),
    (changed("coverage", "chunk_count", to=0), [("coverage.chunk_count", "least")]),
    (changed("coverage", to=[]), [("coverage", "type")]),
    (changed("palette_hex", to=["cream", "#12", 7]), [("palette_hex[0]", "pattern"), ("palette_hex[1]", "pattern"), ("palette_hex[2]", "type")]),
    (changed("beats", to=[]), [("beats", "items")]),
    (changed("beats", 1, "description"), [("beats[1].description", "missing")]),
    (changed("beats", 0, "effect_ids", to=["", "b"]), [("beats[0].effect_ids[0]", "length")]),
    (changed("beats", 1, "colour", to=None), [("beats[1].colour", "unknown")]),
    (changed("beats", 1, to="text"), [("beats[1]", "type")]),
    (changed("spine", to=None), [("spine", "type")]),
]


def test_conformance(spark):
    docs = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(CASES)], "doc_id INT, content STRING")
    got = {}
    for r in schemas.conformance(docs, schemas.BEAT_SHEET).collect():
        got.setdefault(r.doc_id, []).append((r.path, r.rule))
    for k, (_, want) in enumerate(CASES):
        assert sorted(got.get(k, [])) == sorted(want), CASES[k]


def test_reports_and_statuses(spark):
    late = changed("beats", 0, "timestamp_seconds", to=2)
    lost = changed("coverage", "subchunks_watched", to=2)
    docs = spark.createDataFrame([(0, json.dumps(SHEET)), (1, late), (2, lost), (3, "{"), (4, changed("spine"))], "doc_id INT, content STRING")
    catalog = spark.createDataFrame([("fade",)], "effect_id STRING")
    report = schemas.beat_sheet_report(docs, catalog)
    assert sorted(map(tuple, report.collect())) == [(1, "beats[0]", "late_first", "warning"), (2, "coverage", "unwatched", "error"), (3, "", "unreadable", "error"), (4, "spine", "missing", "error")]
    assert {r.doc_id: (r.status, r.n_errors, r.n_warnings) for r in schemas.statuses(docs, report).collect()} == {0: (0, 0, 0), 1: (0, 0, 1), 2: (1, 1, 0), 3: (2, 1, 0), 4: (1, 1, 0)}
    none = schemas.beat_sheet_report(docs, catalog.where("false")).where("rule = 'unknown_effect'").collect()
    assert [r.doc_id for r in none] == [0, 1, 2]


def test_texts_are_read_once(spark):
    """Before, a filter that Spark infers from the explosion read a text again for each field of the schema."""
    docs = spark.createDataFrame([(0, json.dumps(SHEET)), (1, json.dumps(SHEET) + " x"), (2, json.dumps(SHEET).replace('"spine"', '"spine": "a", "spine"'))], "doc_id INT, content STRING")
    rows = schemas.conformance(docs, schemas.DESIGN_LOCK)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("MapInArrow") == 1
    assert [tuple(r) for r in schemas.conformance(docs, schemas.BEAT_SHEET).collect()] == [(2, "", "unreadable")]
