"""No leaf of an envelope gets lost in the flat tables."""

from __future__ import annotations

import datetime as dt
import json

from sparkyard.operators import shred
from sparkyard.plans import data_queries


def _levels(spark, x, *tables):
    rows = [(1, "c", json.dumps(x), dt.datetime(2031, 1, 1))]
    return shred.levels_for(spark.createDataFrame(rows, "record_id long, camera_id string, payload string, received_at timestamp"), *tables)


CONTEXT = {"camera_id": "k", "odd": 1}
TRACKED = {"track": {"id": 7, "trail": [[1, 2], None, [], "p", [3, None]], "odd": 2}}
ENVELOPE = {
    "mode": "temporal", "odd": 3,
    "request": {"context": CONTEXT, "odd": 4, "temporal_config": {"odd": 5}, "detections": ["car", TRACKED], "observations": [{"context": CONTEXT, "odd": 6, "detections": [{}, TRACKED]}, "seen"]},
    "expected": {"odd": 7, "observability": {"level": "LOW", "odd": 8}, "match": {"odd": 9, "missing": ["crane"]}, "temporal": {"odd": 10}},
}


def test_records(spark):
    r = shred.records(_levels(spark, ENVELOPE, "records")).first()
    assert (r["context_camera_id"], r["level"]) == ("k", "LOW")
    assert [json.loads(r[f"{c}extra"])["odd"] for c in ("", "request_", "context_", "temporal_config_", "expected_", "observability_", "match_", "temporal_")] == [3, 4, 1, 5, 7, 8, 9, 10]


def test_observations(spark):
    rows = sorted(shred.observations(_levels(spark, ENVELOPE, "observations")).collect(), key=lambda r: r["obs_no"])
    assert [(r["obs_no"], r["context_camera_id"], r["context_extra"], r["extra"]) for r in rows] == [(0, "k", '{"odd":1}', '{"odd":6}'), (1, None, None, None)]
    assert rows[1]["raw"] == "seen"
    one = shred.observations(_levels(spark, ENVELOPE | {"mode": "instant"}, "observations")).where("raw IS NULL").first()
    assert (one["context_camera_id"], one["context_extra"]) == ("k", '{"odd":1}')


def test_detections_and_trails(spark):
    d = {(r["obs_no"], r["item_no"], r["kind"]): (r["raw"] if r["kind"] == "string" else None, r["track_id"], r["track_extra"]) for r in shred.detections(_levels(spark, ENVELOPE, "detections")).collect()}
    assert d == {(0, 0, "string"): ("car", None, None), (0, 1, "object"): (None, "7", '{"odd":2}'), (0, 0, "object"): (None, None, None)}
    assert shred.detections(_levels(spark, ENVELOPE, "detections")).count() == 4
    got = sorted(((r["obs_no"], r["item_no"], r["point_no"], r["kind"], r["raw"], r["at"]) for r in shred.trails(_levels(spark, ENVELOPE, "trails")).collect()), key=str)
    trail = [(0, "array", "[1,2]", ["1", "2"]), (2, "array", "[]", []), (3, "string", "p", None), (4, "array", "[3,null]", ["3", None])]
    assert got == sorted([(0, 1, *p) for p in trail * 2], key=str)


def test_registered_with_every_column(spark, data):
    for t, leaves in [("records", shred.RECORD_LEAVES), ("observations", shred.OBSERVATION_LEAVES), ("detections", shred.DETECTION_LEAVES), ("requirements", shred.REQUIREMENT_LEAVES), ("trails", shred.TRAIL_LEAVES)]:
        df = data_queries.queries()[f"p3_{t}_whole"](spark, f"{data}/sf0.001")
        assert set(leaves) <= set(df.columns) and df.count() > 0
