"""States, evidence, phrases, the request contract and other checks on hand-built cases."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparkyard.operators import catalog, contract, detections, labels, pairs, rebalance, status, validate

ROWS = detections.requirement_rows(1, ["truck"], [(["excavator"], ["auger"])], ["drill"]) + detections.requirement_rows(2, conditionals=[("rain", ["roller", "loader"], "all", [], "additional")])


def _frames(spark, rows):
    rows = [(*r, None) if len(r) == 5 else r for r in rows]
    return spark.createDataFrame(rows, "frame_key int, profile_id int, active array<string>, accepted array<string>, verified array<string>, target_zone string")


def test_instant_status_and_evidence(spark):
    req = spark.createDataFrame(ROWS, detections.REQUIREMENTS)
    rows = [
        (1, 1, [], ["truck", "excavator"], ["truck", "excavator"]), (2, 1, [], ["excavator", "roller"], ["excavator"]), (3, 2, [], [], []), (4, 2, ["rain"], ["roller", "loader"], []), (5, None, [], ["truck"], []),
        (6, 1, [], ["truck", "excavator"], ["excavator"], "north"), (7, 2, ["rain", "snow"], [], []),
    ]
    f = _frames(spark, rows)
    results = detections.requirement_results(f, req)
    got = {r["frame_key"]: (r["status"], r["observability"], r["level"]) for r in status.instant_status(f, req, results).collect()}
    assert got == {1: ("UNCERTAIN", 0.5, "MEDIUM"), 2: ("WARNING", 0.5, "MEDIUM"), 3: ("NOT_MONITORABLE", 0.0, "NONE"), 4: ("OK", 1.0, "HIGH"), 5: ("UNKNOWN_WORK", 0.0, "NONE"), 6: ("UNCERTAIN", 0.5, "MEDIUM"), 7: ("WARNING", 1.0, "HIGH")}
    routed = spark.createDataFrame([(2, "low_confidence", "truck"), (2, "unknown_class", "ufo"), (2, "unknown_class", "arm"), (2, "unknown_class", "ufo"), (2, "zone_mismatch", "truck"), (2, "invalid", None), (5, "zone_mismatch", "truck")], "frame_key int, bucket string, class string")
    e = [(r["seq"], r["code"], r["severity"], r["requirement_id"], r["n"], r["classes"]) for r in status.evidence(f, req, results, routed).where("frame_key = 2").orderBy("seq").collect()]
    assert e == [
        (1, "MISSING_REQUIREMENT", "WARNING", "required:truck", None, None), (2, "UNVERIFIABLE_REQUIREMENT", "UNCERTAIN", "undetectable:0", None, None), (3, "LOW_CONFIDENCE_DETECTIONS", "INFO", None, 1, None),
        (4, "UNKNOWN_DETECTOR_CLASSES", "INFO", None, None, ["arm", "ufo"]), (5, "ZONE_MISMATCH", "INFO", None, 1, None), (6, "POSSIBLE_UNEXPECTED_EQUIPMENT", "INFO", None, None, ["roller"]),
    ]
    assert {r["frame_key"] for r in status.evidence(f, req, results, routed).collect()} == {1, 2, 6, 7}
    assert status.instant_status(f.limit(0), req, results.limit(0)).count() == 0


def _series(spark, states, buckets):
    at = lambda i: dt.datetime(2031, 1, 1, 0, i)
    instants = spark.createDataFrame([(s, at(i), x) for s, xs in states.items() for i, x in enumerate(xs)], "s string, ts timestamp, status string")
    results = spark.createDataFrame([(s, at(i), i, k, b) for s, ids in buckets.items() for k, bs in ids.items() for i, b in enumerate(bs)], "s string, ts timestamp, i int, id string, bucket string")
    sizes = instants.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    p = detections.persistence(results, sizes, ["s"])
    return status.series_status(instants, p, ["s"]), status.unresolved_frames(results, p, ["s"], "i")


def test_series_status(spark):
    m, u, ok = "missing", "uncertain", "satisfied"
    states = {"gone": ["WARNING"] * 4, "mixed": ["WARNING", "UNCERTAIN"] * 2, "few": ["WARNING"] * 2, "blind": ["WARNING"] * 3 + ["NOT_MONITORABLE"], "fine": ["WARNING", "OK", "OK", "OK"]}
    buckets = {"gone": {"b": [m, m, m, ok], "a": [m, m, m, m]}, "mixed": {"a": [m, u, m, u]}, "few": {"a": [m, m]}, "blind": {"a": [m, m, m, m]}, "fine": {"a": [m, ok, ok, ok]}}
    x, frames = _series(spark, states, buckets)
    got = {r["s"]: tuple(r)[2:] for r in x.collect()}
    assert got == {
        "gone": ("WARNING", "WARNING", "WARNING", ["a", "b"], [], 0), "mixed": ("UNCERTAIN", "UNCERTAIN", "UNCERTAIN", [], ["a"], 0), "few": ("WARNING", "INSUFFICIENT_DATA", "WARNING", [], [], 0),
        "blind": ("NOT_MONITORABLE", "NOT_MONITORABLE", "NOT_MONITORABLE", [], [], 0), "fine": ("OK", "OK", "OK", [], [], 1),
    }
    at = {(r["s"], r["id"]): (r["missing_in"], r["unresolved_in"]) for r in frames.collect()}
    assert at["gone", "b"] == ([0, 1, 2], [0, 1, 2]) and at["mixed", "a"] == ([0, 2], [0, 1, 2, 3]) and ("fine", "a") not in at


def test_phrases(spark):
    x = spark.createDataFrame([(["a", "", "b", None, "a", "c"], "hELLO wORLD", float("nan"), '{"b": true, "a": true, "c": false, "d": 1}'), (["x"], "я", 1.5, '["y", "x", null, "y"]'), ([], "", float("inf"), "null"), (["a", "b"], None, None, None)], "items array<string>, t string, n double, c string")
    r = x.select(status.enumeration(F.col("items")).alias("e"), status.capitalized(F.col("t")).alias("t"), status.finite(F.col("n")).alias("n"), status.condition_names(F.col("c")).alias("c"), F.transform("items", lambda i: status.display(i, {"a": "A"})).alias("d")).collect()
    assert [tuple(v) for v in r] == [("a, b и c", "Hello world", None, ["a", "b"], ["A", "", "b", None, "A", "c"]), ("x", "Я", 1.5, ["x", "y"], ["x"]), ("", "", None, [], []), ("a и b", None, None, [], ["A", "b"])]


def _codes(request, mode="instant", works=None):
    return contract.request_issues(json.dumps({"mode": mode, "request": request}), works)


GOOD = {"context": {"planned_work": "w", "timestamp": "2031-01-01T00:00:00Z", "camera_id": "c"}, "detections": [{"class": "truck", "confidence": 0.5, "bbox": [0, 0, 1, 1]}]}


def test_contract():
    assert _codes(GOOD) == [] and _codes(GOOD, works={"w": []}) == []
    assert contract.request_issues(None) is None and contract.request_issues("{") is None and contract.request_issues("null") is None
    bad = {"context": {"planned_work": " ", "timestamp": "2031-01-01", "camera_id": 5, "zone_id": None, "active_conditions": {"": True, "x": 1, "y": True}, "more": 1}, "detections": [3, {"class": "ufo", "confidence": 1.5, "bbox": [0, 0, "q", 1], "z": 1}, {"class": "truck", "confidence": True, "bbox": [5, 0, 1, 1]}, {"bbox": 3}]}
    assert set(_codes(bad)) == {
        ("request.context.more", "unknown_field"), ("request.context.planned_work", "invalid_string"), ("request.context.active_conditions", "invalid_condition_name"), ("request.context.active_conditions.x", "invalid_condition_state"),
        ("request.context.timestamp", "timezone_required"), ("request.context.camera_id", "invalid_string"), ("request.context.zone_id", "invalid_string"), ("request.detections[0]", "invalid_detection"), ("request.detections[1].z", "unknown_field"),
        ("request.detections[1].class", "unknown_detection_class"), ("request.detections[1].confidence", "invalid_confidence"), ("request.detections[1].bbox[2]", "invalid_number"), ("request.detections[2].confidence", "invalid_number"),
        ("request.detections[2].bbox", "invalid_bbox"), ("request.detections[3].class", "invalid_string"), ("request.detections[3].confidence", "invalid_number"), ("request.detections[3].bbox", "invalid_bbox"),
    }
    assert _codes(5) == [("request", "invalid_request")] == contract.request_issues("[1]") and ("request.context", "invalid_context") in _codes({"detections": []})
    assert ("request.context.timestamp", "invalid_timestamp") in _codes({"context": {**GOOD["context"], "timestamp": "noon"}})
    assert _codes({**GOOD, "context": {**GOOD["context"], "active_conditions": {"rain": True}}}, works={"w": ["snow"]}) == [("request.context.active_conditions.rain", "unknown_active_condition")]
    assert _codes(GOOD, works={}) == [("request.context.planned_work", "unknown_planned_work")]


def test_series_contract():
    again = {**GOOD, "context": {**GOOD["context"], "timestamp": "2031-01-01T03:00:00+03:00"}}  # the same instant
    later = {**GOOD, "context": {**GOOD["context"], "timestamp": "2031-01-01T00:00:01Z"}}
    other = {**later, "context": {**later["context"], "camera_id": "d"}}
    run = lambda obs, config=None: _codes({"observations": obs, **({"temporal_config": config} if config is not None else {})}, "temporal")
    assert run([GOOD, later], {"window_seconds": None, "min_observations": 1, "persistence_ratio": 1}) == []
    assert run([GOOD, again]) == [("request.observations", "duplicate_timestamps")] and run([GOOD, other]) == [("request.observations", "mixed_temporal_context")]
    assert run([]) == [("request.observations", "invalid_observations")] == run(None)
    assert set(run([GOOD], {"window_seconds": 0, "min_observations": 1.0, "persistence_ratio": 0, "x": 1})) == {("request.temporal_config.x", "unknown_field"), ("request.temporal_config.window_seconds", "invalid_window_seconds"), ("request.temporal_config.min_observations", "invalid_min_observations"), ("request.temporal_config.persistence_ratio", "invalid_persistence_ratio")}
    assert run([GOOD], 3) == [("request.temporal_config", "invalid_temporal_config")]


def test_contract_frames(spark):
    df = spark.createDataFrame([(1, json.dumps({"request": GOOD}), "z"), (2, "{", "z"), (3, None, "z"), (None, "5", "z")], "record_id long, payload string, path string")
    x = contract.issues(df, "payload", ["record_id"])
    assert [tuple(r) for r in x.collect()] == [(None, "request", "invalid_request")]
    assert {tuple(r) for r in contract.verdicts(x, df.where("record_id IS NOT NULL"), ["record_id"]).collect()} == {(1, 0, "", 200)}
    assert contract.issues(df.limit(0), "payload", ["record_id"]).count() == 0


def test_settings():
    assert validate.Settings().persistence_ratio == 0.75
    for bad in ({"min_confidence": 1.1}, {"window_seconds": 0}, {"min_observations": 0}, {"persistence_ratio": 0}, {"persistence_ratio": 1.01}):
        with pytest.raises(ValueError):
            validate.Settings(**bad)


def test_series_fields(spark):
    t = dt.datetime(2031, 1, 1)
    obs = spark.createDataFrame([("a", "c1", None, t), ("a", "c1", None, t), ("b", "c1", "z", None), ("b", None, "z", t)], "s string, camera string, zone string, ts timestamp")
    assert {tuple(r) for r in detections.stream_fields(obs, ["s"], ["camera", "zone"]).collect()} == {("a", True, True), ("b", False, True)}
    assert {tuple(r) for r in detections.series_keys(obs, ["s"], ["camera", "zone"]).collect()} == {("a", 1), ("b", 2)}
    assert {tuple(r) for r in validate.series_problems(obs, ["s"], "ts", most=1).collect()} == {("a", "too_many_frames", 2), ("a", "repeated_times", 2), ("b", "too_many_frames", 2), ("b", "some_times_missing", 2)}
    times = spark.range(3).select(detections.upload_times(F.lit(t), F.col("id")).alias("ts"), detections.upload_times(F.lit(None).cast("timestamp"), F.col("id")).alias("now")).collect()
    assert [r["ts"].second for r in times] == [0, 1, 2] and all(r["now"] for r in times)


def test_catalogue_checks(spark):
    works = spark.createDataFrame([("w1", 0, "A"), ("w2", 1, "A"), ("w3", 2, None), ("w4", 2, "C")], "work string, profile_id int, description string")
    ds = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (3, "C")], "profile_id int, description string")
    assert {tuple(r) for r in catalog.description_problems(works, ds).collect()} == {("description_of_other_profile", "A", 1), ("unknown_description", "", 1), ("repeated_description", "C", 2), ("description_without_work", "B", 0), ("description_without_work", "C", 0)}
    x = {"t": spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), "u": spark.createDataFrame([(2,), (3,), (None,)], "k int")}
    assert [tuple(r) for r in validate.shared_keys(x, "k").collect()] == [(2, "t;u")]
    n = spark.createDataFrame([("train", 5)], "split string, n long")
    assert {tuple(r) for r in validate.count_problems(n, {"train": 5, "val": 2}, "split", "n").collect()} == {("val", 2, 0)}
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n long")
    assert {tuple(r) for r in validate.stats_mismatch(a, a.where("k = 'x'"), ["k"], "n").collect()} == {("y", 2, 0)}


def test_boxes_and_edges(spark):
    b = spark.createDataFrame([(1, 1, "truck", 0.5, 0.5, 0.5, 0.5), (1, 2, "truck", 1.0, 0.5, 0.5, 0.5), (2, 1, "truck", 0.5, 0.5, 0.5, 0.5), (3, 1, "truck", 0.5, 0.5, 0.0, 0.5)], "image_id int, line_no int, class string, x double, y double, w double, h double")
    i = spark.createDataFrame([(1, 100, 200), (2, None, 10), (3, 10, 10)], "image_id int, width int, height int")
    assert [tuple(r)[1:] for r in labels.pixel_boxes(b, i).orderBy("ann_id").collect()] == [(1, "truck", 25.0, 50.0, 75.0, 150.0, 0.25), (2, "truck", 75.0, 50.0, 100.0, 150.0, 0.125)]
    raw = spark.createDataFrame([(1, "truck", 0.5, 0.5, 0.1, 0.1), (2, "crane", 0.5, 0.5, 0.1, 0.1), (3, "truck", 5.0, 0.5, 0.1, 0.1)], "image_id int, raw_label string, x double, y double, w double, h double")
    bad = spark.createDataFrame([(1,), (2,), (9,)], "image_id int")
    assert {tuple(r) for r in labels.exclusions(raw, invalid=bad).collect()} == {(1, "invalid_image"), (2, "ambiguous_label"), (3, "no_boxes"), (9, "invalid_image")}
    assert {tuple(r) for r in labels.exclusions(raw, keep_negatives=True).collect()} == {(2, "ambiguous_label")}
    p = spark.createDataFrame([("a", pairs.HIGH, True, 30), ("b", pairs.POSSIBLE, True, 31), ("c", pairs.NOT, True, 1), ("d", pairs.HIGH, False, 1), ("e", pairs.HIGH, None, None)], "a string, v string, same_filename_family boolean, frame_delta int")
    assert [r["a"] for r in pairs.sequence_edges(p, "v").collect()] == ["a"]
    g = spark.createDataFrame([("d1", "x"), ("d1", "y"), ("d2", "z"), ("d1", "x")], "source string, member string")
    im = spark.createDataFrame([("x", "d1"), ("z", "d1")], "image string, source string")
    assert {tuple(r) for r in rebalance.unresolved_members(g, im).collect()} == {("d1", "y", "missing"), ("d2", "z", "other_source")}
