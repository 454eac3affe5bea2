"""Snapshots and nested records on small, dirty cases."""

from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from sparkyard.functions import text
from sparkyard.operators import shred, snapshot_diff

MOVE = "snapshot_date date, source string, group_id string, from_split string, to_split string, old_image string, new_image string, old_label string, new_label string, image_sha256 string, label_sha256 string, delivered_at timestamp, extra string"


def _move(day, image, **kw):
    t = dt.datetime(2031, 1, day, kw.pop("hour", 1))
    row = {"group_id": "g", "from_split": "train", "to_split": "val", "old_image": f"a/b/{image}" if image else image, "new_image": "n", "old_label": "o", "new_label": "l", "image_sha256": "AB", "label_sha256": "cd"} | kw
    return (dt.date(2031, 1, day), "d1", *(row[c] for c in ("group_id", "from_split", "to_split", "old_image", "new_image", "old_label", "new_label", "image_sha256", "label_sha256")), t, "x")


def test_snapshot_changes(spark):
    rows = [
        _move(1, "same"), _move(2, "same", group_id=" g\t", to_split="VALID", old_image="a\\b\\same ", image_sha256=" ab"), _move(2, "same", hour=0, group_id="old"),
        _move(1, "gone"), _move(2, "new"), _move(1, "new_hash"), _move(2, "new_hash", label_sha256=None), _move(1, "blank", group_id=None), _move(2, "blank", group_id=" "),
        _move(1, None), _move(2, ""), _move(4, "same"), _move(4, "gone"), _move(1, "gone"),
    ]
    df = spark.createDataFrame(rows, MOVE)
    got = sorted(tuple(r) for r in snapshot_diff.planned_move_changes(df).collect())
    assert got == sorted(
        [
            ("2031-01-02", "gone", "removed"), ("2031-01-02", "new", "added"), ("2031-01-02", "new_hash", "changed"),
            ("2031-01-04", "gone", "added"), ("2031-01-04", "new", "removed"), ("2031-01-04", "new_hash", "removed"), ("2031-01-04", "blank", "removed"),
        ]
    )
    assert snapshot_diff.planned_move_changes(df.limit(0)).count() == 0
    assert snapshot_diff.planned_move_changes(df.where("snapshot_date = '2031-01-01'")).count() == 0


def test_text_helpers(spark):
    df = spark.createDataFrame([("  A/b\\ c.jpg　", " VALID\t"), ("x\\", ""), (None, None), ("n", " Test")], "p string, s string")
    got = [tuple(r) for r in df.select(text.file_name(F.col("p")), text.split_name(F.col("s"))).collect()]
    assert got == [(" c.jpg", "val"), (None, None), (None, None), ("n", "test")]


def _cases(payload):
    """The elements other than null of the arrays of interest, by walking the decoded payload."""
    try:
        x = payload
        while isinstance(x, str):
            x = json.loads(x)
    except ValueError:
        return
    get = lambda o, k: o.get(k) if isinstance(o, dict) else None
    lists = [("detection", 0, get(get(x, "request"), "detections"))]
    obs = get(get(x, "request"), "observations")
    lists += [("detection", i, get(o, "detections")) for i, o in enumerate(obs if isinstance(obs, list) else [])]
    lists += [("missing", 0, get(get(get(x, "expected"), "match"), "missing")), ("persistent_missing", 0, get(get(get(x, "expected"), "temporal"), "persistent_missing"))]
    for child, n, items in lists:
        for i, e in enumerate(items if isinstance(items, list) else []):
            if e is not None:
                yield child, n, i


def test_many_snapshots(spark):
    rng = random.Random(5)
    rows = [(d, k, rng.randint(0, 2), i) for i in range(3) for d in (1, 4, 5, 9, None) for k in ("a", "b", "c", None) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "d int, k string, v int, at int")
    run = lambda most: sorted(tuple(r) for r in snapshot_diff.snapshot_changes(df, F.col("d"), F.col("k"), F.col("at"), [F.col("v")], max_snapshots=most).collect())
    assert run(2) == run(100) and len(run(2)) > 3 and {r[0] for r in run(2)} <= {4, 5, 9}


def _random(rng, depth=0):
    kind = rng.choice(["null", "number", "text", "list", "object", "bool"] if depth < 3 else ["null", "number"])
    if kind == "list":
        return [_random(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind == "object":
        return {k: _random(rng, depth + 1) for k in rng.sample(["class", "bbox", "detections", "context", "zzz"], 2)}
    return {"null": None, "number": rng.random(), "text": "téxt \"", "bool": True}[kind]


def test_shredding_against_a_walk(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        det = lambda: [_random(rng, 1) for _ in range(rng.randint(0, 4))] if rng.random() < 0.8 else _random(rng)
        x = {"mode": rng.choice(["instant", "temporal", 3]), "request": {"detections": det(), "observations": [{"detections": det()} if rng.random() < 0.8 else _random(rng) for _ in range(rng.randint(0, 3))]}, "expected": {"match": {"missing": det()}, "temporal": {"persistent_missing": det()}}}
        for k in ("request", "expected"):
            if rng.random() < 0.1:
                x[k] = _random(rng)
        p = json.dumps(x)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            p = json.dumps(p)
        rows.append((i, "c", p if rng.random() > 0.1 else p[: len(p) // 2], dt.datetime(2031, 1, 1)))
    rows += [(900, "c", None, dt.datetime(2031, 1, 1)), (901, "c", "", None), (902, "c", "[]", None), (903, "c", "7", None), (904, "c", "NaN", None), (905, "c", '{"a": 1} x', None)]
    df = spark.createDataFrame(rows, "record_id long, camera_id string, payload string, received_at timestamp")
    want = sorted({(r[0], *c) for r in rows if r[2] for c in _cases(r[2])})
    assert sorted(tuple(r) for r in shred.children(df).collect()) == want
    levels = shred.request_levels(df)
    full = shred.detections(levels).select("record_id", F.lit("detection"), "obs_no", "item_no").distinct()
    assert sorted(tuple(r) for r in full.collect()) == [w for w in want if w[1] == "detection"]
    ids = {r[0] for r in shred.records(levels).select("record_id").collect()}
    assert {902, 903} <= ids and not ids & {900, 901, 904, 905}


def test_shredding_keeps_values(spark):
    x = {"mode": "temporal", "new": {"a": [1]}, "request": {"observations": [{"context": {"zone_id": "z", "planned_work": 7}, "detections": [{"class": "c", "confidence": 0.50, "bbox": [1, "2", None], "odd": [1]}, None, "car", {"bbox": []}, {"bbox": "no"}]}, None]}}
    old = {"mode": "instant", "request": {"detections": ["x"]}}
    rows = [(1, "c", json.dumps(x), dt.datetime(2031, 1, 2)), (1, "c", json.dumps(old), dt.datetime(2031, 1, 1))]
    levels = shred.request_levels(spark.createDataFrame(rows, "record_id long, camera_id string, payload string, received_at timestamp"))
    d = sorted((r["obs_no"], r["item_no"], r["kind"], r["class"], r["confidence"], r["bbox"], r["extra"], r["raw"] if r["kind"] == "string" else None) for r in shred.detections(levels).collect())
    assert d == [(0, 0, "object", "c", "0.5", ["1", "2", None], '{"odd":[1]}', None), (0, 2, "string", None, None, None, None, "car"), (0, 3, "object", None, None, [], None, None), (0, 4, "object", None, None, None, None, None)]
    o = [(r["obs_no"], r["kind"], r["planned_work"], r["zone_id"]) for r in shred.observations(levels).collect()]
    assert o == [(0, "object", "7", "z")]
    assert shred.records(levels).first()["extra"] == '{"new":{"a":[1]}}'
    assert shred.children(spark.createDataFrame([], "record_id long, camera_id string, payload string, received_at timestamp, z string")).count() == 0
