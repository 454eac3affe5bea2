"""Operators on hand-built and random cases."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from sparkyard.functions import names, taxonomy, vectors
from sparkyard.operators import catalog, dedup, detections, evaluate, fingerprints, graph, infer, labels, pairs, ranking, rebalance, validate
from sparkyard.plans import detection_queries
from sparkyard.sources import files, sinks
from sparkyard.streaming import series


def test_label_lines_and_clean_boxes(spark):
    lines = [(1, 1, "0 0.5 0.5 0.2 0.2"), (1, 2, "3.9 .5 .5 .1 .1"), (1, 3, "0 1 2 3"), (1, 4, "x .5 .5 .1 .1"), (1, 5, "9 .5 .5 .1 .1"), (1, 6, "  "), (1, 7, "1 0.5 0.5 0.2 0.2 0"), (2, 1, "2 .5 .5 .1 .1"), (3, 1, "1 nan .5 .1 .1")]
    names_ = spark.createDataFrame([(0, "Dump-Truck"), (1, "trailer"), (2, "CRANE"), (3, "grader")], "id int, name string")
    x = labels.parse_label_lines(spark.createDataFrame(lines, "image_id long, line_no int, line string"), names_)
    got = {(r["image_id"], r["line_no"]): (r["raw_label"], r["warning"]) for r in x.collect()}
    assert got == {(1, 1): ("Dump-Truck", None), (1, 2): ("grader", None), (1, 3): (None, "field_count"), (1, 4): (None, "not_numeric"), (1, 5): (None, "unknown_class_id"), (1, 7): (None, "field_count"), (2, 1): ("CRANE", None), (3, 1): ("trailer", None)}
    rows = [(1, 1, "excavator", 0.05, 0.5, 0.1, 0.1), (1, 2, "excavator", 0.0491, 0.5, 0.1, 0.1), (1, 3, "excavator", 0.0489, 0.5, 0.1, 0.1), (1, 4, "excavator", 0.5, 0.5, 0.0, 0.1), (1, 5, "excavator", float("nan"), 0.5, 0.1, 0.1), (2, 1, "crane", 0.5, 0.5, 0.1, 0.1), (3, 1, "gazelle", 0.5, 0.5, 0.1, 0.1)]
    b = spark.createDataFrame(rows, "image_id long, line_no int, raw_label string, x double, y double, w double, h double")
    kept = {r["line_no"]: (round(r["x"], 6), round(r["w"], 6)) for r in labels.clean_boxes(b).collect()}
    assert kept == {1: (0.05, 0.1), 2: (0.04955, 0.0991)}
    assert {tuple(r) for r in labels.exclusions(b).collect()} == {(2, "ambiguous_label"), (3, "no_boxes")}
    assert labels.clean_boxes(b.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("source", "path", "group"),
    [
        ("d1", "a\\camera_East-1_2023-10-05T10_jpg.rf.0a1b.jpg", "d1:camera=east-1:date=2023-10-05"), ("d1", "12_x-2023-10-05_jpg.rf.aa.jpg", "d1:camera=12:date=2023-10-05"), ("d1", "x_1.jpg", None),
        ("d8", "cc-1_22_20190118T5_png.rf.ff.png", "d8:cc-1_22:date=20190118"), ("d8", "Site_Flight_01_7.jpg", "d8:site_flight_01"), ("d8", "DJI_12.jpg", "d8:dji_numbered_series"), ("d8", "DJI_12x.jpg", None),
        ("d6", "ezgif-frame-3_jpg.rf.ab.jpg", "d6:ezgif-frame"), ("d7", "ezgif-frame-3.jpg", None),
    ],
)
def test_group_of(spark, source, path, group):
    df = spark.createDataFrame([(source, path)], "s string, p string")
    assert df.select(names.group_of(F.col("s"), names.stem(F.col("p")))["group_id"]).first()[0] == group


def test_dedup(spark):
    rows = [(1, "d6", "train", "b", "h"), (2, "d1", "test", "a", "h"), (3, "d1", "val", "c", "h"), (4, "d1", "train", "d", None), (5, "d1", "train", "e", "z")]
    im = spark.createDataFrame(rows, "image_id long, source string, split string, original_image string, sha1 string")
    r = dedup.duplicate_report(im).collect()
    assert len(r) == 1 and (r[0]["kept_image_id"], r[0]["copies"], r[0]["all_sources"], r[0]["all_splits"]) == (2, 3, "d1;d6", "test;train;val")
    assert {x["image_id"] for x in dedup.deduplicate(im).collect()} == {2, 4, 5}
    b = spark.createDataFrame([(1, 1, "truck", 0.5, 0.5, 0.1, 0.1), (2, 1, "truck", 0.5000000001, 0.5, 0.1, 0.1), (3, 1, "truck", 0.6, 0.5, 0.1, 0.1), (4, 1, "truck", 0.5, 0.5, 0.1, 0.1)], "image_id long, line_no int, class string, x double, y double, w double, h double")
    assert sorted((x["image_id"], round(x["x"], 3)) for x in dedup.merged_boxes(im, b).collect()) == [(2, 0.5), (2, 0.6), (4, 0.5)]
    assert {(x["split_a"], x["split_b"]): x["n"] for x in dedup.shared_across_splits(im, ["sha1"]).collect()} == {("train", "val"): 1, ("train", "test"): 1, ("val", "test"): 1}


def test_vectors(spark):
    rng = random.Random(1)
    a, b = ([rng.gauss(0, 1) for _ in range(64)] for _ in range(2))
    r = spark.createDataFrame([(a, b, [0.0] * 64)], "a array<double>, b array<double>, z array<double>").select(
        vectors.cosine(F.col("a"), F.col("b")), vectors.ncc(F.col("a"), F.col("b")), vectors.mae(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.hamming(vectors.pack_bits(vectors.sign_bits(F.col("a"))), vectors.pack_bits(vectors.sign_bits(F.col("b"))))
    ).first()
    import numpy as np

    x, y = np.array(a), np.array(b)
    cos = lambda p, q: p @ q / np.linalg.norm(p) / np.linalg.norm(q)
    assert r[0] == pytest.approx(cos(x, y)) and r[1] == pytest.approx(cos(x - x.mean(), y - y.mean())) and r[2] == pytest.approx(np.abs(x - y).mean())
    assert r[3] == 0 and r[4] == ((x > 0) != (y > 0)).sum()
    d = np.array(vectors.dct_matrix(32))
    assert np.allclose(d @ d.T, np.eye(32))
    p, q = vectors.perceptual_hashes(rng_image := [[rng.random() for _ in range(32)] for _ in range(32)], [r[:9] for r in rng_image[:8]])
    assert -(1 << 63) <= p < 1 << 63 and p >= 0 and -(1 << 63) <= q < 1 << 63


def test_triage_thresholds(spark):
    rows = [(3, 5, 0.985, 0.04, False, None), (4, 5, 0.985, 0.04, False, None), (30, 30, 0.94, 1.0, True, 3), (30, 30, 0.94, 1.0, False, 3), (12, 10, 0.9, 1.0, False, None), (12, 11, 0.9, 1.0, False, None), (30, 30, 0.84, 1.0, True, 15), (30, 30, 0.84, 1.0, True, 16), (0, 0, float("nan"), 0.0, True, 0), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "p int, d int, ncc double, mae double, fam boolean, delta int")
    got = [r[0] for r in df.select(pairs.triage(*(F.col(c) for c in ("p", "d", "ncc", "mae", "fam", "delta")))).collect()]
    h, m, n = pairs.HIGH, pairs.POSSIBLE, pairs.NOT
    assert got == [h, m, h, n, m, n, m, n, n, n]


def test_cross_split_candidates(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice(["train", "val", "test", None]), rng.getrandbits(64) - (1 << 63) if i % 9 else None, rng.getrandbits(64) - (1 << 63)) for i in range(150)]
    order = {"train": 0, "val": 1, "test": 2}
    ham = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    want = {(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] and y[2] and x[3] is not None and y[3] is not None and order[x[2]] < order[y[2]] and (ham(x[3], y[3]) <= 26 or ham(x[4], y[4]) <= 24)}
    got = pairs.cross_split_candidates(spark.createDataFrame(rows, "id long, source string, split string, phash long, dhash long"), 26, 24, block_rows=7)
    assert {(r["a"], r["b"]) for r in got.collect()} == want and got.count() == len(want)


def test_row_numbers(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2, 3, None]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = ranking.row_numbers(df, ["k"], [F.desc_nulls_last("v"), F.asc("i")], "n", parts=7).collect()
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2])), 1):
            want[r[2]] = n
    assert {r["i"]: r["n"] for r in got} == want and len(got) == 300
    assert ranking.row_numbers(df.limit(0), ["k"], [F.asc("i")], "n").count() == 0


def test_closure_ids(spark):
    rows = [("a", "a"), ("b", "a"), ("b", "a"), ("c", "c"), ("d", "d"), (None, "d"), ("e", "d")]
    m = spark.createDataFrame(rows, "member string, component string")
    digest = lambda x: "historical_closure_" + hashlib.sha256(x.encode()).hexdigest()[:12]
    assert {tuple(r) for r in rebalance.closure_id(spark, m).collect()} == {("a", 2, digest("a|b")), ("c", 1, digest("c")), ("d", 2, digest("d|e"))}
    new = spark.createDataFrame([("e", "n2"), ("d", "n1"), ("e", "n1"), ("a", None), ("zz", "n9")], "member string, new_id string")
    assert {r["component"]: r["closure_id"] for r in rebalance.closure_id(spark, m, new).collect()} == {"a": digest("a|b"), "c": digest("c"), "d": "n1+n2"}
    assert rebalance.closure_id(spark, m.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 120):03d}", f"n{rng.randint(0, 120):03d}") for _ in range(90)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("hub", f"h{i}") for i in range(50)] + [(None, "x")]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark, spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark, spark.createDataFrame([], "a string, b string")).count() == 0


def test_descend_against_brute_force():
    rng = random.Random(5)
    groups = [{"id": str(i), "images": {"train": rng.choice([2, 3]), "val": 2, "test": 2}, "boxes": {("train", "a"): rng.randint(0, 5), ("val", "b"): rng.randint(0, 5)}} for i in range(5)]
    images, boxes = {"train": 30, "val": 12, "test": 10}, {("train", "a"): 40, ("val", "b"): 30, ("test", "a"): 5}

    def score(dest):
        di, db = dict.fromkeys(rebalance.SPLITS, 0), {(s, c): 0 for s in rebalance.SPLITS for c in "ab"}
        for g in groups:
            for s, n in g["images"].items():
                di[s] -= n * (s != dest[g["id"]])
                di[dest[g["id"]]] += n * (s != dest[g["id"]])
            for (s, c), n in g["boxes"].items():
                if s != dest[g["id"]]:
                    db[s, c] -= n
                    db[dest[g["id"]], c] += n
        per = {"a": 45, "b": 30}
        return 2 * sum(map(abs, di.values())) / 52 + sum(sum(abs(db[s, c]) for s in rebalance.SPLITS) / per[c] for c in "ab") / 2

    allowed = [[s for s in rebalance.SPLITS if g["images"][s] == max(g["images"].values())] for g in groups]
    best = min(score(dict(zip("01234", p))) for p in itertools.product(*allowed))
    found, value = rebalance.descend(groups, images, boxes, restarts=20)
    assert value == pytest.approx(score(found)) == pytest.approx(best)


# the acceptance cases: profile, active conditions, target zone, (class, confidence, zone) of the detections, then status by bucket counts, score, coverage
GOLDEN = [
    (15, [], "pit-a", [("excavator", 0.93, None), ("dump_truck", 0.88, None)], (2, 0, 0), 1.0, 1.0),
    (15, [], "pit-a", [("excavator", 0.94, None)], (1, 1, 0), 0.5, 1.0),
    (30, [], "green-a", [("truck", 0.91, None), ("mobile_crane", 0.86, None)], (2, 0, 1), 1.0, 0.667),
    (2, [], None, [], (0, 0, 0), None, 0.0),
    (15, [], "pit-a", [("excavator", 0.93, None), ("dump_truck", 0.249999, None)], (1, 1, 0), 0.5, 1.0),
    (15, [], None, [("excavator", 0.93, None), ("dump_truck", 0.88, None)], (2, 0, 0), 1.0, 1.0),
    (15, [], "pit-a", [("excavator", 0.93, "pit-a"), ("dump_truck", 0.88, "pit-b")], (1, 1, 0), 0.5, 1.0),
    (24, ["для бетонного основания"], "x", [("dump_truck", 0.9, None), ("roller", 0.9, None), ("motor_grader", 0.9, None)], (3, 1, 0), 0.75, 1.0),
]


def test_acceptance_cases(spark):
    rows, frames = [], []
    for i, (profile, active, zone, found, *_) in enumerate(GOLDEN):
        frames.append((i, profile, zone, active))
        rows += [(i, "object", None, c, None, str(p), z, None, zone, zone) for c, p, z in found]
    d = spark.createDataFrame(rows, "frame_key int, kind string, raw string, class string, class_name string, confidence string, zone_id string, bbox array<string>, frame_zone string, target_zone string")
    ok = detections.routed(detections.normalized(d)).where("bucket = 'accepted'").groupBy("frame_key").agg(F.collect_set("class").alias("accepted"), F.collect_set(F.when(F.col("zone_verified"), F.col("class"))).alias("verified"))
    e = F.array().cast("array<string>")
    f = spark.createDataFrame(frames, "frame_key int, profile_id int, target_zone string, active array<string>").join(ok, "frame_key", "left").withColumn("accepted", F.coalesce("accepted", e)).withColumn("verified", F.coalesce("verified", e))
    got = {r["frame_key"]: r for r in detections.frame_summary(f, detections.requirement_results(f, detection_queries.requirements(spark))).collect()}
    for i, (*_, counts, score, coverage) in enumerate(GOLDEN):
        r = got[i]
        assert ((r["satisfied"], r["missing"], r["uncertain"]), r["score"], r["coverage"]) == (counts, score, coverage), i


def test_observability_of_profiles(spark):
    req = detection_queries.requirements(spark)
    off = {r[0]: r[1] for r in detections.observability(req, F.lit(False)).collect()}
    on = {r[0]: r[1] for r in detections.observability(req, F.lit(True)).collect()}
    assert off == {2: 0.0, 3: 0.25, 12: 0.0, 15: 1.0, 17: 1.0, 22: 0.5, 24: 1.0, 30: 0.833}
    assert on == {2: 1.0, 3: 0.5, 12: 0.167, 15: 1.0, 17: 1.0, 22: 0.5, 24: 1.0, 30: 0.833}


def test_detection_boundaries(spark):
    boxes = [["0", "0", "1", "1"], ["0", "0", "0", "1"], ["-1", "0", "1", "1"], ["0", "0", "NaN", "1"], ["0", "0", "1"], ["0", "0", None, "1"], None]
    conf = ["0.249999", "0.25", "0.250001", "NaN", "Infinity", "-0.1", "1.1", "x", None]
    rows = [("object", None, "truck", None, "0.9", None, b) for b in boxes] + [("object", None, "truck", None, c, None, None) for c in conf] + [("string", "truck", None, None, None, None, None), ("number", "3", None, None, None, None, None), ("object", None, None, None, None, None, None), ("object", None, None, "ufo", None, None, None)]
    d = spark.createDataFrame(rows, "kind string, raw string, class string, class_name string, confidence string, zone_id string, bbox array<string>").withColumn("frame_zone", F.lit(None).cast("string")).withColumn("target_zone", F.lit(None).cast("string"))
    got = [(r["bucket"], r["invalid_reason"]) for r in detections.routed(detections.normalized(d)).collect()]
    ok, box, cf = ("accepted", None), ("invalid", "invalid_bbox"), ("invalid", "invalid_confidence")
    assert got == [ok, box, box, box, box, box, ok, ("low_confidence", None), ok, ok, cf, cf, cf, cf, cf, ok, ok, ("invalid", "invalid_detection_type"), ("invalid", "missing_class"), ("unknown_class", None)]
    arrays = spark.createDataFrame([(1, [" Truck", "background"], [0.9, 0.8], [[0.0], [1.0]]), (2, ["a"], [], [])], "k int, class_names array<string>, scores array<double>, boxes array<array<double>>")
    assert [(r["k"], r["class"], r["problem"]) for r in detections.from_arrays(arrays, ["k"]).orderBy("k").collect()] == [(1, "truck", None), (2, None, "inconsistent_result")]


def _series(spark):
    ts = lambda m: dt.datetime(2031, 1, 1, 0, m)
    rows = [("h", i, ts(i), "required:dump_truck", b) for i, b in enumerate(["satisfied", "missing", "satisfied"])]
    rows += [("i", i, ts(i), "required:dump_truck", "missing") for i in range(4)]
    rows += [("alt", i, ts(i), "x", b) for i, b in enumerate(["missing", "uncertain"] * 2)]
    rows += [("edge", i, ts(i), "x", "missing" if i else "satisfied") for i in range(4)] + [("few", 0, ts(0), "x", "missing")]
    return spark.createDataFrame(rows, "series string, obs_no long, ts timestamp, id string, bucket string")


WANT = {("h", "transient"), ("i", "persistent_missing"), ("alt", "persistent_uncertain"), ("edge", "persistent_missing"), ("few", "insufficient_data")}


def test_persistence_batch_and_stream(spark, tmp_path):
    r = _series(spark)
    sizes = r.groupBy("series").agg(F.countDistinct("obs_no").alias("n"))
    assert {(x["series"], x["state"]) for x in detections.persistence(r, sizes, ["series"]).collect()} == WANT
    for k, part in enumerate(("obs_no < 2", "obs_no >= 2")):
        r.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(r.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = series.running_persistence(stream).writeStream.outputMode("update").format("memory").queryName("persist").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.sql("SELECT series, max_by(state, n) AS state FROM persist GROUP BY series")
    assert {(x["series"], x["state"]) for x in last.collect()} == WANT
    w = series.windowed_counts(stream, "ts", ["series"], "2 minutes").writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/w").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert w.exception() is None


def test_window_and_series_problems(spark):
    ts = lambda s: dt.datetime(2031, 1, 1, 0, 0, s)
    rows = [("a", 0, ts(0), "w"), ("a", 1, ts(10), "w"), ("a", 2, ts(20), "w"), ("b", 0, ts(1), "w"), ("b", 1, ts(1), "v"), ("c", 0, None, None)]
    o = spark.createDataFrame(rows, "s string, n int, ts timestamp, work string")
    assert {(r["s"], r["n"]) for r in detections.trailing_window(o.where("s = 'a'"), ["s"], "ts", F.lit(10.0)).collect()} == {("a", 1), ("a", 2)}
    assert detections.trailing_window(o, ["s"], "ts", F.lit(None).cast("double")).count() == 6
    p = {r["s"]: (r["n"], r["no_timestamp"], r["duplicate_timestamps"], r["mixed_work"]) for r in detections.series_problems(o, ["s"], "ts", ["work"]).collect()}
    assert p == {"a": (3, False, False, False), "b": (2, False, True, True), "c": (1, True, False, False)}


def _brute_match(gt, pred, least):
    used, out = set(), []
    for p in sorted(pred, key=lambda p: (-p[1], p[0])):
        best = None
        for g in sorted(gt):
            if g[0] in used:
                continue
            w, h = (max(0, min(p[2][k + 2], g[1][k + 2]) - max(p[2][k], g[1][k])) for k in (0, 1))
            area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
            i = w * h / (area(p[2]) + area(g[1]) - w * h)
            if best is None or i > best[0]:
                best = (i, g[0])
        hit = best[1] if best and best[0] >= least else None
        used.add(hit)
        out.append((p[0], hit))
    return out


def test_greedy_match_against_brute_force(spark):
    rng = random.Random(7)
    box = lambda: (x := rng.randint(0, 6), y := rng.randint(0, 6), x + rng.randint(3, 6), y + rng.randint(3, 6))
    gt, pred, want = [], [], set()
    for image in range(40):
        g = [(image * 10 + k, tuple(map(float, box()))) for k in range(rng.randint(0, 4))]
        p = [(image * 10 + k, rng.choice([0.2, 0.3, 0.3, 0.9]), tuple(map(float, box()))) for k in range(rng.randint(0, 5))]
        gt += [(image, 1, a, *b) for a, b in g]
        pred += [("m", image, 1, a, s, *b) for a, s, b in p]
        want |= set(_brute_match(g, [x for x in p if x[1] >= 0.25], 0.3))
    g = spark.createDataFrame(gt, "image_id long, class_id int, ann_id long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(pred, "model string, image_id long, class_id int, pred_id long, score double, x1 double, y1 double, x2 double, y2 double")
    assert {(r["pred_id"], r["ann_id"]) for r in evaluate.greedy_match(g, p, 0.3).collect()} == want
    assert evaluate.greedy_match(g, p.limit(0)).count() == 0


def test_average_precision(spark):
    g = spark.createDataFrame([(i, c, i * 10 + c, 0.0, 0.0, 10.0, 10.0) for i in range(4) for c in range(3)], "image_id long, class_id int, ann_id long, x1 double, y1 double, x2 double, y2 double")
    rows = [("m", i, 0, i, 0.9 - i / 10, 0.0, 0.0, 10.0, 10.0) for i in range(4)] + [("m", i, 1, 100 + i, 0.5, 50.0, 0.0, 60.0, 10.0) for i in range(4)]
    rows += [("m", 0, 2, 200, 0.99, 50.0, 0.0, 60.0, 10.0), ("m", 0, 2, 201, 0.9, 0.0, 0.0, 10.0, 10.0), ("m", 1, 2, 202, 0.8, 0.0, 0.0, 10.0, 6.0)]
    p = spark.createDataFrame(rows, "model string, image_id long, class_id int, pred_id long, score double, x1 double, y1 double, x2 double, y2 double")
    ap = {(r["class_id"], r["iou"]): r["ap"] for r in evaluate.average_precision(g, p).collect()}
    assert ap[0, 0.5] == pytest.approx(1) and ap[0, 0.95] == pytest.approx(1) and ap[1, 0.5] == 0
    # one false positive ranked first: precision 1/2 at recall 1/4, then 2/3 at 1/2 where the second box is overlapped enough
    assert ap[2, 0.5] == pytest.approx(2 / 3 * 51 / 101) and ap[2, 0.75] == pytest.approx(1 / 2 * 26 / 101)
    m = evaluate.mean_ap(evaluate.average_precision(g, p)).first()
    assert m["map50"] == pytest.approx((1 + 2 / 3 * 51 / 101) / 3)


def test_catalog(spark):
    w = spark.createDataFrame([("A b", 1, 5), ("A b", 2, 6), ("a  B", 3, 7), ("X", 4, 8), ("x ", 5, 8), ("solo", 6, 9)], "work string, ordinal long, profile_id int")
    got = {r["q"]: (r["profile_id"], r["how"]) for r in catalog.look_up(spark.createDataFrame([("A b",), ("a b",), ("x",), (" SOLO",), ("no",), (None,)], "q string"), "q", w).collect()}
    assert got == {"A b": (6, "exact"), "a b": (None, None), "x": (None, None), " SOLO": (9, "normalized"), "no": (None, None), None: (None, None)}


def test_requirement_problems(spark):
    bad = [*detections.requirement_rows(1, ["ufo"], [([], [])], conditionals=[("", ["truck"], "some", [], "x")]), (1, 9, "required", "required:ufo", ["truck"], [], None, None, None)]
    got = {(r["name"], r["code"]) for r in validate.requirement_problems(spark.createDataFrame(bad, detections.REQUIREMENTS)).collect()}
    assert got == {("required:ufo", "unknown_class"), ("alternative:0", "empty_requirement"), ("conditional:0", "unknown_mode"), ("conditional:0", "unknown_relation"), ("conditional:0", "missing_condition"), ("required:ufo", "repeated_name")}


def _png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\x00\x00\x00" + bytes(4) + struct.pack(">I", 0) + b"IEND" + bytes(4)


def test_files(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 40, 1) + b"abc\xff\xd9"
    assert files.image_size(_png(7, 9)) == (7, 9) and files.image_size(jpeg) == (40, 30)
    root = tmp_path / "set"
    for name, data in {"train/images/a.PNG": _png(3, 4), "train/images/b.jpg": b"bad", "valid/images/c.jpg": jpeg, "train/labels/a.txt": b"0 .5 .5 .1 .1\n\n1 2\n", "data.yaml": b"nc: 2\nnames:\n  0: a\n  1: b\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    assert files.prepare_source(str(root), str(tmp_path / "cache")) == str(root)
    assert files.split_folder(str(root), "val").endswith("valid/images") and files.split_folder(str(root), "test") is None
    assert files.parse_names(files.load_yaml(str(root / "data.yaml"))["names"]) == {0: "a", 1: "b"} == files.parse_names(files.simple_yaml("names: [a, b]\n")["names"])
    im = files.list_images(spark, str(root), content=True)
    got = {r["path"].split("/")[-1]: (r["width"], r["height"], r["problem"]) for r in files.with_image_size(im, ["path"]).collect()}
    assert got["a.PNG"] == (3, 4, None) and got["c.jpg"] == (40, 30, None) and got["b.jpg"][2].startswith("invalid_image:")
    lines = files.read_label_lines(spark, str(root))
    assert [r["n"] for r in files.label_counts(lines).collect()] == [1]
    assert {r["path"].split("/")[-1]: r["label_path"] is not None for r in files.with_labels(files.list_images(spark, str(root)), lines).collect()} == {"a.PNG": True, "b.jpg": False, "c.jpg": False}
    provider = infer.infer(im, lambda: infer.ConstantProvider([{"class": "truck", "confidence": 0.5, "bbox": [0.0, 0.0, 1.0, 1.0]}]), ["path"])
    assert all(r["detections"][0]["class"] == "truck" and r["problem"] is None for r in provider.collect())
    (tmp_path / "w.json").write_text('{"works": [{"work": "a", "profile_id": 1}]}')
    assert files.read_records(spark, str(tmp_path / "w.json"), "work string, profile_id int").first()["profile_id"] == 1
    (tmp_path / "ids.txt").write_text("# c\n a1 \n\nb2\n")
    assert [r[0] for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a1", "b2"]
    got = files.with_image_size(spark.createDataFrame([(1, bytearray(jpeg[:-2])), (2, bytearray(b"")), (3, None)], "i int, content binary"), ["i"]).collect()
    assert [r["problem"].split(":")[-1] for r in got] == ["truncated", "empty", "empty"]
    webp = lambda kind, body: b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body
    assert files.image_size(webp(b"VP8X", bytes(4) + b"\x06\0\0\x08\0\0")) == (7, 9) and files.image_size(webp(b"VP8L", b"\x2f" + struct.pack("<I", 6 | 8 << 14))) == (7, 9)
    assert files.image_size(webp(b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 7, 9))) == (7, 9)
    for o, head in (("<", b"II*\0"), (">", b"MM\0*")):
        assert files.image_size(head + struct.pack(o + "IH", 8, 2) + struct.pack(o + "HHIHH", 256, 3, 1, 7, 0) + struct.pack(o + "HHII", 257, 4, 1, 9)) == (7, 9)
    with pytest.raises(ValueError):
        files.image_size(b"what is this")
    (tmp_path / "d.json").write_text('[{"class": "truck", "confidence": 1, "bbox": [0, 0, 1, 1]}, {"class": "x"}]')
    assert [tuple(r) for r in files.read_detections(spark, str(tmp_path / "d.json")).collect()] == [("truck", 1.0, [0.0, 0.0, 1.0, 1.0], None), ("x", None, None, None)]
    with pytest.raises(ValueError):
        files.read_detections(spark, str(tmp_path / "w.json"))
    (tmp_path / "bare" / "pics").mkdir(parents=True)
    assert files.parse_names(files.data_set_config("d1", str(tmp_path / "bare"))["names"])[1] == "excavator" and files.data_set_config("d6", str(root))["nc"] in (2, "2")
    with pytest.raises(ValueError):
        files.data_set_config("d6", str(tmp_path / "bare"))
    assert files.split_folder(str(tmp_path / "bare"), "val", {"val": "pics"}).endswith("pics") and files.split_folder(str(tmp_path / "bare"), "val", {"val": "none"}) is None
    low = infer.infer(im, lambda: infer.ConstantProvider([{"class": "truck", "confidence": 0.2}, {"class": "roller", "confidence": 0.25}]), ["path"], verify=True).withColumn("status", infer.status_of(F.col("problem"))).collect()
    assert {r["path"].split("/")[-1]: (r["status"], None if r["detections"] is None else [d["class"] for d in r["detections"]]) for r in low} == {"a.PNG": (200, ["roller"]), "b.jpg": (415, None), "c.jpg": (200, ["roller"])}
    assert files.is_archive("X.TAR.GZ") and not files.is_archive("x.rar")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ä;b", 1), (None, 2)], "t string, n int")
    sinks.write_csv(df, f"{tmp_path}/csv")
    back = files.read_csv(spark, f"{tmp_path}/csv")
    assert back.columns == ["t", "n"] and sorted(r["n"] for r in back.collect()) == ["1", "2"]
    sinks.write_csv(df.limit(0), f"{tmp_path}/empty")
    assert files.read_csv(spark, f"{tmp_path}/empty").columns == ["t", "n"]
    v = sinks.VersionedTable(spark, f"{tmp_path}/table")
    assert v.current() is None
    v.commit(df)
    v.commit(df.where("n = 1"))
    assert v.read().count() == 1 and v.read("v000000").count() == 2
    v.roll_back("v000000")
    assert v.read().count() == 2
    b = spark.createDataFrame([(1, "truck", 0.5, 0.5, 0.1, 0.1), (1, "excavator", 0.25, 0.5, 0.1, 0.1)], "image_id long, class string, x double, y double, w double, h double")
    t = sinks.label_text(b).withColumn("path", F.lit("labels/1.txt"))
    sinks.write_label_files(t, str(tmp_path))
    assert (tmp_path / "labels/1.txt").read_text() == "0 0.25000000 0.50000000 0.10000000 0.10000000\n2 0.50000000 0.50000000 0.10000000 0.10000000\n"
    assert "nc: 13" in sinks.data_yaml("/x", ["train"])
    sinks.write_json_report(spark, {"a": 1}, f"{tmp_path}/r.json")
    assert files.read_json_text(f"{tmp_path}/r.json") == {"a": 1}
    im = spark.createDataFrame([("d1", "a", "train"), ("d1", "a", "val")], "source string, image string, split string")
    assert all(r["collides"] for r in sinks.flat_view(im).collect()) and sinks.mirrored(im).count() == 4


def test_label_sinks(spark):
    x = spark.createDataFrame([("a", "0 1 2\n 0 1 2 \r\n\n1 2 3\n0 1 2"), ("b", ""), ("c", "\n")], "path string, content string")
    assert {r["path"]: r["content"] for r in sinks.flat_labels(x).collect()} == {"a": "0 1 2\n1 2 3\n", "b": "", "c": ""}
    y = sinks.data_yamls("/r", ["d1", "d6"])
    assert set(y) == {"data.yaml", "data_val_d1.yaml", "data_val_d6.yaml"} and "val: images/val/d6\n" in y["data_val_d6.yaml"] and "val: images/val\n" in y["data.yaml"]


def test_fingerprints(spark):
    rng = random.Random(9)
    w, h = 40, 50
    flat = [bytearray(rng.randrange(256) for _ in range(w * h * 3)), bytearray(b"\x80" * (w * h * 3)), bytearray(b"\x00"), None]
    df = spark.createDataFrame([(i, w, h, x, "z") for i, x in enumerate(flat)], "i int, width int, height int, rgb binary, phash string")
    r = fingerprints.fingerprints(df, ["i"]).orderBy("i").collect()
    assert [x["problem"] for x in r] == [None, None, "wrong_size", "wrong_size"] and len(r[0]["grey"]) == 64 * 64 and len(r[0]["histogram"]) == 48
    assert r[1]["dhash"] == 0 and abs(r[1]["grey"][5] - 128 / 255) < 1e-5 and [i for i, v in enumerate(r[1]["histogram"]) if v] == [8, 24, 40]
    assert abs(sum(v * v for v in r[0]["histogram"]) - 1) < 1e-5
    import numpy as np

    a = np.arange(12.0).reshape(3, 4)
    assert np.allclose(fingerprints.scaled(a, 3, 2), [[0.5, 2.5], [4.5, 6.5], [8.5, 10.5]]) and np.allclose(fingerprints.scaled(a, 3, 4), a)
    assert fingerprints.fingerprints(df.limit(0), ["i"]).count() == 0


def test_unions_snapshots_and_checkpoints(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    assert {tuple(r) for r in files.union_tagged([a, b]).collect()} == {(1, "x", 1), (2, None, 2)}
    for day, row in (("one", "1,a"), ("two", "2,\"b, c\"")):
        (tmp_path / day / "metadata").mkdir(parents=True)
        (tmp_path / day / "metadata" / "manifest.csv").write_text(f"\ufeffi,s\n{row}\n", encoding="utf-8")
    got = files.read_snapshots(spark, str(tmp_path / "*" / "metadata" / "manifest.csv"))
    assert {(r["i"], r["s"]) for r in got.collect()} == {("1", "a"), ("2", "b, c")} and got.columns == ["i", "s", "snapshot_id"]
    (tmp_path / "x.json").write_text("\ufeff{\"a\": 1}", encoding="utf-8")
    assert files.read_json_text(str(tmp_path / "x.json")) == {"a": 1}
    paths = ["/m/old/best.pth", "/m/run/last.pth", "/m/run/deep/best.pth", "/m/run/best.pth"]
    assert files.checkpoint_rank(paths, ["best.pth", "last.pth"], required="run") == "/m/run/best.pth"
    assert files.checkpoint_rank(paths, ["last.pth"], forbidden="run") is None


def test_candidates_in_scope(spark):
    rows = [(1, "d6", "train", 0, 0), (2, "d6", "val", 1, 1), (3, "d1", "train", 0, 0), (4, "d1", "test", 1, 1), (5, None, "val", 0, 0)]
    df = spark.createDataFrame(rows, "id long, source string, split string, phash long, dhash long")
    assert [tuple(r)[:2] for r in pairs.cross_split_candidates(df, sources=("d6",)).collect()] == [(1, 2)]
    assert {tuple(r)[:2] for r in pairs.cross_split_candidates(df).collect()} == {(1, 2), (3, 4)}
    assert pairs.cross_split_candidates(df.limit(0)).count() == 0


def test_public_names():
    import sparkyard

    assert all(getattr(sparkyard, n) for n in sparkyard.__all__) and not hasattr(sparkyard, "llm_nothing")


def test_taxonomy():
    rows = taxonomy.alias_rows()
    assert len({r[0] for r in rows}) == len(rows) and {r[1] for r in rows if r[1]} == set(taxonomy.CLASSES)
