from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from sparkyard.llm import group_splits as g
from sparkyard.session import Scratch


def test_merge_against_union_find(spark):
    rng = random.Random(3)
    ties = [(f"m{rng.randint(0, 90):02d}", f"m{rng.randint(0, 90):02d}") for _ in range(70)] + [(f"z{i:02d}", f"z{i + 1:02d}") for i in range(40)] + [(None, "m01"), ("solo", "solo")]
    parent: dict = {"solo": "solo"}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in ties:
        if a and b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    start = spark.createDataFrame([("solo", "solo")], "member string, unit string")
    got = {r["member"]: r["unit"] for r in g.merge(spark, start, spark.createDataFrame(ties, "a string, b string"), Scratch(spark, "t")).collect()}
    assert {k: v for k, v in got.items()} == {x: find(x) for x in parent if x in got} and len(got) >= len({x for a, b in ties if a and b and a != b for x in (a, b)})


def test_divided_units(spark):
    rows = [
        ("d1", " A+b ", "train;"), ("d1", "B+c", "VALID"), ("d1", "c", None), ("d1", "x", "train; train"), ("d1", "y", "train,test"), ("d1", None, "train;val"), ("d1", " + ", "train;val"),
        ("d2", "z", "train"), ("d2", "z+w+", "train\t"), ("d2", "Q", "val"), ("d2", "q ", "valid"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "source string, group_id string, final_splits string, unit string")
    assert {tuple(r) for r in g.divided_units(spark, df).collect()} == {("d1", "a"), ("d1", "y")}
    assert g.divided_units(spark, df.limit(0)).count() == 0


def _counts(spark, rows):
    return spark.createDataFrame(rows, "member string, images bigint")


def _ids(spark, lists):
    return spark.createDataFrame([(x,) for x in lists], "m array<string>")


def test_shares_are_met(spark):
    rng = random.Random(4)
    rows = [(f"u{i}", rng.choice([1, 1, 1, 2, 5, 40])) for i in range(3000)] + [("hot", 9000)]
    s = g.advance(spark, g.Components.empty(spark), _ids(spark, [["u1", "u2"], ["u2", "u3"]]), _counts(spark, rows)).splits
    n = {r[0]: r[1] for r in s.groupBy("split").agg(F.sum("images")).collect()}
    total = sum(x for _, x in rows)
    assert s.count() == 2999 and sum(n.values()) == total
    for split, share in g.SHARES.items():
        assert abs(n[split] - share * total) <= 60
    assert s.where("split IS NULL").count() == 0


def test_batches_keep_fill_and_quarantine(spark, tmp_path):
    first = g.advance(spark, g.Components.empty(spark), _ids(spark, [["a", "b"]]), _counts(spark, [("a", 70), ("c", 20), ("d", 10)]))
    at = {r["unit"]: r["split"] for r in first.splits.collect()}
    assert at == {"a": "train", "c": "val", "d": "test"}
    first = first.save(str(tmp_path / "state"))
    # e joins a's unit; c and d, of different splits, are tied; f and g are new
    second = g.advance(spark, first, _ids(spark, [["b", "e"], ["d", "c"], ["f", "g"]]), _counts(spark, [("e", 5), ("f", 30), ("g", 10)]))
    got = {r["unit"]: (r["split"], r["images"], r["status"]) for r in second.splits.collect()}
    assert got == {"a": ("train", 75, "kept"), "c": (None, 30, "quarantined"), "f": ("val", 40, "new")}
    third = g.advance(spark, second, _ids(spark, []), _counts(spark, [("h", 10)]))
    again = {r["unit"]: (r["split"], r["status"]) for r in third.splits.collect()}
    assert again["a"] == ("train", "kept") and again["c"] == (None, "quarantined") and again["f"] == ("val", "kept") and again["h"][0] in ("train", "test")  # both lack as much


def _manifest(spark, rows):
    return spark.createDataFrame([(i, g, dt.datetime(2031, 1, 1), dt.datetime(2031, 1, 1)) for i, g in rows], "image_id long, group_id string, recorded_at timestamp, loaded_at timestamp")


def test_two_calls_on_one_folder(spark, tmp_path):
    folder = str(tmp_path / "state")
    audit = lambda *ids: spark.createDataFrame([(x,) for x in ids], "group_id string")
    rows = [(i, "a") for i in range(70)] + [(100 + i, "b") for i in range(20)] + [(200 + i, "c") for i in range(10)]
    at = lambda df: {(r["group_id"], r["split"], r["status"]) for r in df.collect()}
    assert at(g.assign_images(spark, _manifest(spark, rows), audit(), folder)) == {("a", "train", "new"), ("b", "val", "new"), ("c", "test", "new")}
    rows += [(300 + i, "d") for i in range(5)]
    assert at(g.assign_images(spark, _manifest(spark, rows), audit("A + d"), folder)) == {("a", "train", "kept"), ("b", "val", "kept"), ("c", "test", "kept")}
    assert {(r["unit"], r["images"]) for r in g.Components.load(spark, folder).splits.collect()} == {("a", 75), ("b", 20), ("c", 10)}
    assert at(g.assign_images(spark, _manifest(spark, rows), audit("b+c"), folder)) == {("a", "train", "kept"), ("b", None, "quarantined")}
    assert at(g.assign_images(spark, _manifest(spark, rows[:3]), audit(), folder)) == {("a", "train", "kept")}
    assert len(g.VersionedTable(spark, folder).versions()) == 4


def test_divided_units_over_a_persisted_table(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame([("d1", *r) for r in rows], "source string, group_id string, final_splits string")
    folder = str(tmp_path / "state")
    assert g.divided_units(spark, df(("a+b", "train"), ("c", "val")), folder).count() == 0
    got = g.divided_units(spark, df(("b", "train"), ("d", "val"), ("a + d", None)), folder)
    assert [tuple(r) for r in got.collect()] == [("d1", "a")]
    assert {(r["member"], r["unit"]) for r in g.Components.load(spark, folder).units.collect()} == {("a", "a"), ("b", "a"), ("d", "a"), ("c", "c")}


def test_images_of_a_unit_share_a_split(spark, data):
    d = f"{data}/sf0.001"
    m, a = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("manifest", "group_split_audit"))
    x = g.assign_images(spark, m, a)
    assert x.count() == m.select("image_id").distinct().count() == x.select("image_id").distinct().count()
    assert x.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n <> 1").count() == 0
    assert g.assign_images(spark, m.limit(0), a).count() == 0
