from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkyard.llm import components
from sparkyard.session import Scratch

PAIR = "image_a string, image_b string, audited_at timestamp, visual_review string, pair_id string, a string, name string"


def _groups(links):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


def test_random_graphs(spark):
    rng = random.Random(1)
    links = [(f"n{rng.randint(0, 150):03d}", f"n{rng.randint(0, 150):03d}") for _ in range(110)] + [("hub", f"h{i:03d}") for i in range(120)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    df = spark.createDataFrame(links, "a string, b string").where("a <> b")
    got = {r["name"]: r["group_id"] for r in components.name_groups(spark, df).collect()}
    assert got == _groups([x for x in links if x[0] != x[1]])
    assert components.name_groups(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("giant", [False, True])
def test_hot_vertex_is_split(spark, giant):
    """A hub, and the root of a giant component with all its members, aren't one task's: adaptive execution splits their partition."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "60KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        scratch = Scratch(spark, "t")
        n = spark.range(40_000)
        hot = n.selectExpr("0L AS v", "id AS u") if giant else n.selectExpr("0L AS v", "id AS u").unionByName(n.selectExpr("id AS v", "0L AS u"))
        state = scratch.save(hot.unionByName(n.selectExpr("id AS v", "id AS u")).repartition(16))
        low = scratch.save(state.groupBy("v").agg(F.min("u").alias("m")))
        sent = components._sent(state, low)
        assert sent.where("v = 0").count() == 40_000
        rows = sent.collect()
        assert len(rows) > 40_000 and "skew=true" in sent._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_dirty_pairs(spark):
    ok, no = components.LINKS, "visually_not_leakage"
    t = lambda h: dt.datetime(2031, 1, 1, h)
    rows = [
        ("x/b.jpg", "y\\a.jpg ", t(1), ok), ("a.jpg", "b.jpg", t(0), no),  # the later row decides, whichever way round
        ("./b.jpg", "c.jpg", t(1), ok), ("c.jpg", "d.jpg", t(1), ok), ("d.jpg", "c.jpg", t(2), no), ("d.jpg", "c.jpg", t(2), None),
        ("e.jpg", "e.jpg", t(1), ok), ("q/e.jpg", "e.jpg", t(1), ok), (None, "f.jpg", t(1), ok), (" ", "f.jpg", t(1), ok), ("g.jpg", "h.jpg", None, ok), ("i.jpg", "j.jpg", t(1), "HIGH"),
        ("g.jpg", "h.jpg", None, ok), ("tie1", "tie2", t(3), no), ("tie2", "tie1", t(3), ok),
    ]
    df = spark.createDataFrame([(*r, None, "clash", "clash") for r in rows], PAIR)
    got = {r["image"]: r["group_id"] for r in components.image_groups(spark, df).collect()}
    assert got == {"a.jpg": "a.jpg", "b.jpg": "a.jpg", "c.jpg": "a.jpg", "g.jpg": "g.jpg", "h.jpg": "g.jpg", "tie1": "tie1", "tie2": "tie1"}
    assert components.image_groups(spark, df.limit(0)).count() == 0
