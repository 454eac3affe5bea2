"""Queries that hold made-up predictions against made-up ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkyard.operators import evaluate as ev
from sparkyard.session import Scratch
from sparkyard.sources.tables import table


def _lines(s, d):
    """All lines as boxes."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_shipdate")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    x = li.withColumn("n", F.row_number().over(w))
    a, b = (F.col("l_partkey") % 900), (F.col("l_suppkey") % 90) * 10
    return x.select(F.col("l_orderkey").alias("image_id"), (F.col("l_orderkey") * 100 + F.col("n")).alias("ann_id"), "n", (F.col("l_partkey") % 13).cast("int").alias("class_id"), a.cast("double").alias("x1"), b.cast("double").alias("y1"), (a + 10 + F.col("l_quantity")).alias("x2"), (b + 20 + F.col("n")).cast("double").alias("y2"))


def truth(s, d):
    return _lines(s, d).withColumn("relative_area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 1e6)


def predictions(s, d):
    """Of two models: boxes shifted, some left out, some of another class."""
    out = None
    for model, px, gone in (("before", 2, 11), ("after", 1, 23)):
        shift = (F.col("image_id") % 7) * px
        x = _lines(s, d).where(F.col("image_id") % gone != 0)
        cls = F.when((F.col("image_id") + F.col("n")) % 17 == 0, (F.col("class_id") + 1) % 13).otherwise(F.col("class_id"))
        x = x.select(F.lit(model).alias("model"), "image_id", cls.cast("int").alias("class_id"), F.col("ann_id").alias("pred_id"), (((F.col("image_id") * 31 + F.col("n")) % 1000) / 1000).alias("score"), *((F.col(c) + shift).alias(c) for c in ("x1", "y1", "x2", "y2")))
        out = x if out is None else out.unionByName(x)
    return out


def _r(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _iou(s, d):
    g, p = truth(s, d), predictions(s, d)
    box = lambda: F.struct("x1", "y1", "x2", "y2")
    x = g.select("image_id", "class_id", "ann_id", box().alias("g")).join(p.select("model", "image_id", "class_id", "pred_id", box().alias("p")), ["image_id", "class_id"])
    return _r(x.select("model", "image_id", "ann_id", "pred_id", ev.iou(F.col("g"), F.col("p")).alias("iou")))


def queries() -> dict:
    match = lambda s, d: Scratch(s, "matches").save(ev.greedy_match(truth(s, d), predictions(s, d)))  # the reports read it several times
    ap = lambda s, d: ev.average_precision(truth(s, d), predictions(s, d))
    return {
        "iou_pairs": _iou,
        "greedy_match": lambda s, d: _r(match(s, d)),
        "prf_by_model": lambda s, d: _r(ev.with_delta(ev.precision_recall(truth(s, d), match(s, d), []), "before", "after")),
        "prf_by_class": lambda s, d: _r(ev.precision_recall(truth(s, d), match(s, d), ["class_id"])),
        "size_recall": lambda s, d: _r(ev.size_recall(truth(s, d), match(s, d))),
        "coco_ap": lambda s, d: _r(ap(s, d)),
        "coco_map": lambda s, d: _r(ev.mean_ap(ap(s, d))),
        "class_comparison": lambda s, d: _r(ev.class_comparison(ap(s, d), "before", "after")),
    }


_BOX = "(l_partkey % 900)::DOUBLE AS x1, ((l_suppkey % 90) * 10)::DOUBLE AS y1, l_partkey % 900 + 10 + l_quantity AS x2, ((l_suppkey % 90) * 10 + 20 + n)::DOUBLE AS y2"
SQL = f"""
WITH RECURSIVE li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS n FROM lineitem),
g AS (SELECT l_orderkey AS image_id, l_orderkey * 100 + n AS ann_id, n, (l_partkey % 13)::INT AS class_id, {_BOX} FROM li),
m AS (SELECT unnest([{{'model': 'before', 'px': 2, 'gone': 11}}, {{'model': 'after', 'px': 1, 'gone': 23}}], recursive := true)),
p AS (SELECT model, image_id, CASE WHEN (image_id + n) % 17 = 0 THEN (class_id + 1) % 13 ELSE class_id END AS class_id, ann_id AS pred_id, ((image_id * 31 + n) % 1000) / 1000 AS score,
  x1 + (image_id % 7) * px AS x1, y1 + (image_id % 7) * px AS y1, x2 + (image_id % 7) * px AS x2, y2 + (image_id % 7) * px AS y2 FROM g, m WHERE image_id % gone <> 0),
i AS (SELECT *, greatest(0.0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0.0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS cut, g.image_id AS im FROM g JOIN p ON g.image_id = p.image_id AND g.class_id = p.class_id),
pairs AS (SELECT model, im AS image_id, class_id, ann_id, pred_id, score, cut / ((x2 - x1) * (y2 - y1) + (x2_1 - x1_1) * (y2_1 - y1_1) - cut) AS iou FROM i)
"""


def _match_sql(name: str, score: float, ious: str, last: bool) -> str:
    """Greedy matching as a recursion over the ranked predictions of an image and class; ``ious`` lists the thresholds."""
    order = "DESC" if last else "ASC"
    return f"""
{name}_c AS (SELECT p.model, p.image_id, p.class_id, p.pred_id, p.score, row_number() OVER (PARTITION BY p.model, p.image_id, p.class_id ORDER BY p.score DESC, p.pred_id) AS k, coalesce(c, []) AS c
  FROM p LEFT JOIN (SELECT model, pred_id, list({{'iou': iou, 'ann_id': ann_id}} ORDER BY iou DESC, ann_id {order}) AS c FROM pairs GROUP BY ALL) q ON q.model = p.model AND q.pred_id = p.pred_id WHERE p.score >= {score}),
{name}_r AS (SELECT model, image_id, class_id, t, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS pred_id, NULL::DOUBLE AS score, NULL::BIGINT AS ann_id, NULL::DOUBLE AS iou FROM (SELECT DISTINCT model, image_id, class_id FROM {name}_c), (SELECT unnest({ious}) AS t)
  UNION ALL SELECT model, image_id, class_id, t, k, CASE WHEN b.iou >= t THEN list_append(used, b.ann_id) ELSE used END, pred_id, score, CASE WHEN b.iou >= t THEN b.ann_id END, CASE WHEN b.iou >= t THEN b.iou END
  FROM (SELECT r.model, r.image_id, r.class_id, r.t, c.k, r.used, c.pred_id, c.score, list_filter(c.c, lambda e: NOT list_contains(r.used, e.ann_id))[1] AS b FROM {name}_r r JOIN {name}_c c ON c.model = r.model AND c.image_id = r.image_id AND c.class_id = r.class_id AND c.k = r.k + 1)),
{name} AS (SELECT * FROM {name}_r WHERE k > 0)"""


def _prf_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY model, {by}" if by else "GROUP BY model"
    total = f"(SELECT {key}count(*) AS n FROM g {'GROUP BY ' + by if by else ''})"
    hit = f"(SELECT model, {key}count(ann_id) AS tp, count(*) - count(ann_id) AS fp FROM gm {group})"
    base = f"(SELECT * FROM {total}, (SELECT DISTINCT model FROM gm))"
    join = f"USING (model{', ' + by if by else ''})"
    x = f"SELECT model, {key}coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n, 0) - coalesce(tp, 0) AS fn FROM {base} FULL JOIN {hit} {join}"
    y = f"SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM ({x})"
    return f"SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM ({y})"


_GREEDY = SQL.rstrip() + "," + _match_sql("gm", ev.SCORE, f"[{ev.IOU}]", False)
_AP = (
    SQL.rstrip()
    + ","
    + _match_sql("am", 0.0, str([round(t, 2) for t in ev.AP_IOUS]) + "::DOUBLE[]", True)
    + """,
cum AS (SELECT model, class_id, t, sum((ann_id IS NOT NULL)::INT) OVER w AS tp, count(*) OVER w AS n FROM am WINDOW w AS (PARTITION BY model, class_id, t ORDER BY score DESC, image_id, pred_id ROWS UNBOUNDED PRECEDING)),
boxes AS (SELECT class_id, count(*) AS boxes FROM g GROUP BY 1),
top AS (SELECT model, class_id, t, tp * 100 // boxes AS k, max(tp / n) AS p FROM cum JOIN boxes USING (class_id) GROUP BY ALL),
pr AS (SELECT model, class_id, t, r.k, max(p) AS p FROM top, range(0, 101) r(k) WHERE top.k >= r.k GROUP BY ALL),
ap AS (SELECT model, class_id, t AS iou, coalesce(s, 0.0) AS ap FROM (SELECT * FROM (SELECT DISTINCT model FROM p), boxes, (SELECT DISTINCT t FROM am)) LEFT JOIN (SELECT model, class_id, t, sum(p) / 101 AS s FROM pr GROUP BY ALL) USING (model, class_id, t))
"""
)


def oracle_sql() -> dict:
    r = lambda c: f"round({c}, 6) AS {c}"
    numbers = ["tp", "fp", "fn", "precision", "recall", "f1"]
    prf = f"{', '.join(numbers[:3])}, {', '.join(map(r, numbers[3:]))}"
    delta = ", ".join(f"max({c}) FILTER (model = 'after') - max({c}) FILTER (model = 'before') AS {c}" for c in numbers)
    return {
        "iou_pairs": SQL + "SELECT model, image_id, ann_id, pred_id, round(iou, 6) AS iou FROM pairs",
        "greedy_match": _GREEDY + " SELECT model, image_id, class_id, pred_id, round(score, 6) AS score, ann_id, round(iou, 6) AS iou FROM gm",
        "prf_by_model": _GREEDY + f", x AS ({_prf_sql('')}) SELECT model, {prf} FROM (SELECT model, {', '.join(numbers)} FROM x UNION ALL SELECT 'delta', {delta} FROM x)",
        "prf_by_class": _GREEDY + f" SELECT model, class_id, {prf} FROM ({_prf_sql('class_id')})",
        "size_recall": _GREEDY + ", s AS (SELECT image_id, ann_id, CASE WHEN a < 0.001 THEN 'tiny' WHEN a < 0.01 THEN 'small' WHEN a < 0.05 THEN 'medium' ELSE 'large' END AS size FROM (SELECT *, (x2 - x1) * (y2 - y1) / 1e6 AS a FROM g)), c AS (SELECT mo.model, size, count(*) AS boxes, count(h.ann_id) AS found FROM s, (SELECT DISTINCT model FROM gm) mo LEFT JOIN (SELECT model, ann_id FROM gm WHERE ann_id IS NOT NULL) h ON h.model = mo.model AND h.ann_id = s.ann_id GROUP BY ALL) SELECT model, size, coalesce(boxes, 0) AS boxes, coalesce(found, 0) AS found, CASE WHEN boxes > 0 THEN round(found / boxes, 6) END AS recall FROM (SELECT * FROM (SELECT DISTINCT model FROM gm), (SELECT unnest(['tiny', 'small', 'medium', 'large']) AS size)) LEFT JOIN c USING (model, size)",
        "coco_ap": _AP + "SELECT model, class_id, iou, round(ap, 6) AS ap FROM ap",
        "coco_map": _AP + "SELECT model, round(avg(ap), 6) AS map50_95, round(avg(ap) FILTER (iou = 0.5), 6) AS map50, round(avg(ap) FILTER (iou = 0.75), 6) AS map75 FROM ap GROUP BY 1",
        "class_comparison": _AP + "SELECT class_id, round(avg(ap) FILTER (model = 'before'), 6) AS ap_before, round(avg(ap) FILTER (model = 'after'), 6) AS ap_after, round(avg(ap) FILTER (model = 'after') - avg(ap) FILTER (model = 'before'), 6) AS delta FROM ap GROUP BY 1",
    }
