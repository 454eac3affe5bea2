"""Detections against ground truth: IoU, greedy one-to-one matching, precision and recall, average precision, recall by size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkyard.session import Scratch

IOU, SCORE = 0.5, 0.25
# The protocol's IoU thresholds, recall steps and detections per image and class.
AP_IOUS, RECALLS, MAX_DETECTIONS = [0.5 + 0.05 * i for i in range(10)], 101, 100
#: Score steps over which cumulative counts are first summed, so that no class is sorted in one task.
STEPS = 1000


def iou(a: Column, b: Column) -> Column:
    """Of two structs ``x1, y1, x2, y2``; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: F.greatest(F.lit(0.0), r["x2"] - r["x1"]) * F.greatest(F.lit(0.0), r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def _box() -> Column:
    return F.struct(*(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))


def _per_image(gt: DataFrame, pred: DataFrame, top: int | None = None) -> DataFrame:
    """One row per model, image and class with its predictions, best score first, and its boxes; both are as many as one image has."""
    n = int(gt.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # both sides alike: the join moves nothing, and matching gets all cores
    pred, gt = (x.repartition(n, "image_id", "class_id") for x in (pred, gt))
    p = pred.where(~F.isnan("score")).groupBy("model", "image_id", "class_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pred_id", _box().alias("box")))).alias("preds"))
    if top:
        p = p.withColumn("preds", F.slice("preds", 1, top))
    g = gt.groupBy("image_id", "class_id").agg(F.array_sort(F.collect_list(F.struct("ann_id", _box().alias("box")))).alias("gts"))
    return p.join(g, ["image_id", "class_id"], "left").withColumn("gts", F.coalesce("gts", F.array().cast(g.schema["gts"].dataType)))


def _match(least: Column) -> Column:
    """Each prediction takes, best score first, the free box with the greatest IoU, if that is ``least`` at least; of equal ones the first by id."""
    none = F.lit(None).cast("bigint")
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<pred_id:bigint,score:double,ann_id:bigint,iou:double>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        free = F.filter("gts", lambda g: ~F.array_contains(acc["used"], g["ann_id"]))
        best = F.array_max(F.transform(free, lambda g: F.struct(iou(p["box"], g["box"]).alias("iou"), (-g["ann_id"]).alias("o"), g["ann_id"].alias("ann_id"))))
        hit = best["iou"] >= least
        found = F.struct(p["pred_id"].alias("pred_id"), (-p["s"]).alias("score"), F.when(hit, best["ann_id"]).otherwise(none).alias("ann_id"), F.when(hit, best["iou"]).alias("iou"))
        return F.struct(F.when(hit, F.concat(acc["used"], F.array(best["ann_id"]))).otherwise(acc["used"]).alias("used"), F.concat(acc["out"], F.array(found)).alias("out"))

    return F.aggregate("preds", start, step)["out"]


def greedy_match(gt: DataFrame, pred: DataFrame, least_iou: float = IOU, least_score: float = SCORE) -> DataFrame:
    """``(model, image_id, class_id, pred_id, score, ann_id, iou)`` of every prediction of at least that score; ``ann_id`` is null for a false positive.

    ``gt``: image_id, class_id, ann_id, x1, y1, x2, y2; ``pred``: model, image_id, class_id, pred_id, score, x1, y1, x2, y2; ids are bigints.
    Equal scores go by ``pred_id``, equal IoU to the smaller ``ann_id``; a null or NaN score is no prediction.
    """
    x = _per_image(gt, pred.where(F.col("score") >= least_score))
    return x.select("model", "image_id", "class_id", F.explode(_match(F.lit(least_iou))).alias("m")).select("model", "image_id", "class_id", "m.*")


def _match_at(images: DataFrame, least: list[float]) -> DataFrame:
    """Every prediction with its hit or miss at each of several IoUs, in one pass over Arrow batches: the matchings of an image share its IoUs.

    Works on the flat arrays of a batch: all pairs of a prediction and a box of one image and class, their IoUs at once. Pairs under the least
    threshold can't match; an image whose pairs are all of different predictions and boxes is matched by comparing, others one by one.
    """

    def boxes(x: pa.ListArray) -> np.ndarray:
        box = x.flatten().field("box")
        return np.stack([box.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            preds, gts = b.column("preds"), b.column("gts")
            n_p, n_g = (pa.compute.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (preds, gts))
            owner = np.repeat(np.arange(b.num_rows), n_p)
            # pairs: for each prediction all boxes of its image
            many = n_g[owner]
            p = np.repeat(np.arange(len(owner)), many)
            nth = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
            g = (np.cumsum(n_g) - n_g)[owner][p] + nth
            pb, gb = boxes(preds)[:, p], boxes(gts)[:, g]
            w = np.maximum(0.0, np.minimum(pb[2], gb[2]) - np.maximum(pb[0], gb[0]))
            h = np.maximum(0.0, np.minimum(pb[3], gb[3]) - np.maximum(pb[1], gb[1]))
            area = lambda x: np.maximum(0.0, x[2] - x[0]) * np.maximum(0.0, x[3] - x[1])
            union = area(pb) + area(gb) - w * h
            over = np.divide(w * h, union, out=np.zeros(len(p)), where=union > 0)
            near = np.flatnonzero(over >= least[0])
            p, g, over = p[near], g[near], over[near]
            hits = np.zeros((len(owner), len(least)), bool)
            alone = (np.bincount(p, minlength=len(owner))[p] == 1) & (np.bincount(g, minlength=int(n_g.sum()))[g] == 1)
            hits[p[alone]] = over[alone, None] >= np.array(least)
            crowd: dict[int, list[tuple[int, float]]] = {}
            for i, j, o in zip(p[~alone].tolist(), g[~alone].tolist(), over[~alone].tolist()):
                crowd.setdefault(i, []).append((j, o))
            for k, t in enumerate(least):
                used: set[int] = set()
                for i, near_boxes in crowd.items():  # predictions in the order of their scores
                    best = max(((o, j) for j, o in near_boxes if o >= t and j not in used), default=None)  # of equal ones the last
                    if best:
                        hits[i, k] = True
                        used.add(best[1])
            flat, rows = preds.flatten(), pa.array(owner)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32) * len(least)), pa.array(hits.reshape(-1)))
            columns = [b.column("model").take(rows), b.column("class_id").take(rows), b.column("image_id").take(rows), flat.field("pred_id"), pa.compute.negate(flat.field("s")), lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _FLAGS)], _FLAGS.names)

    return images.select("model", "class_id", "image_id", "preds", "gts").mapInArrow(run, "model string, class_id int, image_id bigint, pred_id bigint, score double, hits array<boolean>")


_FLAGS = pa.schema([("model", pa.string()), ("class_id", pa.int32()), ("image_id", pa.int64()), ("pred_id", pa.int64()), ("score", pa.float64()), ("hits", pa.list_(pa.bool_()))])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def precision_recall(gt: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 per model and ``by``; 0 where a ratio has no base. Boxes that no model saw count as missed by each."""
    models = matches.select("model").distinct()
    all_gt = gt.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else gt.agg(F.count(F.lit(1)).alias("n"))
    base = models.join(F.broadcast(all_gt), F.lit(True)) if not by else all_gt.join(F.broadcast(models), F.lit(True))
    hit = matches.groupBy("model", *by).agg(F.count("ann_id").alias("tp"), (F.count(F.lit(1)) - F.count("ann_id")).alias("fp"))
    x = base.join(hit, ["model", *by], "full").na.fill(0, ["n", "tp", "fp"]).withColumn("fn", F.col("n") - F.col("tp")).drop("n")
    x = x.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return x.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def size_bin(area: Column) -> Column:
    return F.when(area < 0.001, "tiny").when(area < 0.01, "small").when(area < 0.05, "medium").otherwise("large")


def size_recall(gt: DataFrame, matches: DataFrame) -> DataFrame:
    """Recall per model and size of the boxes (``relative_area``); null for a size without boxes."""
    models = matches.select("model").distinct()
    found = matches.where("ann_id IS NOT NULL").select("model", "image_id", "ann_id").withColumn("hit", F.lit(1))
    x = gt.select("image_id", "ann_id", size_bin(F.col("relative_area")).alias("size")).join(F.broadcast(models), F.lit(True)).join(found, ["model", "image_id", "ann_id"], "left")
    sizes = gt.sparkSession.createDataFrame([(s,) for s in ("tiny", "small", "medium", "large")], "size string").join(F.broadcast(models), F.lit(True))
    got = x.groupBy("model", "size").agg(F.count(F.lit(1)).alias("boxes"), F.count("hit").alias("found"))
    return sizes.join(got, ["model", "size"], "left").na.fill(0, ["boxes", "found"]).withColumn("recall", F.when(F.col("boxes") > 0, F.col("found") / F.col("boxes")))


def average_precision(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """``(model, class_id, iou, ap)`` of every class with ground truth, for IoU 0.50 to 0.95.

    Per image and class the best 100 predictions are matched at each IoU; over all images precision and recall run along the scores,
    precision is made monotone and read at 101 recalls. Running counts are summed over steps of the score first, then within each step.
    """
    ious = [round(t, 2) for t in AP_IOUS]
    flags = _match_at(_per_image(gt, pred, MAX_DETECTIONS), ious)
    # the order of the predictions is that of all IoUs: one sort, with a count for each
    step = -F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))) * STEPS).cast("int")
    m = flags.select("model", "class_id", "image_id", "pred_id", "score", step.alias("step"), *(F.col("hits")[i].cast("int").alias(f"h{i}") for i in range(len(ious))))
    m = Scratch(gt.sparkSession, "average-precision").save(m)  # read twice below
    keys, per = ["model", "class_id", "least"], ["model", "class_id"]
    sums = m.groupBy(*per, "step").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"h{i}").alias(f"s{i}") for i in range(len(ious))))
    before = Window.partitionBy(*per).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # at most STEPS + 1 rows
    sums = sums.select(*per, "step", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in ["n", *(f"s{i}" for i in range(len(ious)))]))
    run = Window.partitionBy(*per, "step").orderBy(F.desc("score"), "image_id", "pred_id").rowsBetween(Window.unboundedPreceding, 0)
    total = gt.groupBy("class_id").agg(F.count(F.lit(1)).alias("boxes"))
    count = m.select("*", F.count(F.lit(1)).over(run).alias("n"), *(F.sum(f"h{i}").over(run).alias(f"t{i}") for i in range(len(ious))))
    pts = count.join(sums, [*per, "step"]).join(F.broadcast(total), "class_id")
    at = F.array(*(F.struct(F.lit(t).alias("least"), (F.col(f"s{i}_0") + F.col(f"t{i}")).alias("t")) for i, t in enumerate(ious)))
    pts = pts.select(*per, "boxes", (F.col("n_0") + F.col("n")).alias("n"), F.explode(at).alias("at")).select(*per, "boxes", "n", "at.*")
    # the highest of the 101 recalls that a point reaches, in whole numbers: t / boxes >= k / 100
    reach = pts.withColumn("k", F.floor(F.col("t") * (RECALLS - 1) / F.col("boxes") + 1e-9).cast("int")).groupBy(*keys, "k").agg(F.max(F.col("t") / F.col("n")).alias("p"))
    after = Window.partitionBy(*keys).orderBy("k").rowsBetween(0, Window.unboundedFollowing)  # at most 101 rows
    best = reach.withColumn("p", F.max("p").over(after)).withColumn("prev", F.coalesce(F.lag("k").over(Window.partitionBy(*keys).orderBy("k")), F.lit(-1)))
    ap = best.groupBy(*keys).agg((F.sum(F.col("p") * (F.col("k") - F.col("prev"))) / RECALLS).alias("ap"))
    models = pred.select("model").distinct()
    spark = gt.sparkSession
    grid = total.select("class_id").join(F.broadcast(models), F.lit(True)).join(F.broadcast(spark.createDataFrame([(t,) for t in ious], "least double")), F.lit(True))
    return grid.join(ap, keys, "left").select("model", "class_id", F.col("least").alias("iou"), F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_ap(ap: DataFrame) -> DataFrame:
    """mAP over all IoUs, at 0.50 and at 0.75, per model."""
    at = lambda t: F.avg(F.when(F.abs(F.col("iou") - t) < 1e-6, F.col("ap")))
    return ap.groupBy("model").agg(F.avg("ap").alias("map50_95"), at(0.5).alias("map50"), at(0.75).alias("map75"))


def with_delta(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """The metric rows of the models and one more, ``delta``: second minus first."""
    numbers = [c for c in metrics.columns if c != "model"]
    at = lambda m: F.struct(*(F.max(F.when(F.col("model") == m, F.col(c))).alias(c) for c in numbers))
    d = metrics.agg(at(first).alias("a"), at(second).alias("b")).select(F.lit("delta").alias("model"), *((F.col(f"b.{c}") - F.col(f"a.{c}")).alias(c) for c in numbers))
    return metrics.select("model", *numbers).unionByName(d)


def class_comparison(ap: DataFrame, first: str, second: str) -> DataFrame:
    """AP per class beside each other, least gain first."""
    at = lambda m: F.avg(F.when(F.col("model") == m, F.col("ap"))).alias(f"ap_{m}")
    return ap.groupBy("class_id").agg(at(first), at(second)).withColumn("delta", F.col(f"ap_{second}") - F.col(f"ap_{first}")).where("delta IS NOT NULL").orderBy("delta", "class_id")
