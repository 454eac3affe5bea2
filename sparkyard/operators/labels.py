"""Label lines to clean boxes: aliases, drops, exclusions, range checks, clipping, and class statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkyard.functions.taxonomy import aliases, classes, normalize_label
from sparkyard.operators.ranking import row_numbers

OVERHANG = 1e-3


def parse_label_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Label text ``(image_id, line_no, line)`` as ``(image_id, line_no, raw_label, x, y, w, h, warning)``.

    A blank line gives no row. First that applies: not five fields, a field that is no number, an id that ``names``
    (``id``, ``name``) doesn't have. An id of 3.9 is 3. Rows with a warning have null values.
    """
    f = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    n = [F.try_element_at(f, F.lit(i + 1)).try_cast("double") for i in range(5)]
    x = lines.where(F.trim("line") != "").select("image_id", "line_no", F.size(f).alias("fields"), *(v.alias(k) for v, k in zip(n, ["cid", "x", "y", "w", "h"])))
    bad = F.coalesce(*(F.when(F.col(k).isNull(), F.lit(True)) for k in ["cid", "x", "y", "w", "h"]), F.lit(False))
    x = x.withColumn("warning", F.when(F.col("fields") != 5, "field_count").when(bad, "not_numeric"))
    x = x.withColumn("id", F.when(F.col("warning").isNull() & ~F.isnan("cid") & (F.abs("cid") < 1e9), F.col("cid").cast("int")))
    x = x.join(F.broadcast(names.select("id", F.col("name").alias("raw_label"))), "id", "left")
    warning = F.when(F.col("warning").isNull() & F.col("raw_label").isNull(), "unknown_class_id").otherwise(F.col("warning"))
    return x.withColumn("warning", warning).select("image_id", "line_no", "raw_label", *(F.when(F.col("warning").isNull(), F.col(k)).alias(k) for k in "xywh"), "warning")


def with_actions(boxes: DataFrame) -> DataFrame:
    """Adds ``label``, ``class`` and ``action``: MAP, DROP, AMBIGUOUS or UNKNOWN. The alias list is fixed and small."""
    known = aliases(boxes.sparkSession).withColumnRenamed("alias", "label")
    return boxes.withColumn("label", normalize_label(F.col("raw_label"))).join(F.broadcast(known), "label", "left").withColumn("action", F.coalesce("action", F.lit("UNKNOWN")))


def label_audit(boxes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Boxes per raw label, and per ``by`` such as the source, with what became of them; a dropped class maps to nothing."""
    counted = boxes.groupBy(*by, "raw_label").agg(F.count(F.lit(1)).alias("bbox_count"))
    mapped = F.when(F.col("action") == "MAP", F.col("class")).when(F.col("action") == "DROP", "").otherwise(F.col("action"))
    return with_actions(counted).select(*by, "raw_label", "label", "bbox_count", mapped.alias("mapped_to"))


def box_problem() -> Column:
    """First that applies: centre or size out of range (NaN too), an edge more than ``OVERHANG`` outside."""
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1) & (F.col("w") > 0) & (F.col("w") <= 1) & (F.col("h") > 0) & (F.col("h") <= 1)
    over = lambda c, s: (F.col(c) - F.col(s) / 2 < -OVERHANG) | (F.col(c) + F.col(s) / 2 > 1 + OVERHANG)
    return F.when(~F.coalesce(inside, F.lit(False)), "out_of_range").when(over("x", "w") | over("y", "h"), "overhang")


def clean_boxes(boxes: DataFrame) -> DataFrame:
    """The mapped boxes that are in range, clipped to the image; sizes are computed anew only where an edge was clipped."""
    kept = with_actions(boxes).where("action = 'MAP'").where(box_problem().isNull())
    for c, s in (("x", "w"), ("y", "h")):
        low, high = F.col(c) - F.col(s) / 2, F.col(c) + F.col(s) / 2
        a, b = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
        clipped = (a != low) | (b != high)
        kept = kept.withColumn("$c", F.when(clipped, (a + b) / 2).otherwise(F.col(c))).withColumn(s, F.when(clipped, b - a).otherwise(F.col(s))).withColumn(c, F.col("$c")).drop("$c")
    return kept.select("image_id", "line_no", "class", "x", "y", "w", "h")


def exclusions(boxes: DataFrame, keep_negatives: bool = False, invalid: DataFrame | None = None) -> DataFrame:
    """``(image_id, reason)`` of the images left out: any ambiguous label, else no clean box, else unreadable. One aggregation by image.

    With ``keep_negatives`` images without a box stay. ``invalid`` has the ``image_id`` of the images that couldn't be read, and of none twice.
    """
    x = with_actions(boxes).withColumn("good", (F.col("action") == "MAP") & box_problem().isNull())
    seen = x.groupBy("image_id").agg(F.bool_or(F.col("action") == "AMBIGUOUS").alias("ambiguous"), F.bool_or("good").alias("any_box"))
    empty = ~F.col("any_box") & F.lit(not keep_negatives)
    if invalid is not None:
        seen = seen.join(invalid.select("image_id", F.lit(True).alias("invalid")).distinct(), "image_id", "full")
    reason = F.when(F.col("ambiguous"), "ambiguous_label").when(empty, "no_boxes")
    reason = reason if invalid is None else reason.when(F.col("invalid"), "invalid_image")
    return seen.select("image_id", reason.alias("reason")).where("reason IS NOT NULL")


def warning_counts(parsed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Label lines per warning, and per ``by``; lines without one aren't counted."""
    return parsed.where("warning IS NOT NULL").groupBy(*by, "warning").agg(F.count(F.lit(1)).alias("n"))


def pixel_boxes(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """``(image_id, ann_id, class, x1, y1, x2, y2, relative_area)``: clean boxes as corners in pixels, clipped to the image; empty ones are left out.

    ``images`` has ``image_id, width, height``; without sizes a box isn't placed. ``relative_area`` is the box's share of the image. Ids run from 1 over images and lines.
    """
    c = F.col
    x = boxes.join(images.select("image_id", "width", "height").where("width > 0 AND height > 0"), "image_id")
    low = lambda p, s, n: F.greatest(F.lit(0.0), (c(p) - c(s) / 2) * c(n))
    high = lambda p, s, n: F.least(c(n).cast("double"), (c(p) + c(s) / 2) * c(n))
    x = x.select("image_id", "line_no", "class", "width", "height", low("x", "w", "width").alias("x1"), low("y", "h", "height").alias("y1"), high("x", "w", "width").alias("x2"), high("y", "h", "height").alias("y2")).where("x2 > x1 AND y2 > y1")
    x = x.withColumn("relative_area", (c("x2") - c("x1")) * (c("y2") - c("y1")) / (c("width") * c("height")))
    return row_numbers(x, [], [F.asc("image_id"), F.asc("line_no")], "ann_id").select("image_id", "ann_id", "class", "x1", "y1", "x2", "y2", "relative_area")


def class_stats(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes per source, split and class; combinations without a box are missing."""
    at = images.select("image_id", "source", "split")
    return boxes.join(at, "image_id").groupBy("source", "split", "class").agg(F.count(F.lit(1)).alias("bbox_count"))


def dense_class_stats(sparse: DataFrame, sources: list[str], splits: list[str]) -> DataFrame:
    """The same with a row, of 0 where there is none, for each given source and split and each canonical class."""
    spark = sparse.sparkSession
    grid = spark.createDataFrame([(s, p) for s in sources for p in splits], "source string, split string").join(F.broadcast(classes(spark)), F.lit(True))
    return grid.join(sparse, ["source", "split", "class"], "left").select("source", "split", "class", "class_id", F.coalesce("bbox_count", F.lit(0)).alias("bbox_count"))
