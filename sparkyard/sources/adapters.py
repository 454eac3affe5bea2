"""Views that give generic test tables the shape of the domain's inputs; integer arithmetic only, so that any engine agrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkyard.functions.text import file_name, folded, path_text, split_name, strip_or_null
from sparkyard.sources.tables import table

RAW_LABELS = ("Excavator", "dump_truck", "Dumb Truck", "truck", "Bucket-Loader Big", "bull_dozer", "grader", "Compactor", "mixer", "forklift giraffe", "pile-driving", "crane manipulator", "Crane", "PumpTruck", "trailer", "unknown-thing")


def raw_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Label lines ``(image_id, line_no, raw_label, x, y, w, h)`` out of order lines."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_shipdate")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    w = F.when(F.col("l_partkey") % 97 == 0, 0.0).otherwise(F.col("l_quantity") / 100)
    x = F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity") / 200 - 0.0005).otherwise((F.col("l_partkey") % 1000) / 1000)
    return li.select(
        F.col("l_orderkey").alias("image_id"), F.row_number().over(order).alias("line_no"), F.element_at(F.array(*map(F.lit, RAW_LABELS)), (F.col("l_partkey") % 16 + 1).cast("int")).alias("raw_label"),
        x.alias("x"), ((F.col("l_suppkey") % 100) / 100).alias("y"), w.alias("w"), (F.col("l_discount") + 0.02).alias("h"),
    )


RAW_BOXES_SQL = f"""
raw_boxes AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS line_no,
  {list(RAW_LABELS)}[(l_partkey % 16 + 1)::INT] AS raw_label,
  CASE WHEN l_partkey % 5 = 0 THEN l_quantity / 200 - 0.0005 ELSE (l_partkey % 1000) / 1000 END AS x, (l_suppkey % 100) / 100 AS y,
  CASE WHEN l_partkey % 97 = 0 THEN 0.0 ELSE l_quantity / 100 END AS w, l_discount + 0.02 AS h FROM lineitem)
"""


def images(spark: SparkSession, d: str) -> DataFrame:
    """The valid row of each image of the manifest, its values in one spelling."""
    c = F.col
    row = F.max(F.struct("recorded_at", "loaded_at", "source", "split", "original_split", "original_image", "output_image", "sha1", "width", "height", "n_boxes", "classes", "raw_classes", "group_id"))
    now = table(spark, d, "manifest").groupBy("image_id").agg(row.alias("r")).select("image_id", "r.*")
    return now.select(
        "image_id", "source", split_name(c("split")).alias("split"), split_name(c("original_split")).alias("original_split"), path_text(c("original_image")).alias("original_image"),
        path_text(c("output_image")).alias("output_image"), file_name(c("output_image")).alias("image"), folded(c("sha1")).alias("sha1"), "width", "height", "n_boxes",
        strip_or_null(c("classes")).alias("classes"), strip_or_null(c("raw_classes")).alias("raw_classes"), folded(c("group_id")).alias("group_id"),
    )


def _images_sql() -> str:
    from sparkyard.functions import sql

    return f"""
images AS (SELECT image_id, source, {sql.split_name("split")} AS split, {sql.split_name("original_split")} AS original_split, {sql.path_text("original_image")} AS original_image,
  {sql.path_text("output_image")} AS output_image, {sql.file_name("output_image")} AS image, {sql.folded("sha1")} AS sha1, width, height, n_boxes, {sql.strip_or_null("classes")} AS classes,
  {sql.strip_or_null("raw_classes")} AS raw_classes, {sql.folded("group_id")} AS group_id
  FROM manifest QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY recorded_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1)
"""


IMAGES_SQL = _images_sql()
