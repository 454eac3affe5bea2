"""Queries over label lines and class statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkyard.functions import taxonomy as tx
from sparkyard.operators import labels, validate
from sparkyard.sources.adapters import IMAGES_SQL, RAW_BOXES_SQL, RAW_LABELS, images, raw_boxes

SOURCES, SPLITS = ["d1", "d6", "d7", "d8"], ["train", "val", "test"]


def _r(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _lines(s, d):
    """Label lines as text, some of them damaged, and the names of 14 of 16 class ids."""
    b = raw_boxes(s, d).select("image_id", "line_no", F.array_position(F.array(*map(F.lit, RAW_LABELS)), F.col("raw_label")).alias("cid"))
    n = F.col("image_id") + F.col("line_no")
    line = F.when(n % 11 == 0, F.concat_ws(" ", "cid", F.lit("0.5"), F.lit("0.5"))).when(n % 13 == 0, F.lit("x 0.5 0.5 0.1 0.1")).when(n % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "cid", F.lit(".9  0.5 0.25\t0.5 0."), F.col("line_no").cast("string")))
    names = s.createDataFrame(list(enumerate(RAW_LABELS[:14], 1)), "id int, name string")
    return labels.parse_label_lines(b.select("image_id", "line_no", line.alias("line")), names)


def _by_source(s, d):
    return labels.label_audit(raw_boxes(s, d).join(images(s, d).select("image_id", "source"), "image_id"), ("source",))


def _unreadable(s, d):
    """Every image of the manifest without a width or a height counts as unreadable."""
    return images(s, d).where("width IS NULL OR height IS NULL").select("image_id")


def _mismatches(s, d):
    """Boxes as the manifest states them against boxes counted anew, by source and split."""
    at = images(s, d)
    reported = at.groupBy("source", "split").agg(F.coalesce(F.sum("n_boxes"), F.lit(0)).alias("n")).where("source IS NOT NULL AND split IS NOT NULL")
    counted = labels.clean_boxes(raw_boxes(s, d)).join(at.select("image_id", "source", "split"), "image_id").where("source IS NOT NULL AND split IS NOT NULL").groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))
    return validate.stats_mismatch(reported, counted, ["source", "split"], "n")


def queries() -> dict:
    return {
        "label_lines": lambda s, d: _lines(s, d),
        "label_warnings": lambda s, d: labels.warning_counts(_lines(s, d)),
        "label_audit_by_source": _by_source,
        "exclusions_with_negatives": lambda s, d: labels.exclusions(raw_boxes(s, d), keep_negatives=True, invalid=_unreadable(s, d)),
        "pixel_truth": lambda s, d: _r(labels.pixel_boxes(labels.clean_boxes(raw_boxes(s, d)), images(s, d))),
        "stats_mismatches": _mismatches,
        "label_normalize": lambda s, d: labels.label_audit(raw_boxes(s, d)),
        "label_clean_boxes": lambda s, d: _r(labels.clean_boxes(raw_boxes(s, d))),
        "label_problems": lambda s, d: labels.with_actions(raw_boxes(s, d)).withColumn("problem", labels.box_problem()).groupBy("action", "problem").agg(F.count(F.lit(1)).alias("n")),
        "exclusion_reasons": lambda s, d: labels.exclusions(raw_boxes(s, d)),
        "class_stats_sparse": lambda s, d: labels.class_stats(labels.clean_boxes(raw_boxes(s, d)), images(s, d)),
        "class_stats_dense": lambda s, d: labels.dense_class_stats(labels.class_stats(labels.clean_boxes(raw_boxes(s, d)), images(s, d)), SOURCES, SPLITS),
        "class_totals": lambda s, d: labels.class_stats(labels.clean_boxes(raw_boxes(s, d)), images(s, d)).groupBy("class").agg(F.sum("bbox_count").alias("bbox_count")),
    }


_O = labels.OVERHANG
SQL = f"""
WITH {RAW_BOXES_SQL}, alias AS (SELECT * FROM {tx.sql_values(tx.alias_rows(), "label, class, action")}), {IMAGES_SQL},
acted AS (SELECT b.*, class, coalesce(action, 'UNKNOWN') AS action,
  CASE WHEN NOT coalesce(x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1, false) THEN 'out_of_range'
    WHEN x - w / 2 < -{_O} OR x + w / 2 > 1 + {_O} OR y - h / 2 < -{_O} OR y + h / 2 > 1 + {_O} THEN 'overhang' END AS problem
  FROM (SELECT *, {tx.SQL_NORMALIZE.format(c="raw_label")} AS label FROM raw_boxes) b LEFT JOIN alias USING (label)),
boxes AS (SELECT image_id, line_no, class,
  CASE WHEN cx THEN (greatest(x - w / 2, 0.0) + least(x + w / 2, 1.0)) / 2 ELSE x END AS x, CASE WHEN cy THEN (greatest(y - h / 2, 0.0) + least(y + h / 2, 1.0)) / 2 ELSE y END AS y,
  CASE WHEN cx THEN least(x + w / 2, 1.0) - greatest(x - w / 2, 0.0) ELSE w END AS w, CASE WHEN cy THEN least(y + h / 2, 1.0) - greatest(y - h / 2, 0.0) ELSE h END AS h
  FROM (SELECT *, x - w / 2 < 0 OR x + w / 2 > 1 AS cx, y - h / 2 < 0 OR y + h / 2 > 1 AS cy FROM acted WHERE action = 'MAP' AND problem IS NULL)),
stats AS (SELECT source, split, class, count(*) AS bbox_count FROM boxes JOIN images USING (image_id) GROUP BY ALL)
"""


def oracle_sql() -> dict:
    grid = f"(SELECT * FROM (SELECT unnest({SOURCES}) AS source), (SELECT unnest({SPLITS}) AS split), {tx.sql_values(list(enumerate(tx.CLASSES)), 'class_id, class')}) g"
    lines = SQL + f""", ln AS (SELECT image_id, line_no::INT AS line_no, cid, CASE WHEN (image_id + line_no) % 11 = 0 THEN 'field_count' WHEN (image_id + line_no) % 13 = 0 THEN 'not_numeric' WHEN (image_id + line_no) % 17 = 0 THEN 'blank' WHEN cid > 14 THEN 'unknown_class_id' END AS warning
      FROM (SELECT image_id, line_no, list_position({list(RAW_LABELS)}, raw_label) AS cid FROM raw_boxes)),
    pl AS (SELECT image_id, line_no, CASE WHEN cid <= 14 AND warning IS NULL THEN {list(RAW_LABELS)}[cid] END AS raw_label, CASE WHEN warning IS NULL THEN 0.5::DOUBLE END AS x, CASE WHEN warning IS NULL THEN 0.25::DOUBLE END AS y, CASE WHEN warning IS NULL THEN 0.5::DOUBLE END AS w, CASE WHEN warning IS NULL THEN ('0.' || line_no)::DOUBLE END AS h, warning FROM ln WHERE warning IS DISTINCT FROM 'blank')"""
    placed = "SELECT *, row_number() OVER (ORDER BY image_id, line_no)::INT AS ann_id FROM (SELECT image_id, line_no, class, width, height, greatest(0.0, (x - w / 2) * width) AS x1, greatest(0.0, (y - h / 2) * height) AS y1, least(width::DOUBLE, (x + w / 2) * width) AS x2, least(height::DOUBLE, (y + h / 2) * height) AS y2 FROM boxes JOIN images USING (image_id) WHERE width > 0 AND height > 0) WHERE x2 > x1 AND y2 > y1"
    return {
        "label_lines": lines + " SELECT * FROM pl",
        "label_warnings": lines + " SELECT warning, count(*) AS n FROM pl WHERE warning IS NOT NULL GROUP BY 1",
        "label_audit_by_source": SQL + "SELECT source, raw_label, any_value(label) AS label, count(*) AS bbox_count, any_value(CASE action WHEN 'MAP' THEN class WHEN 'DROP' THEN '' ELSE action END) AS mapped_to FROM acted JOIN images USING (image_id) GROUP BY 1, 2",
        "exclusions_with_negatives": SQL + ", bad AS (SELECT image_id FROM images WHERE width IS NULL OR height IS NULL), amb AS (SELECT image_id FROM acted GROUP BY 1 HAVING bool_or(action = 'AMBIGUOUS')) SELECT image_id, 'ambiguous_label' AS reason FROM amb UNION ALL SELECT image_id, 'invalid_image' FROM bad WHERE image_id NOT IN (SELECT image_id FROM amb)",
        "pixel_truth": SQL + f"SELECT image_id, ann_id, class, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round((x2 - x1) * (y2 - y1) / (width * height), 6) AS relative_area FROM ({placed})",
        "stats_mismatches": SQL + ", rep AS (SELECT source, split, coalesce(sum(n_boxes), 0)::BIGINT AS r FROM images WHERE source IS NOT NULL AND split IS NOT NULL GROUP BY ALL), cnt AS (SELECT source, split, count(*) AS c FROM boxes JOIN images USING (image_id) WHERE source IS NOT NULL AND split IS NOT NULL GROUP BY ALL) SELECT source, split, coalesce(r, 0) AS reported, coalesce(c, 0) AS counted FROM rep FULL JOIN cnt USING (source, split) WHERE coalesce(r, 0) <> coalesce(c, 0)",
        "label_normalize": SQL + "SELECT raw_label, any_value(label) AS label, count(*) AS bbox_count, any_value(CASE action WHEN 'MAP' THEN class WHEN 'DROP' THEN '' ELSE action END) AS mapped_to FROM acted GROUP BY 1",
        "label_clean_boxes": SQL + "SELECT image_id, line_no::INT AS line_no, class, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM boxes",
        "label_problems": SQL + "SELECT action, problem, count(*) AS n FROM acted GROUP BY ALL",
        "exclusion_reasons": SQL + "SELECT image_id, reason FROM (SELECT image_id, CASE WHEN bool_or(action = 'AMBIGUOUS') THEN 'ambiguous_label' WHEN NOT bool_or(action = 'MAP' AND problem IS NULL) THEN 'no_boxes' END AS reason FROM acted GROUP BY 1) WHERE reason IS NOT NULL",
        "class_stats_sparse": SQL + "SELECT * FROM stats",
        "class_stats_dense": SQL + f"SELECT source, split, class, class_id, coalesce(bbox_count, 0) AS bbox_count FROM {grid} LEFT JOIN stats USING (source, split, class)",
        "class_totals": SQL + "SELECT class, sum(bbox_count)::BIGINT AS bbox_count FROM stats GROUP BY 1",
    }
