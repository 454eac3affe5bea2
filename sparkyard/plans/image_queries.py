"""Queries over the images of the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkyard.functions import names as nm
from sparkyard.operators import dedup, labels, validate
from sparkyard.operators.ranking import row_numbers
from sparkyard.sources.adapters import IMAGES_SQL, images, raw_boxes


#: How many images a finished data set should have in each split.
EXPECTED = {"train": 1000, "val": 300, "test": 100, "extra": 0}


def _named(s, d):
    x = images(s, d).withColumn("stem", nm.stem(F.col("original_image")))
    return x.withColumn("g", nm.group_of(F.col("source"), F.col("stem"))).select("*", F.col("g.group_id").alias("file_group"), F.col("g.method").alias("method")).drop("g")


def _groups(s, d):
    n = F.count(F.lit(1)).alias("image_count")
    lists = [F.array_join(F.array_sort(F.collect_set(c)), ";").alias(f"{c}s") for c in ("original_split", "split")]
    return _named(s, d).where("file_group IS NOT NULL").groupBy("source", F.col("file_group").alias("group_id"), "method").agg(n, *lists)


def _frames(s, d):
    p, q = F.col("original_image"), F.col("output_image")
    return _named(s, d).select(
        "image_id", "stem", nm.family(F.col("stem")).alias("family"), nm.sequence_number(F.col("stem")).alias("number"), nm.frame_number(p).alias("frame"), nm.split_of_path(q).alias("path_split"), nm.moved_path(q, F.lit("test")).alias("moved"), nm.safe_name(F.col("source"), p, F.col("sha1")).alias("safe_name")
    )


def _top(s, d):
    """Page and place of the 100 images with most boxes of each source."""
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("n_boxes"), "image_id")
    x = images(s, d).select("source", "image_id", "n_boxes", F.row_number().over(w).alias("review_rank")).where("review_rank <= 100")
    return x.withColumn("page", F.floor((F.col("review_rank") - 1) / 20))


def _sample(s, d):
    """A sample that stays the same: the first 200 by the digest of the digest."""
    return images(s, d).where("sha1 IS NOT NULL AND array_contains(split(classes, ';'), 'excavator')").select("image_id", "sha1").orderBy(F.sha1("sha1"), "image_id").limit(200)


def _reconcile(s, d):
    """Stated numbers of boxes against the class lists: at least one box for each class, and a class if there is a box."""
    stated = images(s, d).select("image_id", "n_boxes", F.when(F.col("classes").isNull(), 0).otherwise(F.size(F.array_distinct(F.split("classes", ";")))).alias("n_classes"))
    return stated.groupBy("n_boxes", "n_classes", F.expr("n_boxes >= n_classes AND (n_classes > 0 OR n_boxes = 0)").alias("agrees")).agg(F.count(F.lit(1)).alias("n"))


_ORDER = {"train": 0, "val": 1, "test": 2}


def _ordered(s, d):
    """The place of each image in the order of a build (split by name) and in that after remediation (train, val, test)."""
    at = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).when(F.col("split") == "test", 2).otherwise(3)
    x = row_numbers(images(s, d), [], [F.asc_nulls_first(c) for c in ("split", "source", "original_image", "image_id")], "built_at")
    x = row_numbers(x, [], [at.asc(), *(F.asc_nulls_first(c) for c in ("source", "output_image", "image_id"))], "remediated_at")
    return x.select("image_id", "built_at", "remediated_at")


#: Classes that a closer look is taken at.
FOCUS = ["crane_manipulator", "mobile_crane", "tower_crane"]


def _overlap(s, d):
    at = images(s, d)
    return validate.shared_keys({p: at.where(F.col("split") == p) for p in ("train", "val", "test")}, "sha1")


def queries() -> dict:
    return {
        "manifest_order": _ordered,
        "focus_images": lambda s, d: images(s, d).where(F.arrays_overlap(F.split("classes", ";"), F.array(*map(F.lit, FOCUS)))).select("image_id", "split", "classes"),
        "split_overlap": _overlap,
        "count_problems": lambda s, d: validate.count_problems(images(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n")), EXPECTED, "split", "n"),
        "image_counts": lambda s, d: images(s, d).groupBy("source", "split").agg(F.count(F.lit(1)).alias("images"), F.sum("n_boxes").alias("boxes")),
        "possible_pairs": lambda s, d: _possible(images(s, d)),
        "filename_groups": _groups,
        "filename_methods": lambda s, d: _named(s, d).groupBy("source", F.coalesce("method", F.lit("unrecovered")).alias("method")).agg(F.count(F.lit(1)).alias("image_count")),
        "filename_frames": _frames,
        "manifest_top_pages": _top,
        "stable_sample": _sample,
        "stats_reconcile": _reconcile,
        "exact_dedup_report": lambda s, d: dedup.duplicate_report(images(s, d)),
        "exact_dedup_kept": lambda s, d: dedup.deduplicate(images(s, d)).groupBy("source", "split").agg(F.count(F.lit(1)).alias("images")),
        "exact_dedup_boxes": lambda s, d: dedup.merged_boxes(images(s, d), labels.clean_boxes(raw_boxes(s, d))).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("x", 6).cast("decimal(20,6)")).cast("double").alias("sum_x")),
        "leak_exact": lambda s, d: dedup.shared_across_splits(images(s, d), ["sha1"]),
        "leak_group": lambda s, d: dedup.shared_across_splits(images(s, d), ["group_id"]),
        "leak_base": lambda s, d: dedup.shared_across_splits(_named(s, d).withColumn("base", F.lower("stem")), ["source", "base"]),
    }


def _possible(x):
    """Per source the number of pairs of images of different splits."""
    n = x.where("split IN ('train', 'val', 'test')").groupBy("source").agg(*(F.count(F.when(F.col("split") == p, 1)).alias(p) for p in ("train", "val", "test")))
    return n.select("source", (F.col("train") * F.col("val") + F.col("train") * F.col("test") + F.col("val") * F.col("test")).alias("possible_pairs"))


_BASE = "regexp_extract({c}, '[^/\\\\]*$')"
_STEM = f"regexp_replace(regexp_replace(regexp_replace({_BASE.format(c='original_image')}, '(.)\\.[^.]*$', '\\1'), '\\.rf\\.[0-9a-f]+$', '', 'i'), '_(?:jpg|jpeg|png)$', '', 'i')"


def _x(p, i):
    return f"regexp_extract(stem, '{p}', {i})"


_GROUP = f"""CASE WHEN source = 'd1' AND regexp_matches(stem, '{nm.D1_CAMERA}') THEN ['d1:camera=' || lower({_x(nm.D1_CAMERA, 1)}) || ':date=' || {_x(nm.D1_CAMERA, 2)}, 'd1_camera_and_date']
  WHEN source = 'd1' AND regexp_matches(stem, '^\\d+_') AND regexp_matches(stem, '{nm.D1_DATE}') THEN ['d1:camera=' || split_part(stem, '_', 1) || ':date=' || {_x(nm.D1_DATE, 1)}, 'd1_camera_and_date']
  WHEN source = 'd8' AND regexp_matches(stem, '{nm.D8_CC}') THEN ['d8:' || lower({_x(nm.D8_CC, 1)}) || ':date=' || {_x(nm.D8_CC, 2)}, 'd8_cc_camera_and_date']
  WHEN source = 'd8' AND regexp_matches(stem, '{nm.D8_FLIGHT}') THEN ['d8:' || lower({_x(nm.D8_FLIGHT, 1)}), 'd8_explicit_flight']
  WHEN source = 'd8' AND regexp_matches(stem, '{nm.D8_DJI}') THEN ['d8:dji_numbered_series', 'd8_dji_numbered_series']
  WHEN source = 'd6' AND regexp_matches(stem, '{nm.D6_SERIES}') THEN ['d6:ezgif-frame', 'd6_explicit_frame_series'] END"""
SQL = f"""
WITH {IMAGES_SQL}, stems AS (SELECT *, {_STEM} AS stem FROM images),
named AS (SELECT *, g[1] AS file_group, g[2] AS method FROM (SELECT *, {_GROUP} AS g FROM stems))
"""
_RANK = "row_number() OVER (PARTITION BY sha1 ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 WHEN 'train' THEN 2 ELSE 3 END, CASE source WHEN 'd1' THEN 0 WHEN 'd6' THEN 1 WHEN 'd7' THEN 2 WHEN 'd8' THEN 3 ELSE 4 END, original_image NULLS FIRST, image_id)"


def _leak(keys: str, table: str) -> str:
    at = f"SELECT bool_or(split = 'train') AS tr, bool_or(split = 'val') AS va, bool_or(split = 'test') AS te FROM {table} WHERE {' AND '.join(k + ' IS NOT NULL' for k in keys.split(', '))} GROUP BY {keys}"
    one = "SELECT '{0}' AS split_a, '{1}' AS split_b, count(*) FILTER ({2} AND {3}) AS n FROM spl"
    return SQL + f", spl AS ({at}) " + " UNION ALL ".join(one.format(*x) for x in (("train", "val", "tr", "va"), ("train", "test", "tr", "te"), ("val", "test", "va", "te")))


def oracle_sql() -> dict:
    from sparkyard.plans import label_queries

    boxes = label_queries.SQL + f", ranked AS (SELECT *, {_RANK} AS rn FROM images WHERE sha1 IS NOT NULL), kept AS (SELECT sha1, image_id AS kept_id FROM ranked WHERE rn = 1), owner AS (SELECT image_id, coalesce(kept_id, image_id) AS kept_id FROM images LEFT JOIN kept USING (sha1)), m AS (SELECT class, arg_max(x, (image_id, line_no)) AS x FROM boxes JOIN owner USING (image_id) GROUP BY kept_id, class, round(boxes.x, 6), round(y, 6), round(w, 6), round(h, 6)) "
    at = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 3 END"
    return {
        "manifest_order": SQL + f"SELECT image_id, row_number() OVER (ORDER BY split NULLS FIRST, source NULLS FIRST, original_image NULLS FIRST, image_id)::INT AS built_at, row_number() OVER (ORDER BY {at}, source NULLS FIRST, output_image NULLS FIRST, image_id)::INT AS remediated_at FROM images",
        "focus_images": SQL + f"SELECT image_id, split, classes FROM images WHERE list_has_any(string_split(classes, ';'), {FOCUS})",
        "split_overlap": SQL + "SELECT sha1 AS key, string_agg(DISTINCT split, ';' ORDER BY split) AS tables FROM images WHERE sha1 IS NOT NULL AND split IN ('train', 'val', 'test') GROUP BY 1 HAVING count(DISTINCT split) > 1",
        "count_problems": SQL + f"SELECT e.split, expected::BIGINT AS expected, coalesce(n, 0) AS counted FROM (VALUES {', '.join(str(x) for x in EXPECTED.items())}) e(split, expected) LEFT JOIN (SELECT split, count(*) AS n FROM images GROUP BY 1) i ON i.split = e.split WHERE expected <> coalesce(n, 0)",
        "image_counts": SQL + "SELECT source, split, count(*) AS images, sum(n_boxes)::BIGINT AS boxes FROM images GROUP BY ALL",
        "possible_pairs": SQL + ", n AS (SELECT source, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b, count(*) FILTER (split = 'test') AS c FROM images WHERE split IN ('train', 'val', 'test') GROUP BY 1) SELECT source, a * b + a * c + b * c AS possible_pairs FROM n",
        "filename_groups": SQL + "SELECT source, file_group AS group_id, method, count(*) AS image_count, coalesce(string_agg(DISTINCT original_split, ';' ORDER BY original_split), '') AS original_splits, coalesce(string_agg(DISTINCT split, ';' ORDER BY split), '') AS splits FROM named WHERE file_group IS NOT NULL GROUP BY ALL",
        "filename_methods": SQL + "SELECT source, coalesce(method, 'unrecovered') AS method, count(*) AS image_count FROM named GROUP BY ALL",
        "filename_frames": SQL + f"SELECT image_id, stem, CASE WHEN regexp_matches(stem, '\\d$') THEN lower(rtrim(regexp_extract(stem, '{nm.TRAILING}', 1), '_-.')) END AS family, try_cast(nullif(regexp_extract(stem, '{nm.TRAILING}', 2), '') AS BIGINT) AS number, try_cast(nullif(regexp_extract({_BASE.format(c='original_image')}, '{nm.FRAME}', 1), '') AS BIGINT) AS frame, CASE WHEN len(p) >= 4 THEN p[2] END AS path_split, CASE WHEN len(p) >= 4 THEN array_to_string(list_concat([p[1], 'test'], p[3:]), '/') END AS moved, source || '_' || left(regexp_replace(regexp_replace(b, '(.)\\.[^.]*$', '\\1'), '[^A-Za-z0-9._-]+', '_', 'g'), 100) || '_' || left(sha1, 10) || lower(regexp_extract(b, '.(\\.[^.]*)$', 1)) AS safe_name FROM (SELECT *, string_split(output_image, '/') AS p, {_BASE.format(c='original_image')} AS b FROM stems)",
        "manifest_top_pages": SQL + "SELECT source, image_id, n_boxes, review_rank::INT AS review_rank, (review_rank - 1) // 20 AS page FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_boxes DESC NULLS LAST, image_id) AS review_rank FROM images) WHERE review_rank <= 100",
        "stable_sample": SQL + "SELECT image_id, sha1 FROM images WHERE sha1 IS NOT NULL AND list_contains(string_split(classes, ';'), 'excavator') ORDER BY sha1(sha1), image_id LIMIT 200",
        "stats_reconcile": SQL + "SELECT n_boxes, n_classes, n_boxes >= n_classes AND (n_classes > 0 OR n_boxes = 0) AS agrees, count(*) AS n FROM (SELECT n_boxes, CASE WHEN classes IS NULL THEN 0 ELSE len(list_distinct(string_split(classes, ';')))::INT END AS n_classes FROM images) GROUP BY ALL",
        "exact_dedup_report": SQL + f", ranked AS (SELECT *, {_RANK} AS rn FROM images WHERE sha1 IS NOT NULL) SELECT sha1, any_value(image_id) FILTER (rn = 1) AS kept_image_id, any_value(source) FILTER (rn = 1) AS kept_source, any_value(split) FILTER (rn = 1) AS kept_split, any_value(original_image) FILTER (rn = 1) AS kept_image, count(*) AS copies, coalesce(string_agg(DISTINCT source, ';' ORDER BY source), '') AS all_sources, coalesce(string_agg(DISTINCT split, ';' ORDER BY split), '') AS all_splits FROM ranked GROUP BY 1 HAVING count(*) > 1",
        "exact_dedup_kept": SQL + f"SELECT source, split, count(*) AS images FROM (SELECT *, CASE WHEN sha1 IS NULL THEN 1 ELSE {_RANK} END AS rn FROM images) WHERE rn = 1 GROUP BY ALL",
        "exact_dedup_boxes": boxes + "SELECT class, count(*) AS n, sum(round(x, 6)::DECIMAL(20,6))::DOUBLE AS sum_x FROM m GROUP BY 1",
        "leak_exact": _leak("sha1", "images"),
        "leak_group": _leak("group_id", "images"),
        "leak_base": _leak("source, base", "(SELECT *, lower(stem) AS base FROM stems)"),
    }
