"""Exact duplicates by digest: the copy that stays, the merged boxes, and what leaks across splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT_ORDER = {"test": 0, "val": 1, "train": 2}
SOURCE_ORDER = {"d1": 0, "d6": 1, "d7": 2, "d8": 3}


def _rank(c: Column, order: dict[str, int]) -> Column:
    out = F.lit(len(order))
    for k, v in order.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def duplicate_report(images: DataFrame) -> DataFrame:
    """Per digest with several images: the one kept (test before val before train, then source, then path), and how many, from which sources and splits.

    Aggregates only; no group is gathered. Images without a digest are no duplicates.
    """
    order = F.struct(_rank(F.col("split"), SPLIT_ORDER), _rank(F.col("source"), SOURCE_ORDER), "original_image", "image_id")
    kept = F.struct("image_id", "source", "split", "original_image")
    found = images.where("sha1 IS NOT NULL").groupBy("sha1").agg(
        F.min_by(kept, order).alias("k"), F.count(F.lit(1)).alias("copies"), F.array_join(F.array_sort(F.collect_set("source")), ";").alias("all_sources"), F.array_join(F.array_sort(F.collect_set("split")), ";").alias("all_splits")
    )  # a set of sources or splits is as small as their number
    return found.where("copies > 1").select("sha1", F.col("k.image_id").alias("kept_image_id"), F.col("k.source").alias("kept_source"), F.col("k.split").alias("kept_split"), F.col("k.original_image").alias("kept_image"), "copies", "all_sources", "all_splits")


def deduplicate(images: DataFrame) -> DataFrame:
    """All images but the copies that aren't kept."""
    gone = images.join(duplicate_report(images).select("sha1", "kept_image_id"), "sha1").where("image_id <> kept_image_id").select("image_id")
    return images.join(gone, "image_id", "left_anti")


def merged_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """The boxes of every kept image, those of its copies merged: of boxes equal to 6 decimals the last one stays.

    "Last" is by image id, then line number. Images without a digest keep their own boxes.
    """
    report = duplicate_report(images).select("sha1", "kept_image_id")
    owner = images.select("image_id", "sha1").join(report, "sha1", "left").select("image_id", F.coalesce("kept_image_id", "image_id").alias("kept_image_id"))
    key = ["kept_image_id", "class", *(F.round(c, 6).alias(f"k{c}") for c in "xywh")]
    return (
        boxes.join(owner, "image_id")
        .groupBy(*key)
        .agg(F.max_by(F.struct("x", "y", "w", "h"), F.struct("image_id", "line_no")).alias("b"))
        .select(F.col("kept_image_id").alias("image_id"), "class", "b.*")
    )


def shared_across_splits(images: DataFrame, keys: list[str]) -> DataFrame:
    """``(split_a, split_b, n)``: how many values of the keys occur in both of two splits; null keys are none.

    One aggregation per value; a value in many images counts once.
    """
    x = images.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    at = x.groupBy(*keys).agg(*(F.bool_or(F.col("split") == s).alias(s) for s in ("train", "val", "test")))
    both = [("train", "val"), ("train", "test"), ("val", "test")]
    sums = at.agg(*(F.count(F.when(F.col(a) & F.col(b), 1)).alias(f"{a}_{b}") for a, b in both))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"{a}_{b}").alias("n")) for a, b in both))).alias("r")).select("r.*")
