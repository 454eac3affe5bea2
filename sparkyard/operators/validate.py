"""Contract checks: each yields rows of problems; no row means valid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkyard.functions.taxonomy import CLASSES
from sparkyard.functions.text import strip_or_null

def _issues(df: DataFrame, keys: list[str], checks: list[tuple[str, str, Column]]) -> DataFrame:
    """``(keys, path, code)`` of every check that holds; all of a row's problems come out."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(k).alias("code"))) for p, k, c in checks)))
    return df.select(*keys, F.explode(found).alias("i")).select(*keys, "i.*")


def dataset_problems(images: DataFrame, boxes: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """``(problem, key, n)`` of a built data set: repeated output paths, unknown splits, the split of the path another, boxes out of range, digests in several splits."""
    from sparkyard.functions.names import split_of_path

    one = lambda x, p, k: x.select(F.lit(p).alias("problem"), k.cast("string").alias("key"), F.lit(1).cast("bigint").alias("n"))
    twice = images.where("output_image IS NOT NULL").groupBy(F.col("output_image").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_output_path").alias("problem"), "key", "n")
    split = one(images.where("split IS NULL OR split NOT IN ('train', 'val', 'test')"), "invalid_split", F.col("image_id"))
    path = one(images.where(split_of_path(F.col("output_image")) != F.col("split")), "path_of_other_split", F.col("image_id"))
    t = tolerance
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1) & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") - F.col("w") / 2 >= -t) & (F.col("x") + F.col("w") / 2 <= 1 + t) & (F.col("y") - F.col("h") / 2 >= -t) & (F.col("y") + F.col("h") / 2 <= 1 + t)
    box = boxes.where(~F.coalesce(inside, F.lit(False))).groupBy(F.col("image_id").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("invalid_box").alias("problem"), "key", "n")
    leak = images.where("sha1 IS NOT NULL").groupBy(F.col("sha1").alias("key")).agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit("digest_in_several_splits").alias("problem"), "key", "n")
    out = twice
    for x in (split, path, box, leak):
        out = out.unionByName(x)
    return out


def stats_mismatch(reported: DataFrame, counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose reported and counted values differ; a side without the key has 0."""
    j = reported.select(*keys, F.col(value).alias("reported")).join(counted.select(*keys, F.col(value).alias("counted")), keys, "full").na.fill(0, ["reported", "counted"])
    return j.where("reported <> counted")


def requirement_problems(rows: DataFrame) -> DataFrame:
    """``(profile_id, name, code)`` of a requirement table: unknown classes, nothing asked for, unknown kinds, modes or relations, repeated names."""
    c = F.col
    checks = [
        ("", "unknown_class", F.exists("detectable", lambda x: ~x.isin(*CLASSES))),
        ("", "empty_requirement", (F.size("detectable") == 0) & (F.size("undetectable") == 0)),
        ("", "unknown_kind", ~c("kind").isin("required", "alternative", "undetectable", "conditional")),
        ("", "unknown_mode", (c("kind") == "conditional") & ~F.coalesce(c("mode").isin("any", "all"), F.lit(False))),
        ("", "unknown_relation", (c("kind") == "conditional") & ~F.coalesce(c("relation").isin("alternative", "additional"), F.lit(False))),
        ("", "missing_condition", (c("kind") == "conditional") & strip_or_null(c("condition")).isNull()),
    ]
    found = _issues(rows, ["profile_id", "name"], checks).drop("path")
    again = rows.groupBy("profile_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("profile_id", "name", F.lit("repeated_name").alias("code"))
    return found.unionByName(again)


def shared_keys(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """``(key, tables)`` of the keys that several tables have; sets that must be disjoint give none. Null keys don't count."""
    every = None
    for name, t in tables.items():
        x = t.select(F.col(key).alias("key"), F.lit(name).alias("t")).where("key IS NOT NULL").distinct()
        every = x if every is None else every.unionByName(x)
    return every.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("t")), ";").alias("tables"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")  # as many as tables


def count_problems(counts: DataFrame, expected: dict[str, int], key: str, value: str) -> DataFrame:
    """``(key, expected, counted)`` where fixed counts aren't met; a key without a count has 0."""
    want = counts.sparkSession.createDataFrame(list(expected.items()), f"{key} string, expected bigint")
    x = want.join(counts.select(key, F.col(value).alias("counted")), key, "left").na.fill(0, ["counted"])
    return x.where("expected <> counted")


def series_problems(frames: DataFrame, series: list[str], ts: str, most: int = 30) -> DataFrame:
    """``(series, problem, n)`` of uploaded series: no frames or more than ``most``, some times given and others not, or given twice."""
    x = frames.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), F.count(ts).alias("given"), F.count_distinct(ts).alias("different"))
    c = F.col
    checks = [("too_many_frames", c("n") > most), ("some_times_missing", (c("given") > 0) & (c("given") < c("n"))), ("repeated_times", c("different") < c("given"))]
    found = F.array_compact(F.array(*(F.when(ok, F.lit(name)) for name, ok in checks)))
    return x.select(*series, F.explode(found).alias("problem"), "n")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the detection and series operators; impossible ones are refused when they are made."""

    min_confidence: float = 0.25
    window_seconds: float | None = None
    min_observations: int = 3
    persistence_ratio: float = 0.75

    def __post_init__(self):
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must lie between 0 and 1")
        if self.window_seconds is not None and not self.window_seconds > 0:
            raise ValueError("window_seconds must be positive")
        if self.min_observations < 1:
            raise ValueError("min_observations must be 1 or more")
        if not 0 < self.persistence_ratio <= 1:
            raise ValueError("persistence_ratio must lie above 0 and up to 1")
