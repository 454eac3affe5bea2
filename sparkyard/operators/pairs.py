"""Candidate pairs of images: similarity join, metrics, triage, review overlay and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkyard.functions import vectors as vx
from sparkyard.operators.ranking import row_numbers
from sparkyard.session import Scratch

HIGH, POSSIBLE, NOT = "high_confidence_leakage", "possible_leakage", "visually_not_leakage"
# The radii of the candidate join, and how many pairs per source are reviewed.
P_RADIUS, D_RADIUS, REVIEWED = 16, 12, 100
#: Rows of either side that a group of the candidate join compares.
BLOCK_ROWS = 10_000


def cross_split_candidates(items: DataFrame, p_radius: int = P_RADIUS, d_radius: int = D_RADIUS, block_rows: int = BLOCK_ROWS, sources: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one source from different splits whose ``phash`` or ``dhash`` are within a radius: ``(a, b, phash_distance, dhash_distance)``.

    ``items`` has ``id, source, split, phash, dhash``; the earlier of train, val, test is ``a``. Radii of a fifth of the bits and
    more leave no selective key (of eight parts of a hash one has at most two flipped bits, which a seventh of all values have), so all pairs
    of a source are looked at, in blocks: either side of a source falls into parts of about ``block_rows`` rows, as many as its count asks for, and each two
    parts meet in a group of their own. ``sources`` names those to look at, by default all. So a source of any size is many groups of bounded work. For tight radii there are better ways.
    """
    n = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).when(F.col("split") == "test", 2)
    x = items.select("id", "source", "phash", "dhash", n.alias("n")).where("n IS NOT NULL AND phash IS NOT NULL AND dhash IS NOT NULL")
    x = x.where(F.col("source").isin(*sources)) if sources else x
    x = Scratch(items.sparkSession, "candidates").save(x, "items")
    parts = lambda c: F.ceil(F.count(F.when(c, 1)) / block_rows).cast("int")
    sizes = x.groupBy("source").agg(parts(F.col("n") < 2).alias("rows"), parts(F.col("n") > 0).alias("columns")).where("rows > 0 AND columns > 0")
    x = x.join(sizes, "source")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = x.where("n < 2").withColumn("row", F.pmod(F.xxhash64("id"), "rows").cast("int")).withColumn("column", every("columns"))
    right = x.where("n > 0").withColumn("column", F.pmod(F.xxhash64("id"), "columns").cast("int")).withColumn("row", every("rows"))
    p, d = vx.hamming(F.col("l.phash"), F.col("r.phash")), vx.hamming(F.col("l.dhash"), F.col("r.dhash"))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("source", "row", "column")] + [F.col("l.n") < F.col("r.n"), (p <= p_radius) | (d <= d_radius)]
    return left.alias("l").join(right.alias("r"), on).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), p.alias("phash_distance"), d.alias("dhash_distance"))


def pair_id(a: Column, b: Column) -> Column:
    """12 hex digits of the pair, whichever way round."""
    return F.substring(F.sha1(F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))), 1, 12)


# The weights of the score and the thresholds of the verdict.
def suspicion(p: Column, d: Column, ncc: Column, hist: Column, delta: Column) -> Column:
    base = 0.30 * (1 - p / 64) + 0.15 * (1 - d / 64) + 0.40 * F.greatest(ncc, F.lit(0.0)) + 0.15 * hist
    return base + F.when(delta.isNotNull(), 0.05 * F.exp(-delta / 10)).otherwise(0.0)


def triage(p: Column, d: Column, ncc: Column, mae: Column, same_family: Column, delta: Column) -> Column:
    """What the metrics alone say of a pair; a null or NaN metric meets no threshold. ``delta`` counts only within one family."""
    ncc, mae = (F.when(~F.isnan(c), c) for c in (ncc, mae))
    near = F.when(same_family, delta)
    high = F.coalesce((p <= 3) & (d <= 5) & (ncc >= 0.985) & (mae <= 0.04), F.lit(False)) | F.coalesce((near <= 3) & (ncc >= 0.94), F.lit(False))
    possible = F.coalesce((p <= 8) & (ncc >= 0.94), F.lit(False)) | F.coalesce((p <= 12) & (d <= 10) & (ncc >= 0.90), F.lit(False)) | F.coalesce((near <= 15) & (ncc >= 0.84), F.lit(False))
    return F.when(high, HIGH).when(possible, POSSIBLE).otherwise(NOT)


def ranked(pairs: DataFrame) -> DataFrame:
    """With ``review_rank`` per source: highest suspicion first, then smaller pHash distance, then pair id."""
    return row_numbers(pairs, ["source"], [F.desc_nulls_last("suspicion_score"), F.asc_nulls_last("phash_distance"), F.asc("pair_id"), F.asc("audit_key")], "review_rank")


def reviewed(pairs: DataFrame, high_ids: DataFrame, top: int = REVIEWED) -> DataFrame:
    """The verdict after review: of the first ``top`` of each source high for the listed ids, else not; below that a metric verdict of high counts as possible.

    ``pairs`` has ``metric_verdict`` and ``review_rank``; the metric verdict stays beside the new one. ``high_ids`` has one column ``pair_id``.
    """
    x = pairs.join(high_ids.select("pair_id", F.lit(True).alias("listed")).distinct(), "pair_id", "left")
    seen = F.col("review_rank") <= top
    verdict = F.when(seen, F.when(F.col("listed"), HIGH).otherwise(NOT)).otherwise(F.when(F.col("metric_verdict") == NOT, NOT).otherwise(POSSIBLE))
    return x.withColumn("reviewed_visually", seen).withColumn("final_verdict", verdict).drop("listed")


def unmatched_ids(pairs: DataFrame, high_ids: DataFrame) -> DataFrame:
    """Listed ids that no pair has."""
    return high_ids.select("pair_id").distinct().join(pairs, "pair_id", "left_anti")


def sequence_edges(pairs: DataFrame, verdict: str, frames: int = 30) -> DataFrame:
    """The pairs that make sequence groups: not dismissed by the verdict, of one file family, and at most ``frames`` apart."""
    return pairs.where((F.col(verdict) != NOT) & F.col("same_filename_family") & (F.col("frame_delta") <= frames))


def verdict_summary(pairs: DataFrame, verdict: str) -> DataFrame:
    """Per source: pairs, pairs by verdict, and distinct images in high pairs."""
    v = F.col(verdict)
    counts = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(v == HIGH, 1)).alias("high"), F.count(F.when(v == POSSIBLE, 1)).alias("possible"), F.count(F.when(v == NOT, 1)).alias("not_leakage"))
    images = pairs.where(v == HIGH).select("source", F.explode(F.array("a", "b")).alias("image")).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("images_in_high"))
    return counts.join(images, "source", "left").withColumn("images_in_high", F.coalesce("images_in_high", F.lit(0)))
