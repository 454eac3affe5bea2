"""Problem 2: the same or nearly the same records across splits.

Method: segment join. A string with at most k errors, cut into k + 1 segments, keeps one of them; so the evaluation
strings are cut, the training strings give their substrings at the allowed positions, and what shares one is verified
by a banded dynamic program. :func:`edit_pairs` is this join; digests are joined by it with no error allowed.

:func:`near_pairs` is its form for the 64 bits of a hash, where errors are flipped bits: lengths are equal and nothing
shifts, so the only allowed position is the segment's own and the band of the dynamic program is its main diagonal,
the number of unequal positions (``bit_count`` of the exclusive or).

Segments of 64 / (k + 1) = 9 bits select little among billions of rows. Two refinements keep the join exact:
of k + 2 segments at least two stay whole, so *pairs* of segments are the keys; and a key that too many rows of both
sides share is refined by the segments of the second hash, one of which stays whole. Segments take every n-th bit, since neighbouring bits of
perceptual hashes tend to agree over many images. Keys are hashed to 32 bits; a collision only adds a candidate. A pair
comes out under the first key that both share, and under no other, so nothing has to be made distinct.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard.functions.text import folded, split_name
from sparkyard.session import Scratch

P_BITS, D_BITS = 6, 8
#: A key is refined if more rows of the right side share it; below that, a row of the left side meets at most so many candidates by a key.
HOT_ROWS = 64
#: Refined keys that are sent to all tasks at most; the number of keys is bounded by the key space, not by the rows.
MAX_HOT = 200_000


def _segment(c: Column, n: int, i: int) -> Column:
    """The bits i, i + n, i + 2n, ... of a bigint, still in their places."""
    mask = sum(1 << b for b in range(i, 64, n))
    return c.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))


def _keys(c: Column, k: int) -> Column:
    """The keys of a hash for at most ``k`` flipped bits, one for each two of its k + 2 segments, each with the numbers of the two as bits."""
    cut = [_segment(c, k + 2, i) for i in range(k + 2)]
    return F.array(*(F.struct(F.hash(F.lit(n), cut[i].bitwiseOR(cut[j])).alias("k"), F.lit(1 << i | 1 << j).alias("two")) for n, (i, j) in enumerate(combinations(range(k + 2), 2))))


def _agreeing(x: Column, n: int) -> Column:
    """The numbers, as bits, of the segments that have no bit in an exclusive or: shifted upon each other, its bits leave a segment's number free only then."""
    step = n
    while step < 64:
        x, step = x.bitwiseOR(F.shiftrightunsigned(x, step)), 2 * step
    return F.bitwise_not(x).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def _lowest(bits: Column) -> Column:
    return bits.bitwiseAND(-bits)


def near_pairs(spark: SparkSession, left: DataFrame, right: DataFrame, p_bits: int = P_BITS, d_bits: int = D_BITS, hot_rows: int = HOT_ROWS, unique: bool = False) -> DataFrame:
    """The pairs ``(a, b)`` of ids of ``left`` and ``right`` (the smaller side), tables of ``(id, p, d)``, whose ``p`` differ in at most ``p_bits`` bits and ``d`` in at most ``d_bits``.

    Exact: no pair is lost and none is bounded away. Rows with a null hash are in no pair; repeated rows give a pair once. ``unique`` says that no row is repeated.
    """
    cut = lambda x: x.where("p IS NOT NULL AND d IS NOT NULL").select("id", "p", "d")
    key = lambda x: cut(x if unique else x.select("id", "p", "d").distinct()).select("id", "p", "d", F.explode(_keys(F.col("p"), p_bits)).alias("key")).select("id", "p", "d", "key.*")
    xp, xd = (F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}")) for c in "pd")
    agree = _agreeing(xp, p_bits + 2)
    first = _lowest(agree)
    near = (F.bit_count(xp) <= p_bits) & (F.bit_count(xd) <= d_bits) & (first.bitwiseOR(_lowest(agree.bitwiseXOR(first))) == F.col("l.two"))
    lk, rk = key(left), key(right).drop("two")
    hot = rk.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("k")
    scratch = Scratch(spark, "overlap")
    hot = scratch.save(hot, "hot")
    n_hot = hot.count()
    pairs = lambda x, y, on, ok: x.alias("l").join(y.alias("r"), on).where(ok).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    if not n_hot:
        return pairs(lk, rk, "k", near)
    if n_hot <= MAX_HOT:
        hot = F.broadcast(hot)
    cold = lambda x: x.join(hot, "k", "left_anti")
    fine = lambda x: x.join(hot, "k", "left_semi").withColumn("f", F.explode(F.array(*(F.struct(F.hash("k", F.lit(i), _segment(F.col("d"), d_bits + 1, i)).alias("k"), F.lit(1 << i).alias("one")) for i in range(d_bits + 1))))).select(*[c for c in x.columns if c != "k"], "f.*")
    again = near & (_lowest(_agreeing(xd, d_bits + 1)) == F.col("l.one"))
    return pairs(cold(lk), cold(rk), "k", near).unionByName(pairs(fine(lk), fine(rk).drop("one"), "k", again))


def edit_pairs(left: DataFrame, right: DataFrame, k: int, unique: bool = False) -> DataFrame:
    """The pairs ``(a, b, edits)`` of ids of ``left`` and ``right``, tables of ``(id, s)``, whose strings are at most ``k`` insertions, deletions or changes apart.

    The right strings are cut into k + 1 segments as even as can be. Of a left string of m letters the substrings count that may be a segment
    of a string of n letters, m - k <= n <= m + k: with i segments before it, at most i edits lie before and k - i after it, so it has shifted by at most
    i from its place, and by at most k - i from that place seen from the end. Exact for strings of any length: those too short to be cut have empty segments,
    which all strings of about their length share. Null ids and strings are in no pair, repeated rows give a pair once. ``unique`` says that no id is repeated.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    clean = lambda x: (x if unique else x.select("id", "s").distinct()).where("id IS NOT NULL AND s IS NOT NULL").select("id", "s")
    width = lambda n, i: F.floor((n + i) / (k + 1)).cast("int")
    place = lambda n, i: sum((width(n, j) for j in range(i)), F.lit(0))
    m = F.length("s")
    own = F.array(*(F.xxhash64(m, F.lit(i), F.substring("s", place(m, i) + 1, width(m, i))) for i in range(k + 1)))
    found = []
    for shift in range(-k, k + 1):  # m - n
        n = m - shift
        for i in range(k + 1):
            at, low, high = place(n, i), max(-i, shift - (k - i)), min(i, shift + (k - i))
            for step in range(low, high + 1):
                inside = (n >= 0) & (at + step >= 0) & (at + step + width(n, i) <= m)
                found.append(F.when(inside, F.xxhash64(n, F.lit(i), F.substring("s", at + step + 1, width(n, i)))))
    lk = clean(left).select("id", "s", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("key"))
    rk = clean(right).select("id", "s", F.explode(own).alias("key"))
    pairs = lk.alias("l").join(rk.alias("r"), "key").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.levenshtein("l.s", "r.s", k).alias("edits"))
    pairs = pairs.where("edits >= 0")
    return pairs if unique and not k else pairs.groupBy("a", "b").agg(F.min("edits").alias("edits"))  # a single segment is shared once


def current_images(manifest: DataFrame) -> DataFrame:
    """``(image_id, source, split, sha1)`` of each image: its row with the latest ``recorded_at``, then ``loaded_at`` (nulls come first)."""
    row = F.max(F.struct("recorded_at", "loaded_at", split_name(F.col("split")).alias("split"), folded(F.col("sha1")).alias("sha1"), "source"))
    return manifest.where("image_id IS NOT NULL").groupBy("image_id").agg(row.alias("r")).select("image_id", "r.source", "r.split", "r.sha1")


def current_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """``(image_id, phash, dhash)`` of each image: its row with the latest ``computed_at`` (null comes first)."""
    row = F.max(F.struct("computed_at", "phash", "dhash"))
    return fingerprints.groupBy("image_id").agg(row.alias("r")).select("image_id", "r.phash", "r.dhash")


def cross_split_pairs(spark: SparkSession, manifest: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The overlaps ``(train_id, eval_id, how)`` with ``how`` ``exact`` (equal sha1) or ``near`` (close hashes), and the images.

    A pair that overlaps in both ways has two rows. Images whose split is null, or none of train, val and test, are in none.
    """
    scratch = Scratch(spark, "overlap")
    images = current_images(manifest).where(F.col("split").isin("train", "val", "test"))
    images = scratch.save(images.join(current_fingerprints(fingerprints), "image_id", "left"), "images")
    train, held = images.where("split = 'train'"), images.where("split <> 'train'")
    digest = lambda x: x.select(F.col("image_id").alias("id"), F.col("sha1").alias("s"))
    exact = edit_pairs(digest(train), digest(held), 0, unique=True).select(F.col("a").alias("train_id"), F.col("b").alias("eval_id"), F.lit("exact").alias("how"))
    cut = lambda x: x.select(F.col("image_id").alias("id"), F.col("phash").alias("p"), F.col("dhash").alias("d"))
    near = near_pairs(spark, cut(train), cut(held), unique=True).select(F.col("a").alias("train_id"), F.col("b").alias("eval_id"), F.lit("near").alias("how"))
    return exact.unionByName(near), images


def overlaps(spark: SparkSession, manifest: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """``(image_id_a, image_id_b)``, the smaller id first, of all pairs of a train image and a val or test image that overlap."""
    pairs, _ = cross_split_pairs(spark, manifest, fingerprints)
    return pairs.select(F.least("train_id", "eval_id").alias("image_id_a"), F.greatest("train_id", "eval_id").alias("image_id_b")).distinct()


def overlap_report(spark: SparkSession, manifest: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Per evaluation split and source: images, those that overlap with train exactly, nearly, and in any way."""
    pairs, images = cross_split_pairs(spark, manifest, fingerprints)
    hit = pairs.groupBy(F.col("eval_id").alias("image_id")).agg(F.bool_or(F.col("how") == "exact").alias("exact"), F.bool_or(F.col("how") == "near").alias("near"), F.countDistinct("train_id").alias("n_pairs"))
    n = lambda c: F.count(F.when(c, 1))
    return (
        images.where("split <> 'train'")
        .join(hit, "image_id", "left")
        .groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("images"), n(F.col("exact")).alias("exact"), n(F.col("near")).alias("near"), n(F.col("n_pairs").isNotNull()).alias("leaked"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("pairs"))
    )
