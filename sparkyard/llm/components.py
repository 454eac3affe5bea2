"""Problem 1: one group identifier for all records that pairwise matches tie, directly or indirectly.

Method: hash-to-min. Every vertex holds a cluster (at first itself and its neighbours); in each round
it sends the cluster to its smallest member and that member to all others, until nothing changes.
A cluster is kept as rows ``(v, u)``, never as one array, so that a hub with a third of all pairs is
spread over tasks: its minimum is a partial aggregate, and adaptive execution splits its join partition. For that
both sides of a join must be shuffled for this join only; so minima are written before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkyard.functions.text import file_name
from sparkyard.session import Scratch

LINKS = "high_confidence_leakage"
MAX_SEEDS = 5
MAX_ROUNDS = 100


def decided_pairs(pairs: DataFrame, a: Column, b: Column, decides: Column, accepted: Column) -> DataFrame:
    """The accepted unordered pairs ``(a, b)``, ``a < b``.

    Pairs with a null member or twice the same do not count. For each pair the row with the greatest
    ``decides`` counts, whichever way round it was written; of rows that tie in it, an accepted one wins.
    A null ``decides`` comes before all others, a null ``accepted`` is false.
    """
    x = pairs.select(a.alias("x"), b.alias("y"), decides.alias("at"), F.coalesce(accepted, F.lit(False)).alias("ok"))
    return (
        x.where("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "at", "ok")
        .groupBy("a", "b")
        .agg(F.max(F.struct("at", "ok"))["ok"].alias("ok"))
        .where("ok")
        .select("a", "b")
    )


def hash_to_min(spark: SparkSession, links: DataFrame, scratch: Scratch, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(v, root)`` for each vertex of the links ``(a, b)`` of bigints; ``root`` is the smallest vertex of its component.

    An empty input gives an empty result; repeated links and links to itself change nothing.
    """
    first = links.select(F.explode(F.array(*(F.struct(F.col(v).alias("v"), F.col(u).alias("u")) for v in "ab" for u in "ab"))).alias("e"))
    state, path, seen = _written(scratch, first.select("e.v", "e.u").distinct())
    for _ in range(max_rounds):
        low, low_path = scratch.write(state.groupBy("v").agg(F.min("u").alias("m")), "low")
        new, new_path, now = _written(scratch, _sent(state, low))
        scratch.drop(path)
        scratch.drop(low_path)
        state, path = new, new_path
        if now == seen:
            return state.groupBy("v").agg(F.min("u").alias("root"))
        seen = now
    raise RuntimeError(f"no stable state after {max_rounds} rounds")


def _sent(state: DataFrame, low: DataFrame) -> DataFrame:
    """What the vertices send in a round: the cluster to its minimum, the minimum to the cluster."""
    sent = state.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
    return sent.select("e.v", "e.u").distinct()


def _written(scratch: Scratch, state: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The state as a written table, its path, and number and order-free digest of its rows, taken while it is written; a changed state differs in it."""
    h, seen = F.xxhash64("v", "u"), Observation()
    table, path = scratch.write(state.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("sum"), F.bit_xor(h).alias("xor")), "clusters")
    return table, path, tuple(seen.get[k] for k in ("n", "sum", "xor"))


def name_groups(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``(name, group_id)`` of every name in the links ``(a, b)`` of strings; ``group_id`` is the smallest name, by code points, tied to it.

    The rounds run on 64-bit hashes of the names. Should two names share a hash, another seed is taken, so no
    two groups are ever merged by chance.
    """
    scratch = Scratch(spark, "components")
    links = scratch.save(links, "links")
    for seed in range(MAX_SEEDS):
        key = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        names = links.select(F.explode(F.array("a", "b")).alias("name")).groupBy(key(F.col("name")).alias("v")).agg(F.min("name").alias("name"), F.max("name").alias("other"))
        names = scratch.save(names, "names")
        if names.where("name <> other").isEmpty():
            break
    else:
        raise RuntimeError("names share hashes under every seed")
    roots = hash_to_min(spark, links.select(key(F.col("a")).alias("a"), key(F.col("b")).alias("b")), scratch)
    members = scratch.save(roots.join(names.drop("other"), "v").select("root", "name"), "members")
    smallest = scratch.save(members.groupBy("root").agg(F.min("name").alias("group_id")), "smallest")
    return members.join(smallest, "root").select("name", "group_id")


def image_groups(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """``(image, group_id)`` of every image that an accepted audited pair ties to another one.

    Images are file names. Null or blank paths and pairs of an image with itself do not count; extra columns are ignored.
    """
    links = decided_pairs(pairs, file_name(F.col("image_a")), file_name(F.col("image_b")), F.col("audited_at"), F.col("visual_review") == LINKS)
    return name_groups(spark, links).withColumnRenamed("name", "image")
