"""Connected components of an edge table, and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard.operators.ranking import row_numbers
from sparkyard.session import Scratch

MAX_ROUNDS = 60


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the edges ``(a, b)``; a component is named by its smallest node. Edges with a null end are none.

    Contraction: every root hooks onto its smallest neighbour, pointers jump to the ends of their chains, and the edges are drawn
    again between the roots that are left, which at least halves the roots in each round. Rounds work on 64-bit numbers of the
    nodes; should two nodes share one, other numbers are taken. Only emptiness checks reach the driver.
    """
    scratch = Scratch(spark, "graph")
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    for seed in range(5):
        number = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        names = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy(number(F.col("node")).alias("id")).agg(F.min("node").alias("node"), F.max("node").alias("other"))
        names = scratch.save(names, "names")
        if names.where("node <> other").isEmpty():
            break
    else:
        raise RuntimeError("nodes share numbers under every seed")
    left = edges.select(number(F.col("a")).alias("a"), number(F.col("b")).alias("b")).where("a <> b").distinct()
    left, left_path = scratch.write(left, "edges")
    roots, path = names.select("id", F.col("id").alias("root")), None
    for _ in range(MAX_ROUNDS):
        hooks, hook_path = scratch.write(left.groupBy(F.greatest("a", "b").alias("x")).agg(F.min(F.least("a", "b")).alias("y")), "hooks")
        if hooks.isEmpty():
            named = scratch.save(roots.join(names, "id").select("root", "node"), "named")
            # written, as adaptive execution splits the partition of a giant component only if no aggregate shares the shuffle
            small = scratch.save(named.groupBy("root").agg(F.min("node").alias("component")), "smallest")
            return named.join(small, "root").select("node", "component")
        for _ in range(MAX_ROUNDS):
            q = hooks.select(F.col("x").alias("y"), F.col("y").alias("z"))
            jumped, jumped_path = scratch.write(hooks.join(q, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")), "hooks")
            scratch.drop(hook_path)
            hooks, hook_path = jumped.select("x", "y"), jumped_path
            if jumped.where("moved").isEmpty():
                break
        at = lambda t, c: t.join(hooks.select(F.col("x").alias(c), F.col("y").alias("y")), c, "left").withColumn(c, F.coalesce("y", c)).drop("y")  # noqa: B023, E731
        new_left, new_left_path = scratch.write(at(at(left, "a"), "b").where("a <> b").distinct(), "edges")
        new_roots, new_path = scratch.write(at(roots, "root"), "roots")
        for p in (left_path, path):
            scratch.drop(p)
        left, left_path, roots, path = new_left, new_left_path, new_roots, new_path
    raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")


def numbered(members: DataFrame) -> DataFrame:
    """With ``number``: the components of each source counted in the order of their smallest node."""
    heads = members.select("source", "component").distinct()
    return members.join(row_numbers(heads, ["source"], [F.asc("component")], "number"), ["source", "component"])


def component_profile(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Per component of images: size, images per split, range of frames, confirmed edges, status.

    ``members``: source, node, component, split, frame; ``edges``: a, component, confirmed. Components within one split are kept out.
    """
    n = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}")
    size = members.groupBy("source", "component").agg(
        F.count(F.lit(1)).alias("n_images"), n("train"), n("val"), n("test"), F.countDistinct("split").alias("n_splits"), F.min("frame").alias("min_frame"), F.max("frame").alias("max_frame")
    )
    confirmed = edges.groupBy("component").agg(F.count(F.when(F.col("confirmed"), 1)).alias("confirmed_edges"))
    out = size.where("n_splits > 1").drop("n_splits").join(confirmed, "component", "left")
    return out.withColumn("status", F.when(F.col("confirmed_edges") > 0, "high_confidence_cross_split").otherwise("possible_cross_split"))
