"""Row numbers within few large groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkyard.session import Scratch


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """With ``name``: the number of each row, from 1, within its group by ``keys`` in the given order, which should be total.

    A window over a few groups would sort each in one task. Here rows are sorted by group and order into ranges; a row's number is its number
    within its range and group, plus the rows of the group in the ranges before, of which there are as many counts as ranges and groups. Null keys are a group.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = df.repartitionByRange(parts, *(F.col(k).asc_nulls_first() for k in keys), *order).withColumn("$part", F.spark_partition_id())
    x = Scratch(spark, "ranking").save(x, "ranges")
    before = Window.partitionBy(*keys).orderBy("$part").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as ranges
    counts = x.groupBy(*keys, "$part").agg(F.count(F.lit(1)).alias("$n")).withColumn("$before", F.coalesce(F.sum("$n").over(before), F.lit(0))).drop("$n")
    own = Window.partitionBy("$part", *keys).orderBy(*order)
    x = x.withColumn("$own", F.row_number().over(own)).alias("x")
    counts = F.broadcast(counts) if not keys else counts  # without keys as many rows as ranges
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "$part")]
    return x.join(counts.alias("c"), on).select(*(F.col(f"x.{c}") for c in df.columns), (F.col("$before") + F.col("$own")).cast("int").alias(name))
