"""Problem 4: what changed between consecutive full snapshots of a table.

Method: every row stands for its snapshot twice, once as the later side of the comparison with the
snapshot before and once as the earlier side of the one after. One aggregation by (comparison, key)
finds the valid row of either side and classifies the key from the two row hashes. Nothing else is
shuffled, and only hashes travel, not the compared columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkyard.functions.text import file_name, folded, path_text, split_name, strip_or_null
from sparkyard.operators.ranking import row_numbers

#: Snapshot dates whose list is sent to all tasks; where there are more, rows are joined to it by a shuffle.
MAX_SNAPSHOTS = 100_000


def snapshot_changes(df: DataFrame, snapshot: Column, key: Column, latest: Column, compared: list[Column], max_snapshots: int = MAX_SNAPSHOTS) -> DataFrame:
    """``(snapshot, key, change)`` with change ``added``, ``removed`` or ``changed`` against the snapshot before.

    Within a snapshot the row of a key with the greatest ``latest`` is valid (null comes first); of rows that tie in
    it the one with the greater row hash, so that the result doesn't depend on their order. Rows whose snapshot or key
    is null are left out. Two nulls of a compared column are equal. A single snapshot, or none, has no changes.
    """
    rows = df.select(snapshot.alias("s"), key.alias("key"), F.struct(latest.alias("at"), _row_hash(compared).alias("h")).alias("row")).where("s IS NOT NULL AND key IS NOT NULL")
    dates = rows.select("s").distinct().orderBy("s").limit(max_snapshots + 1).collect()
    spark = df.sparkSession
    order = [r["s"] for r in dates]
    if len(order) <= max_snapshots:
        sides = [(s, n, side) for i, s in enumerate(order) for n, side in ((s, True), (order[i + 1] if i + 1 < len(order) else None, False)) if n is not None and not (side and i == 0)]
        sides = F.broadcast(spark.createDataFrame(sides, rows.select(F.col("s"), F.col("s").alias("snapshot"), F.lit(True).alias("later")).schema))  # at most twice as many rows as snapshots
    else:
        n = row_numbers(rows.select("s").distinct(), [], [F.asc("s")], "n")
        after = n.select(F.col("s").alias("snapshot"), (F.col("n") - 1).alias("n"))
        sides = n.where("n > 1").select("s", F.col("s").alias("snapshot"), F.lit(True).alias("later")).unionByName(n.join(after, "n").select("s", "snapshot", F.lit(False).alias("later")))
    row = lambda later: F.max(F.when(F.col("later") == later, F.col("row")))["h"]
    return (
        rows.join(sides, "s")
        .groupBy("snapshot", "key")
        .agg(row(False).alias("old"), row(True).alias("new"))
        .select("snapshot", "key", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").alias("change"))
        .where("change IS NOT NULL")
    )


def _row_hash(columns: list[Column]) -> Column:
    """128 bits over the columns; a null differs from every text and keeps its place."""
    parts = F.to_json(F.array(*(c.cast("string") for c in columns)))
    return F.struct(F.xxhash64(F.lit(1), parts), F.xxhash64(F.lit(2), parts))


def planned_move_changes(moves: DataFrame) -> DataFrame:
    """``(snapshot_date, image, change)`` of the dated move plans; a move is known by the file name of ``old_image``.

    Moves without one, and rows without a date, are in no case. Ways of writing one value are no difference.
    """
    c = F.col
    compared = [strip_or_null(c("group_id"))]
    compared += [split_name(c(x)) for x in ("from_split", "to_split")]
    compared += [path_text(c(x)) for x in ("old_image", "new_image", "old_label", "new_label")]
    compared += [folded(c(x)) for x in ("image_sha256", "label_sha256")]
    found = snapshot_changes(moves, c("snapshot_date"), file_name(c("old_image")), c("delivered_at"), compared)
    return found.select(F.date_format("snapshot", "yyyy-MM-dd").alias("snapshot_date"), F.col("key").alias("image"), "change")


def change_counts(moves: DataFrame) -> DataFrame:
    """Number of changes of each kind per snapshot."""
    return planned_move_changes(moves).groupBy("snapshot_date", "change").agg(F.count(F.lit(1)).alias("n"))
