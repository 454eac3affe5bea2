"""Problem 6: splits of given shares that keep related records together.

Method: a persisted table of components. ``Components`` says to which unit each group id belongs and which split each
unit has; it is kept in a folder, as versions of which readers see the last that is whole, and carried on by later
batches. A batch brings new ids and ties. Only units that ties join change: these hook onto their smallest neighbour and
pointers jump until every one points at its root (:func:`sparkyard.operators.graph.components`). A unit that stems from units of one
split keeps it, one of new ids only fills the deficits of the splits, one that joins units of different splits is
quarantined: it has no split until someone decides.

Filling deficits is exact in the large and cheap in the small: units above 1/``LARGE`` of the images, so at most
``LARGE`` of them, are placed one by one, largest first, into the split that lacks most; all others are laid out in the
order of a hash and cut where the deficits say. Only sums by hash bucket reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkyard.functions.text import WHITE, split_name
from sparkyard.operators import graph
from sparkyard.session import Scratch
from sparkyard.sources.sinks import VersionedTable

SHARES = {"train": 0.7, "val": 0.2, "test": 0.1}
LARGE, BUCKETS = 2000, 4096


def members(c: Column) -> Column:
    """The members of an id joined by ``+``: lower case, without white space around them, none blank; null for an id without any."""
    parts = F.transform(F.split(F.lower(c), r"\+"), lambda x: F.btrim(x, F.lit(WHITE)))
    return F.nullif(F.array_distinct(F.filter(parts, lambda x: x != "")), F.array().cast("array<string>"))


def split_names(c: Column) -> Column:
    """The distinct split names of a list parted by ``;`` or ``,``; other names are kept, blanks are not."""
    return F.array_compact(F.array_distinct(F.transform(F.split(c, "[;,]"), split_name)))


def merge(spark: SparkSession, units: DataFrame, ties: DataFrame, scratch: Scratch) -> DataFrame:
    """The table ``(member, unit)`` after the ties ``(a, b)``; every unit is named by its smallest member.

    Members of ties that the table doesn't have come in as units of their own. Null members tie nothing.
    """
    ties = scratch.save(ties.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "ties")
    new = ties.select(F.explode(F.array("a", "b")).alias("member")).distinct().join(units, "member", "left_anti")
    state = scratch.save(units.select("member", "unit").unionByName(new.withColumn("unit", F.col("member"))), "units")
    at = lambda t, c: t.join(state.select(F.col("member").alias(c), F.col("unit").alias(f"u{c}")), c)
    cross = scratch.save(at(at(ties, "a"), "b").where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")), "cross")
    if cross.isEmpty():
        return state
    roots = scratch.save(graph.components(spark, cross), "roots")
    return scratch.save(state.join(roots, F.col("unit") == F.col("node"), "left").select("member", F.coalesce("component", "unit").alias("unit")), "units")


def ties_of(ids: DataFrame, id_members: str) -> DataFrame:
    """The ties ``(a, b)`` of the first member of each id with its others, and of each single member with itself."""
    first = F.col(id_members)[0]
    return ids.where(F.col(id_members).isNotNull()).select(first.alias("a"), F.explode(id_members).alias("b"))


def all_units(spark: SparkSession, ids: DataFrame, id_members: str, scratch: Scratch, units: DataFrame | None = None) -> DataFrame:
    """``(member, unit)`` of all members of the ids, on top of the units there are."""
    ties = scratch.save(ties_of(ids.select(id_members).distinct(), id_members).distinct(), "id_ties")
    if units is None:
        units = spark.createDataFrame([], "member string, unit string")
    own = ties.select(F.col("b").alias("member")).distinct().join(units, "member", "left_anti").withColumn("unit", F.col("member"))
    return merge(spark, units.select("member", "unit").unionByName(own), ties, scratch)


def divided_units(spark: SparkSession, audit: DataFrame, folder: str | None = None) -> DataFrame:
    """``(source, group_id)`` of the units whose audit rows name more than one split; ``source`` is the smallest of a unit's rows. Rows without an id belong to none.

    With a ``folder``, the units are those of its persisted table and the audit's ties on top of them, and are kept there; without one, the table is this call's own.
    """
    scratch = Scratch(spark, "group-splits")
    folder = folder or f"{scratch.root}/state"
    rows = scratch.save(audit.select(members(F.col("group_id")).alias("m"), split_names(F.col("final_splits")).alias("splits"), "source").where("m IS NOT NULL"), "rows")
    before = Components.load(spark, folder)
    units = Components(all_units(spark, rows, "m", scratch, before.units), before.splits).save(folder).units
    named = rows.select(F.col("m")[0].alias("member"), "source", F.explode_outer("splits").alias("split"))
    named = named.groupBy("member", "split").agg(F.min("source").alias("source")).join(units, "member")
    return named.groupBy(F.col("unit").alias("group_id")).agg(F.min("source").alias("source"), F.countDistinct("split").alias("n")).where("n > 1").select("source", "group_id")


@dataclass
class Components:
    """The persisted state: ``units`` (member, unit) and ``splits`` (unit, split, images, status)."""

    units: DataFrame
    splits: DataFrame

    def save(self, folder: str) -> Components:
        """Kept as the next version of the folder's table, both parts in one; a run that is lost on the way leaves the version before."""
        both = self.units.withColumn("part", F.lit("units")).unionByName(self.splits.withColumn("part", F.lit("splits")), allowMissingColumns=True)
        VersionedTable(self.units.sparkSession, folder).commit(both, ("part",))
        return Components.load(self.units.sparkSession, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Components:
        """The last version; an empty state where there is none."""
        table = VersionedTable(spark, folder)
        if table.current() is None:
            return cls.empty(spark)
        path = f"{folder.rstrip('/')}/{table.current()}"
        both = spark.read.schema("member string, unit string, split string, images bigint, status string, part string").parquet(path)
        return cls(both.where("part = 'units'").select("member", "unit"), both.where("part = 'splits'").select("unit", "split", "images", "status"))

    @classmethod
    def empty(cls, spark: SparkSession) -> Components:
        return cls(spark.createDataFrame([], "member string, unit string"), spark.createDataFrame([], "unit string, split string, images bigint, status string"))


def advance(spark: SparkSession, before: Components, ids: DataFrame, counts: DataFrame, shares: dict[str, float] = SHARES) -> Components:
    """The state after a batch: ``ids`` with the member lists ``m`` that tie, ``counts`` ``(member, images)`` of new images by one member of theirs.

    Status of a unit: ``kept`` (has the split of the one old unit or several of the same split in it), ``new``, or ``quarantined`` (null split).
    A unit once quarantined stays so. Images of a unit add up over batches.
    """
    scratch = Scratch(spark, "group-splits")
    listed = ids.select("m").unionByName(counts.select(F.array("member").alias("m")))
    units = all_units(spark, listed, "m", scratch, before.units)
    added = counts.join(units, "member").groupBy("unit").agg(F.sum("images").alias("images"))
    old = before.splits.join(units.withColumnRenamed("member", "old").withColumnRenamed("unit", "now"), F.col("unit") == F.col("old")).select(F.col("now").alias("unit"), "split", "images", "status")
    rows = old.unionByName(added.select("unit", F.lit(None).cast("string").alias("split"), "images", F.lit("new").alias("status")))
    seen = rows.groupBy("unit").agg(
        F.sum("images").alias("images"), F.min("split").alias("low"), F.max("split").alias("high"), F.bool_or(F.col("status") == "quarantined").alias("held")
    )
    seen = seen.select("unit", "images", F.when(F.col("held") | (F.col("low") != F.col("high")), "quarantined").when(F.col("low").isNotNull(), "kept").otherwise("new").alias("status"), F.col("low").alias("split"))
    seen = scratch.save(seen, "seen")
    taken = {r[0]: r[1] for r in seen.where("status = 'kept'").groupBy("split").agg(F.sum("images")).collect()}
    filled = fill(seen.where("status = 'new'").select("unit", "images"), taken, shares)
    splits = seen.where("status = 'kept'").select("unit", "split", "images", "status")
    splits = splits.unionByName(filled.withColumn("status", F.lit("new")))
    splits = splits.unionByName(seen.where("status = 'quarantined'").select("unit", F.lit(None).cast("string").alias("split"), "images", "status"))
    return Components(units, scratch.save(splits, "splits"))


def fill(units: DataFrame, taken: dict[str, int], shares: dict[str, float]) -> DataFrame:
    """``(unit, split, images)`` of new ``units`` ``(unit, images)`` such that the splits, with what they have ``taken``, come as near to the shares as the units allow."""
    spark = units.sparkSession
    units = units.withColumn("h", F.xxhash64("unit"))
    total = units.agg(F.coalesce(F.sum("images"), F.lit(0))).first()[0]
    lack = {s: share * (total + sum(taken.values())) - taken.get(s, 0) for s, share in shares.items()}
    large = F.col("images") * LARGE > total
    placed = []
    for unit, images in sorted(((r["unit"], r["images"]) for r in units.where(large).select("unit", "images").collect()), key=lambda x: (-x[1], x[0])):  # fewer than LARGE
        split = max(lack, key=lambda s: lack[s])
        lack[split] -= images
        placed.append((unit, split, images))
    first = spark.createDataFrame(placed, "unit string, split string, images bigint")
    small = units.where(~large).withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    sums = [(r[0], r[1]) for r in small.groupBy("b").agg(F.sum("images")).orderBy("b").collect()]  # at most BUCKETS
    rest, lacking = sum(n for _, n in sums), sum(max(0, x) for x in lack.values())
    order, ends, at = list(shares), [], 0.0
    for s in order:
        at += rest * max(0.0, lack[s]) / lacking if lacking else 0.0
        ends.append(at)
    ends[-1] = float("inf")
    # each bucket lies in one split, or holds a cut: those few are laid out unit by unit
    layout, below = [], 0
    for b, n in sums:
        i, j = (next(k for k, e in enumerate(ends) if x <= e) for x in (below + min(0.5, n / 2), below + n))
        layout.append((b, order[i] if i == j else None, below))
        below += n
    layout = F.broadcast(spark.createDataFrame(layout, "b bigint, whole string, below bigint"))  # at most BUCKETS rows
    small = small.join(layout, "b")
    run = F.sum("images").over(Window.partitionBy("b").orderBy("h", "unit").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("below") + F.col("run") - F.col("images") / 2
    by_unit = F.lit(order[-1])
    for s, e in reversed(list(zip(order[:-1], ends[:-1]))):
        by_unit = F.when(middle <= e, s).otherwise(by_unit)
    cut = small.where("whole IS NULL").withColumn("run", run).select("unit", by_unit.alias("split"), "images")
    return first.unionByName(small.where("whole IS NOT NULL").select("unit", F.col("whole").alias("split"), "images")).unionByName(cut)


def manifest_images(manifest: DataFrame) -> DataFrame:
    """``(image_id, recorded_at, m)`` of each image by its valid row; an image without a group is a group of its own."""
    row = F.max(F.struct("recorded_at", "loaded_at", "group_id"))
    now = manifest.where("image_id IS NOT NULL").groupBy("image_id").agg(row.alias("r"))
    alone = F.array(F.concat(F.lit("image:"), F.col("image_id").cast("string")))
    return now.select("image_id", F.col("r.recorded_at").alias("recorded_at"), F.coalesce(members(F.col("r.group_id")), alone).alias("m"))


def _counts(images: DataFrame) -> DataFrame:
    return images.groupBy(F.col("m")[0].alias("member")).agg(F.count(F.lit(1)).alias("images"))


def _with_units(images: DataFrame, state: Components) -> DataFrame:
    named = images.select("image_id", F.col("m")[0].alias("member")).join(state.units, "member")
    return named.join(state.splits.select("unit", "split", "status"), "unit").select("image_id", F.col("unit").alias("group_id"), "split", "status")


def assign_images(spark: SparkSession, manifest: DataFrame, audit: DataFrame, folder: str | None = None) -> DataFrame:
    """``(image_id, group_id, split, status)``: one split for each unit of images, from an empty state, or from and to the one in ``folder``.

    A state that is carried on keeps its units' splits; the manifest is the whole one each time, so its images are counted anew.
    """
    images = Scratch(spark, "group-splits").save(manifest_images(manifest), "images")
    tied = audit.select(members(F.col("group_id")).alias("m")).where("m IS NOT NULL").unionByName(images.where("size(m) > 1").select("m"))
    before = Components.load(spark, folder) if folder else Components.empty(spark)
    state = advance(spark, Components(before.units, before.splits.withColumn("images", F.lit(0).cast("bigint"))), tied, _counts(images))
    return _with_units(images, state.save(folder) if folder else state)


def assign_in_two_steps(spark: SparkSession, manifest: DataFrame, audit: DataFrame) -> DataFrame:
    """As :func:`assign_images`, but the images of the first half of the recorded time, with their own ties, come first and keep their splits where they can; then the rest, with all ties."""
    scratch = Scratch(spark, "group-splits")
    images = scratch.save(manifest_images(manifest), "images")
    low, high = images.agg(F.min("recorded_at"), F.max("recorded_at")).first()
    late = F.coalesce(F.col("recorded_at") > F.lit(low + (high - low) / 2), F.lit(False)) if low else F.lit(False)
    early, rest = images.where(~late), images.where(late)
    state = advance(spark, Components.empty(spark), early.where("size(m) > 1").select("m"), _counts(early))
    state = state.save(f"{scratch.root}/state")
    tied = audit.select(members(F.col("group_id")).alias("m")).where("m IS NOT NULL").unionByName(rest.where("size(m) > 1").select("m"))
    return _with_units(images, advance(spark, state, tied, _counts(rest)))


def balance(assigned: DataFrame) -> DataFrame:
    """Images and units per split and status."""
    return assigned.groupBy("split", "status").agg(F.count(F.lit(1)).alias("images"), F.countDistinct("group_id").alias("units"))
