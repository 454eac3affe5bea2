"""Groups moved between splits: closure over past groups, greedy assignment, coordinate descent, move plans and reports."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkyard.operators import graph
from sparkyard.session import Scratch

SPLITS = ("train", "val", "test")
#: Fixed value: the seed of the random restarts.
SEED = 20260922
#: Rows of a summary (one per source, group, split and class) that a sequential assignment takes to the driver at most.
MAX_SUMMARY = 2_000_000


def historical_closure(spark: SparkSession, memberships: DataFrame) -> DataFrame:
    """``(member, component)``: members that shared a group in any snapshot, directly or over others.

    ``memberships`` is ``(snapshot, source, group_id, member)``. Each group is a star around its smallest member, so edges grow with rows, not with their pairs.
    """
    x = memberships.where("group_id IS NOT NULL AND member IS NOT NULL")
    head = x.groupBy("snapshot", "source", "group_id").agg(F.min("member").alias("head"))
    edges = x.join(head, ["snapshot", "source", "group_id"]).select(F.col("head").alias("a"), F.col("member").alias("b")).distinct()
    return graph.components(spark, edges).select(F.col("node").alias("member"), "component")


def closure_id(spark: SparkSession, members: DataFrame, new_ids: DataFrame | None = None) -> DataFrame:
    """``(component, n, closure_id)`` of components ``(member, component)``.

    A component that holds members of newly confirmed groups, given as ``new_ids`` ``(member, new_id)``, has their ids in order, joined by ``+``. All others have
    ``historical_closure_`` and 12 digits of the SHA-256 of their members in order, joined by ``|``. Such a digest is sequential: a component's members stream in order
    through one task, which holds one batch of them at a time; sorting spills.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = members.select("component", "member").where("component IS NOT NULL AND member IS NOT NULL").distinct().repartition(n, "component").sortWithinPartitions("component", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, state = None, 0, hashlib.sha256()
        for b in batches:
            out: list[tuple[str, int, str]] = []
            for c, m in zip(b.column("component").to_pylist(), b.column("member").to_pylist()):
                if c != now:
                    if size:
                        out.append((now, size, state.hexdigest()[:12]))
                    now, size, state = c, 0, hashlib.sha256()
                state.update(("|" if size else "").encode() + m.encode())
                size += 1
            yield _ids_batch(out)
        if size:
            yield _ids_batch([(now, size, state.hexdigest()[:12])])

    out = x.mapInArrow(run, "component string, n bigint, digest string").withColumn("closure_id", F.concat(F.lit("historical_closure_"), "digest")).drop("digest")
    if new_ids is None:
        return out
    new = new_ids.where("new_id IS NOT NULL").join(members.select("member", "component"), "member").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("new_id")), "+").alias("new"))
    return out.join(new, "component", "left").select("component", "n", F.coalesce("new", "closure_id").alias("closure_id"))


def _ids_batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["component", "n", "digest"])


def group_summary(images: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images per (source, group, split) and boxes per (source, group, split, class), from :func:`_saved` tables; rows without a group are out."""
    x = images.where("group_id IS NOT NULL AND split IS NOT NULL")
    n = x.groupBy("source", "group_id", "split").agg(F.count(F.lit(1)).alias("images"))
    b = boxes.join(x, "image_id").groupBy("source", "group_id", "split", "class").agg(F.sum("n").alias("boxes"))
    return n, b


def _saved(spark: SparkSession, images: DataFrame, boxes: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """The columns of the images that summaries take, and boxes counted by image and class; written, as both are read several times."""
    scratch = Scratch(spark, "rebalance")
    x = images.select("image_id", "source", "group_id", F.col(split).alias("split")).where("split IS NOT NULL")
    return scratch.save(x, "images"), scratch.save(boxes.groupBy("image_id", "class").agg(F.count(F.lit(1)).alias("n")), "boxes")


def _collect(df: DataFrame) -> list:
    rows = df.limit(MAX_SUMMARY + 1).collect()
    if len(rows) > MAX_SUMMARY:
        raise ValueError(f"more than {MAX_SUMMARY} summary rows; split the sources into runs")
    return rows


def greedy_assignment(spark: SparkSession, images: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(source, group_id, images, destination)`` for each group whose images come from several splits (``original_split``).

    Sequential by nature: largest group first, each to the split where squared deviations from the original image counts, and
    with weight 0.15 from the box counts by class, stay least; ties by a digest of group and split. Runs on the driver over the
    per-group summary of the groups with a group id only, whose size is checked.
    """
    n, b = (_collect(x) for x in group_summary(*_saved(spark, images, boxes, "original_split")))
    out = []
    for source in sorted({r["source"] for r in n}):
        count, held = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
        want_images, want_boxes = defaultdict(int), defaultdict(lambda: defaultdict(int))
        for r in n:
            if r["source"] == source:
                count[r["group_id"]][r["split"]] += r["images"]
                want_images[r["split"]] += r["images"]
        for r in b:
            if r["source"] == source:
                held[r["group_id"]][r["class"]] += r["boxes"]
                want_boxes[r["split"]][r["class"]] += r["boxes"]
        now_images, now_boxes = defaultdict(int), defaultdict(lambda: defaultdict(int))
        fixed = {g: next(iter(c)) for g, c in count.items() if len(c) == 1}
        for g, split in fixed.items():
            now_images[split] += sum(count[g].values())
            for k, v in held[g].items():
                now_boxes[split][k] += v
        splits = [s for s in SPLITS if want_images[s]]

        def cost(have: float, want: float) -> float:
            return (have - want) ** 2 / max(want, 1)

        for g in sorted((g for g in count if g not in fixed), key=lambda g: (-sum(count[g].values()), g)):
            size, best = sum(count[g].values()), None
            for target in splits:
                score = sum(cost(now_images[s] + size * (s == target), want_images[s]) for s in splits)
                for s in splits:
                    for k in want_boxes[s].keys() | held[g].keys():
                        score += 0.15 * cost(now_boxes[s][k] + held[g][k] * (s == target), want_boxes[s][k])
                tie = hashlib.sha1(f"{g}:{target}".encode()).hexdigest()
                best = min(best or (score, tie, target), (score, tie, target))
            now_images[best[2]] += size
            for k, v in held[g].items():
                now_boxes[best[2]][k] += v
            out.append((source, g, size, best[2]))
    return spark.createDataFrame(out, "source string, group_id string, images bigint, destination string")


def descend(groups: list[dict], total_images: dict[str, int], total_boxes: dict[tuple[str, str], int], restarts: int = 80, rng: random.Random | None = None) -> tuple[dict[str, str], float]:
    """Destinations of the groups of one source that change its image and box counts least.

    Each group: ``id``, ``images`` by split, ``boxes`` by (split, class). It may only go where most of its images are. Objective: twice the
    summed image changes over all images, plus the mean over classes of the summed box changes over the class's boxes. Coordinate descent
    from the first choices, then from random ones; changes are kept as sums, so trying a move costs the size of the group.
    """
    rng = rng or random.Random(SEED)
    n_images = max(1, sum(total_images.values()))
    per_class: dict[str, int] = defaultdict(int)
    for (_, c), n in total_boxes.items():
        per_class[c] += n
    live = [c for c, n in per_class.items() if n]
    choices = {}
    for g in groups:
        top = max(g["images"].values())
        choices[g["id"]] = [s for s in SPLITS if g["images"].get(s, 0) == top]

    changed: dict[str, int] = defaultdict(int)  # the summed box changes of each class, of the counts that ``shift`` works on

    def add(db, key, n):
        changed[key[1]] += abs(db[key] + n) - abs(db[key])
        db[key] += n

    def shift(di, db, g, to, sign):
        for s, n in g["images"].items():
            if s != to:
                di[s] -= sign * n
                di[to] += sign * n
        for (s, c), n in g["boxes"].items():
            if s != to:
                add(db, (s, c), -sign * n)
                add(db, (to, c), sign * n)

    def score(di):
        boxes = sum(changed[c] / per_class[c] for c in live)
        return 2 * sum(map(abs, di.values())) / n_images + boxes / max(1, len(live))

    best: tuple[float, dict] = (float("inf"), {})
    for restart in range(restarts):
        now = {g["id"]: choices[g["id"]][0] if restart == 0 else rng.choice(choices[g["id"]]) for g in groups}
        di, db = defaultdict(int), defaultdict(int)
        changed.clear()
        for g in groups:
            shift(di, db, g, now[g["id"]], 1)
        moved = True
        while moved:
            moved = False
            for g in groups:
                old = now[g["id"]]
                value, to = score(di), old
                for s in choices[g["id"]]:
                    if s == old:
                        continue
                    shift(di, db, g, old, -1)
                    shift(di, db, g, s, 1)
                    if (v := score(di)) < value - 1e-12:
                        value, to = v, s
                    shift(di, db, g, s, -1)
                    shift(di, db, g, old, 1)
                if to != old:
                    shift(di, db, g, old, -1)
                    shift(di, db, g, to, 1)
                    now[g["id"]], moved = to, True
        if (v := score(di)) < best[0] - 1e-12:
            best = (v, dict(now))
    return best[1], 0.0 if best[0] == float("inf") else best[0]


def rebalance(spark: SparkSession, images: DataFrame, boxes: DataFrame, restarts: int = 80) -> DataFrame:
    """``(source, group_id, destination)`` of each group over several splits, by :func:`descend` over the checked summary."""
    images, boxes = _saved(spark, images, boxes)
    n, b = group_summary(images, boxes)
    several = n.groupBy("source", "group_id").agg(F.countDistinct("split").alias("k")).where("k > 1").drop("k")
    rows, held = _collect(n.join(several, ["source", "group_id"])), _collect(b.join(several, ["source", "group_id"]))
    images_of = {(r[0], r[1]): r[2] for r in images.groupBy("source", "split").count().collect()}
    boxes_of = {(r[0], r[1], r[2]): r[3] for r in boxes.join(images, "image_id").groupBy("source", "split", "class").agg(F.sum("n")).collect()}
    out, rng = [], random.Random(SEED)  # one generator for all sources, in their order
    for source in sorted({r["source"] for r in rows}):
        groups: dict[str, dict] = {}
        for r in rows:
            if r["source"] == source:
                groups.setdefault(r["group_id"], {"id": r["group_id"], "images": {}, "boxes": {}})["images"][r["split"]] = r["images"]
        for r in held:
            if r["source"] == source:
                groups[r["group_id"]]["boxes"][r["split"], r["class"]] = r["boxes"]
        found, _ = descend([groups[g] for g in sorted(groups)], {s: n for (o, s), n in images_of.items() if o == source}, {(s, c): n for (o, s, c), n in boxes_of.items() if o == source}, restarts, rng)
        out += [(source, g, s) for g, s in found.items()]
    return spark.createDataFrame(out, "source string, group_id string, destination string")


def move_plan(images: DataFrame, destinations: DataFrame) -> DataFrame:
    """One row per image that isn't where its group goes, with its old and new path and its content digest."""
    from sparkyard.functions.names import moved_path

    x = images.join(destinations, ["source", "group_id"]).where("split <> destination")
    return x.select("image_id", "source", "group_id", F.col("split").alias("from_split"), F.col("destination").alias("to_split"), F.col("output_image").alias("old_image"), moved_path(F.col("output_image"), F.col("destination")).alias("new_image"), *(["sha1"] if "sha1" in images.columns else []))


def unresolved_members(groups: DataFrame, images: DataFrame) -> DataFrame:
    """``(source, member, problem)`` of group members that the images don't have (``missing``) or have in another source (``other_source``); a plan is made of none."""
    have = images.groupBy(F.col("image").alias("member")).agg(F.collect_set("source").alias("sources"))  # the sources of one image
    x = groups.select("source", "member").distinct().join(have, "member", "left")
    problem = F.when(F.col("sources").isNull(), "missing").when(~F.array_contains("sources", F.col("source")), "other_source")
    return x.select("source", "member", problem.alias("problem")).where("problem IS NOT NULL")


def apply_moves(images: DataFrame, plan: DataFrame) -> DataFrame:
    """The images after the plan: those in it have its split and path, all others are as they were."""
    p = plan.groupBy("image").agg(F.max("to_split").alias("to_split"), F.max("new_image").alias("new_image"))
    return images.join(p, "image", "left").withColumn("split", F.coalesce("to_split", "split")).withColumn("output_image", F.coalesce("new_image", "output_image")).drop("to_split", "new_image")


def direction_report(moves: DataFrame) -> DataFrame:
    """Moves per snapshot, source and direction, with distinct images."""
    return moves.groupBy("snapshot_date", "source", F.concat("from_split", F.lit("->"), "to_split").alias("direction")).agg(F.count(F.lit(1)).alias("moves"), F.countDistinct("image").alias("images"))


def split_deltas(moves: DataFrame) -> DataFrame:
    """Images each split of a source gains or loses by the moves of a snapshot."""
    ends = F.array(F.struct(F.col("from_split").alias("split"), F.lit(-1).alias("d")), F.struct(F.col("to_split").alias("split"), F.lit(1).alias("d")))
    return moves.select("snapshot_date", "source", F.explode(ends).alias("e")).groupBy("snapshot_date", "source", "e.split").agg(F.sum("e.d").alias("delta"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of either side by the keys, 0 where a side has none, and their difference."""
    count = lambda x, n: x.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    both = count(before, "before").join(count(after, "after"), keys, "full")
    z = lambda c: F.coalesce(c, F.lit(0))
    return both.select(*keys, z("before").alias("before"), z("after").alias("after"), (z("after") - z("before")).alias("delta"))


def balance_of(changes: DataFrame) -> DataFrame:
    """Per source the largest and the summed change and the sum before."""
    return changes.groupBy("source").agg(F.max(F.abs("delta")).alias("max_delta"), F.sum(F.abs("delta")).alias("sum_delta"), F.sum("before").alias("total"))


def least_moves(images: DataFrame) -> DataFrame:
    """Per source how many images must move at least for every group to be in one split: all but those of its largest part."""
    n = images.where("group_id IS NOT NULL AND split IS NOT NULL").groupBy("source", "group_id", "split").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("source", "group_id").agg((F.sum("n") - F.max("n")).alias("m")).groupBy("source").agg(F.sum("m").alias("least_moves"))
