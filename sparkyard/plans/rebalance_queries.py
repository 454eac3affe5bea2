"""Queries over groups, moves and before/after reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkyard.functions import sql
from sparkyard.functions.text import file_name, folded, path_text, split_name
from sparkyard.operators import labels, rebalance
from sparkyard.sources.adapters import IMAGES_SQL, images, raw_boxes
from sparkyard.sources.tables import table


def _moves(s, d):
    """The valid move of each image in each snapshot."""
    c = F.col
    row = F.max(F.struct("delivered_at", "source", folded(c("group_id")).alias("group_id"), split_name(c("from_split")).alias("from_split"), split_name(c("to_split")).alias("to_split"), path_text(c("new_image")).alias("new_image")))
    x = table(s, d, "move_plan_snapshots").withColumn("image", file_name(c("old_image"))).where("image IS NOT NULL")
    return x.groupBy("snapshot_date", "image").agg(row.alias("r")).select("snapshot_date", "image", "r.*")


def _last(s, d):
    m = _moves(s, d)
    return m.join(m.agg(F.max("snapshot_date").alias("snapshot_date")), "snapshot_date")


def _boxes(s, d):
    return labels.clean_boxes(raw_boxes(s, d))


def _closure(s, d):
    old = _moves(s, d).select(F.col("snapshot_date").cast("string").alias("snapshot"), "source", "group_id", F.col("image").alias("member"))
    now = images(s, d).select(F.lit("now").alias("snapshot"), "source", "group_id", F.col("image").alias("member"))
    return rebalance.historical_closure(s, old.unionByName(now))


def _closure_report(s, d):
    """Components of the closure whose images lie in several splits."""
    at = images(s, d).select(F.col("image").alias("member"), "source", "split")
    c = _closure(s, d).join(at, "member").groupBy("component").agg(F.count(F.lit(1)).alias("images"), F.array_join(F.array_sort(F.collect_set("split")), ";").alias("splits"), F.countDistinct("split").alias("k"))
    return c.where("k > 1").select("component", "images", "splits")


def _audit(s, d):
    lists = [F.array_join(F.array_sort(F.collect_set(c)), ";").alias(f"{c}s") for c in ("original_split", "split")]
    return images(s, d).where("group_id IS NOT NULL").groupBy("source", "group_id").agg(F.count(F.lit(1)).alias("image_count"), *lists)


def _balance(s, d):
    before = images(s, d).where("split IS NOT NULL")
    after = rebalance.apply_moves(before, _last(s, d).select("image", "to_split", "new_image"))
    return rebalance.before_after(before, after, ["source", "split"])


def _class_balance(s, d):
    before = images(s, d)
    after = rebalance.apply_moves(before, _last(s, d).select("image", "to_split", "new_image"))
    b = _boxes(s, d).select("image_id", "class")
    return rebalance.balance_of(rebalance.before_after(b.join(before, "image_id"), b.join(after, "image_id"), ["source", "split", "class"]))


def queries() -> dict:
    return {
        "group_audit": _audit,
        "historical_closure": lambda s, d: _closure(s, d),
        "historical_leakage": _closure_report,
        "closure_ids": lambda s, d: rebalance.closure_id(s, _closure(s, d)),
        "closure_merged_ids": lambda s, d: rebalance.closure_id(s, _closure(s, d), _last(s, d).select(F.col("image").alias("member"), F.col("group_id").alias("new_id"))),
        "unresolved_members": lambda s, d: rebalance.unresolved_members(_moves(s, d).select("source", F.col("image").alias("member")), images(s, d)),
        "group_split_assign": lambda s, d: rebalance.greedy_assignment(s, images(s, d), _boxes(s, d)),
        "rebalance_plan": lambda s, d: rebalance.move_plan(images(s, d), rebalance.rebalance(s, images(s, d), _boxes(s, d))),
        "rebalance_moves": lambda s, d: queries()["rebalance_plan"](s, d).groupBy("source").agg(F.count(F.lit(1)).alias("moves"), F.count_distinct("group_id").alias("groups")),
        "group_split_groups": lambda s, d: rebalance.greedy_assignment(s, images(s, d), _boxes(s, d)).select("source", "group_id", "images", F.col("destination").isin(*rebalance.SPLITS).alias("assigned")),
        "least_moves": lambda s, d: rebalance.least_moves(images(s, d)),
        "apply_moves": lambda s, d: rebalance.apply_moves(images(s, d), _last(s, d).select("image", "to_split", "new_image")).select("image_id", "split", "output_image"),
        "move_directions": lambda s, d: rebalance.direction_report(_moves(s, d)),
        "move_deltas": lambda s, d: rebalance.split_deltas(_moves(s, d)),
        "split_balance": _balance,
        "class_balance": _class_balance,
    }


SQL = f"""
WITH RECURSIVE {IMAGES_SQL}, mp AS (SELECT snapshot_date, source, delivered_at, {sql.folded("group_id")} AS group_id, {sql.split_name("from_split")} AS from_split, {sql.split_name("to_split")} AS to_split, {sql.path_text("new_image")} AS new_image, {sql.file_name("old_image")} AS image FROM move_plan_snapshots),
moves AS (SELECT * FROM mp WHERE image IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_date, image ORDER BY delivered_at DESC NULLS LAST, source DESC NULLS LAST, group_id DESC NULLS LAST, from_split DESC NULLS LAST, to_split DESC NULLS LAST, new_image DESC NULLS LAST) = 1),
last AS (SELECT * FROM moves WHERE snapshot_date = (SELECT max(snapshot_date) FROM moves)),
after AS (SELECT i.* EXCLUDE (split, output_image), coalesce(to_split, split) AS split, coalesce(new_image, output_image) AS output_image FROM images i LEFT JOIN last USING (image)),
mem AS (SELECT snapshot_date::VARCHAR AS snapshot, source, group_id, image AS member FROM moves UNION ALL SELECT 'now', source, group_id, image FROM images),
grp AS (SELECT *, min(member) OVER (PARTITION BY snapshot, source, group_id) AS head FROM mem WHERE group_id IS NOT NULL AND member IS NOT NULL),
e AS (SELECT head AS s, member AS t FROM grp UNION SELECT member, head FROM grp),
r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
closure AS (SELECT s AS member, min(t) AS component FROM r GROUP BY 1),
digests AS (SELECT component, count(*) AS n, left(sha256(string_agg(member, '|' ORDER BY member)), 12) AS digest FROM closure GROUP BY 1)
"""


def _sql_before_after(keys: str, before: str, after: str) -> str:
    return f"SELECT {keys}, coalesce(b, 0) AS before, coalesce(a, 0) AS after, coalesce(a, 0) - coalesce(b, 0) AS delta FROM (SELECT {keys}, count(*) AS b FROM {before} GROUP BY ALL) FULL JOIN (SELECT {keys}, count(*) AS a FROM {after} GROUP BY ALL) USING ({keys})"


def oracle_sql() -> dict:
    from sparkyard.plans import label_queries

    boxes = label_queries.SQL.replace("WITH ", "WITH RECURSIVE ", 1) + SQL[SQL.index(", mp AS") :]
    agg = lambda c: f"coalesce(string_agg(DISTINCT {c}, ';' ORDER BY {c}), '') AS {c}s"
    return {
        "group_audit": SQL + f"SELECT source, group_id, count(*) AS image_count, {agg('original_split')}, {agg('split')} FROM images WHERE group_id IS NOT NULL GROUP BY ALL",
        "historical_closure": SQL + "SELECT * FROM closure",
        "closure_ids": SQL + "SELECT component, n, 'historical_closure_' || digest AS closure_id FROM digests",
        "closure_merged_ids": SQL + "SELECT component, n, coalesce(new, 'historical_closure_' || digest) AS closure_id FROM digests LEFT JOIN (SELECT component, string_agg(DISTINCT last.group_id, '+' ORDER BY last.group_id) AS new FROM last JOIN closure ON last.image = closure.member WHERE last.group_id IS NOT NULL GROUP BY 1) USING (component)",
        "unresolved_members": SQL + "SELECT m.source, m.image AS member, CASE WHEN h.image IS NULL THEN 'missing' ELSE 'other_source' END AS problem FROM (SELECT DISTINCT source, image FROM moves) m LEFT JOIN (SELECT image, list(DISTINCT source) AS sources FROM images WHERE image IS NOT NULL GROUP BY 1) h ON h.image = m.image WHERE h.image IS NULL OR NOT list_contains(sources, m.source)",
        "historical_leakage": SQL + "SELECT component, count(*) AS images, string_agg(DISTINCT split, ';' ORDER BY split) AS splits FROM closure JOIN images ON member = image GROUP BY 1 HAVING count(DISTINCT split) > 1",
        # every group goes where most of its images are, so a plan moves the least number there is
        "rebalance_moves": SQL + "SELECT source, sum(m)::BIGINT AS moves, count(*) AS groups FROM (SELECT source, group_id, sum(n) - max(n) AS m FROM (SELECT source, group_id, split, count(*) AS n FROM images WHERE group_id IS NOT NULL AND split IS NOT NULL GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1) GROUP BY 1",
        "group_split_groups": SQL + "SELECT source, group_id, count(*) AS images, true AS assigned FROM images WHERE group_id IS NOT NULL AND original_split IS NOT NULL GROUP BY ALL HAVING count(DISTINCT original_split) > 1",
        "least_moves": SQL + "SELECT source, sum(m)::BIGINT AS least_moves FROM (SELECT source, group_id, sum(n) - max(n) AS m FROM (SELECT source, group_id, split, count(*) AS n FROM images WHERE group_id IS NOT NULL AND split IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY 1",
        "apply_moves": SQL + "SELECT image_id, split, output_image FROM after",
        "move_directions": SQL + "SELECT snapshot_date, source, from_split || '->' || to_split AS direction, count(*) AS moves, count(DISTINCT image) AS images FROM moves GROUP BY ALL",
        "move_deltas": SQL + "SELECT snapshot_date, source, split, sum(d)::BIGINT AS delta FROM (SELECT snapshot_date, source, from_split AS split, -1 AS d FROM moves UNION ALL SELECT snapshot_date, source, to_split, 1 FROM moves) GROUP BY ALL",
        "class_balance": boxes + ", c AS (" + _sql_before_after("source, split, class", "(SELECT source, split, class FROM boxes JOIN images USING (image_id))", "(SELECT source, split, class FROM boxes JOIN after USING (image_id))") + ") SELECT source, max(abs(delta)) AS max_delta, sum(abs(delta))::BIGINT AS sum_delta, sum(before)::BIGINT AS total FROM c GROUP BY 1",
        "split_balance": SQL + _sql_before_after("source, split", "(FROM images WHERE split IS NOT NULL)", "(SELECT a.* FROM after a JOIN images i USING (image_id) WHERE i.split IS NOT NULL)"),
    }
