"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkyard.functions import sql
from sparkyard.llm import canonical, chunking, components, group_splits, leakage, overlap, tokenizer
from sparkyard.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.image_groups(spark, table(spark, d, "near_duplicate_pairs"))


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    return p1_found(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("images")).groupBy("images").agg(F.count(F.lit(1)).alias("n_groups"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(spark, table(spark, d, "manifest"), table(spark, d, "fingerprints"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(spark, table(spark, d, "manifest"), table(spark, d, "fingerprints"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.mapped_classes(spark, table(spark, d, "raw_class_mapping_audit"), table(spark, d, "class_reference"), ranked=False).select("audit_id", "class_id")


def p5_mapping(spark: SparkSession, d: str) -> DataFrame:
    return canonical.mapped_classes(spark, table(spark, d, "raw_class_mapping_audit"), table(spark, d, "class_reference"))


def p5_misses(spark: SparkSession, d: str) -> DataFrame:
    return canonical.misses(spark, table(spark, d, "raw_class_mapping_audit"), table(spark, d, "class_reference"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return group_splits.divided_units(spark, table(spark, d, "group_split_audit"))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return group_splits.assign_images(spark, table(spark, d, "manifest"), table(spark, d, "group_split_audit"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """The unit of each image, and whether it has just one split."""
    x = p6_assignment(spark, d)
    one = x.groupBy("group_id").agg((F.count_distinct("split") <= 1).alias("one_split"))
    return x.join(one, "group_id").select("image_id", "group_id", "one_split")


def p6_balance(spark: SparkSession, d: str) -> DataFrame:
    return group_splits.balance(p6_assignment(spark, d))


def p6_in_two_steps(spark: SparkSession, d: str) -> DataFrame:
    return group_splits.balance(group_splits.assign_in_two_steps(spark, table(spark, d, "manifest"), table(spark, d, "group_split_audit")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(spark, table(spark, d, "documents"), "text", ["doc_id"])


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Decoded again: the texts that encoding lost anything of; none."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tokenizer.decode(spark, tokenizer.encode(spark, docs, "text", ["doc_id", "text"]), "ids", ["doc_id", "text"], out="decoded")
    return back.select("doc_id", (F.col("decoded") == F.col("text")).alias("same"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(spark, table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """With up to two words of a run inserted, deleted or changed."""
    return leakage.leaked_items(spark, table(spark, d, "documents"), table(spark, d, "eval_items"), edits=2)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p8_found(spark, d), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(spark, table(spark, d, "documents"), with_text=False).where("piece_no = 0").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(spark, table(spark, d, "documents"))


def p9_problems(spark: SparkSession, d: str) -> DataFrame:
    """How many pieces break a rule, by rule; none do. Whole texts are put together again from their pieces."""
    x = p9_pieces(spark, d)
    after = Window.partitionBy("doc_id").orderBy("piece_no")
    x = x.withColumn("before", F.lag("end_char").over(after)).withColumn("started", F.lag("start_char").over(after))
    # what a piece adds to the text before it; positions are counted in code points, as length and substring do
    x = x.withColumn("adds", F.substring("piece", F.coalesce(F.col("before") - F.col("start_char"), F.lit(0)) + 1, F.length("piece")))
    rules = {
        "over_limit": F.col("n_tokens") > chunking.LIMIT,
        "gap": F.coalesce(F.col("start_char") > F.col("before"), F.col("start_char") > 0),
        "no_progress": (F.col("start_char") <= F.col("started")) | (F.col("end_char") <= F.col("before")),
        "length": F.length("piece") != F.col("end_char") - F.col("start_char"),
    }
    broken = x.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    again = x.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "adds"))), lambda p: p["adds"]), "").alias("again"))  # one text each
    other = again.join(table(spark, d, "documents"), "doc_id").agg(F.count_if(F.col("again") != F.col("text")).alias("not_the_text"))
    rows = [(n, t) for t in (broken, other) for n in t.columns]
    out = [t.select(F.lit(n).alias("rule"), F.col(n).alias("n")) for n, t in rows]
    return reduce(DataFrame.unionByName, out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_group_sizes": p1_group_sizes,
        "p2_found": p2_found,
        "p2_counts": p2_counts,
        "p5_found": p5_found,
        "p5_mapping": p5_mapping,
        "p5_misses": p5_misses,
        "p6_found": p6_found,
        "p6_assignment": p6_assignment,
        "p6_groups": p6_groups,
        "p6_balance": p6_balance,
        "p6_in_two_steps": p6_in_two_steps,
        "p7_ids": p7_ids,
        "p7_round_trip": p7_round_trip,
        "p8_found": p8_found,
        "p8_near": p8_near,
        "p8_report": p8_report,
        "p9_found": p9_found,
        "p9_pieces": p9_pieces,
        "p9_problems": p9_problems,
    }


P1_SQL = f"""
WITH RECURSIVE decided AS (
  SELECT least(x, y) AS a, greatest(x, y) AS b, arg_max(ok, (audited_at, ok)) AS ok
  FROM (SELECT {sql.file_name("image_a")} AS x, {sql.file_name("image_b")} AS y, audited_at, coalesce(visual_review = '{components.LINKS}', false) AS ok FROM near_duplicate_pairs)
  WHERE x <> y GROUP BY 1, 2),
e AS (SELECT a AS s, b AS t FROM decided WHERE ok UNION SELECT b, a FROM decided WHERE ok),
r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
g AS (SELECT s AS image, least(s, min(t)) AS group_id FROM r GROUP BY s)
"""

P2_SQL = f"""
WITH m AS (SELECT image_id, source, {sql.split_name("split")} AS split, {sql.folded("sha1")} AS sha1 FROM manifest
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY recorded_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1),
f AS (SELECT image_id, phash, dhash FROM fingerprints QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY computed_at DESC NULLS LAST, phash DESC NULLS LAST, dhash DESC NULLS LAST) = 1),
x AS (SELECT * FROM m LEFT JOIN f USING (image_id) WHERE split IN ('train', 'val', 'test')),
p AS (SELECT t.image_id AS t, e.image_id AS e, coalesce(t.sha1 = e.sha1, false) AS exact, coalesce(bit_count(xor(t.phash, e.phash)) <= {overlap.P_BITS} AND bit_count(xor(t.dhash, e.dhash)) <= {overlap.D_BITS}, false) AS near
  FROM x t, x e WHERE t.split = 'train' AND e.split <> 'train' AND (t.sha1 = e.sha1 OR (bit_count(xor(t.phash, e.phash)) <= {overlap.P_BITS} AND bit_count(xor(t.dhash, e.dhash)) <= {overlap.D_BITS}))),
h AS (SELECT e AS image_id, bool_or(exact) AS exact, bool_or(near) AS near, count(*) AS n_pairs FROM p GROUP BY 1)
"""

P6_SQL = f"""
WITH RECURSIVE a AS (SELECT source, list_filter(list_transform(string_split(lower(group_id), '+'), lambda x: {sql.strip("x")}), lambda x: x <> '') AS m,
    list_filter(list_transform(string_split_regex(coalesce(final_splits, ''), '[;,]'), lambda x: {sql.split_name("x")}), lambda x: x IS NOT NULL) AS splits FROM group_split_audit),
rows AS (SELECT * FROM a WHERE len(m) > 0),
e AS (SELECT m[1] AS s, unnest(m) AS t FROM rows UNION SELECT unnest(m), m[1] FROM rows),
r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
u AS (SELECT s AS member, min(t) AS unit FROM r GROUP BY 1)
"""


P6_ALL_SQL = f"""
WITH RECURSIVE i AS (SELECT image_id, list_filter(list_transform(string_split(lower(group_id), '+'), lambda x: {sql.strip("x")}), lambda x: x <> '') AS m FROM manifest WHERE image_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY recorded_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1),
j AS (SELECT image_id, CASE WHEN len(m) > 0 THEN m ELSE ['image:' || image_id] END AS m FROM i),
lists AS (SELECT m FROM j UNION ALL SELECT list_filter(list_transform(string_split(lower(group_id), '+'), lambda x: {sql.strip("x")}), lambda x: x <> '') FROM group_split_audit),
e AS (SELECT m[1] AS s, unnest(m) AS t FROM lists WHERE len(m) > 0 UNION SELECT unnest(m), m[1] FROM lists WHERE len(m) > 0),
r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
u AS (SELECT s AS member, min(t) AS unit FROM r GROUP BY 1)
SELECT image_id, unit AS group_id, true AS one_split FROM j JOIN u ON m[1] = member
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL + "SELECT image, group_id FROM g",
        "p1_group_sizes": P1_SQL + "SELECT images, count(*) AS n_groups FROM (SELECT group_id, count(*) AS images FROM g GROUP BY 1) GROUP BY 1",
        "p6_found": P6_SQL + "SELECT min(source) AS source, unit AS group_id FROM (SELECT source, unit, unnest(splits) AS split FROM rows JOIN u ON m[1] = member) GROUP BY unit HAVING count(DISTINCT split) > 1",
        "p6_groups": P6_ALL_SQL,
        "p9_problems": "SELECT unnest(['over_limit', 'gap', 'no_progress', 'length', 'not_the_text']) AS rule, 0 AS n",
        "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
        "p2_found": P2_SQL + "SELECT least(t, e) AS image_id_a, greatest(t, e) AS image_id_b FROM p",
        "p2_counts": P2_SQL + "SELECT split, source, count(*) AS images, count(*) FILTER (exact) AS exact, count(*) FILTER (near) AS near, count(n_pairs) AS leaked, coalesce(sum(n_pairs), 0)::BIGINT AS pairs FROM x LEFT JOIN h USING (image_id) WHERE split <> 'train' GROUP BY ALL",
    }
