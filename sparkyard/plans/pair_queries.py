"""Queries over audited pairs, fingerprints and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkyard.functions import names as nm
from sparkyard.functions import sql
from sparkyard.functions import vectors as vx
from sparkyard.functions.text import file_name, split_name
from sparkyard.operators import graph, pairs
from sparkyard.operators.ranking import row_numbers
from sparkyard.session import Scratch
from sparkyard.sources.adapters import IMAGES_SQL, images
from sparkyard.sources.tables import table


#: The sources that the audit looks at.
SCOPE = ("d6", "d7")


def _items(s, d):
    f = table(s, d, "fingerprints").groupBy("image_id").agg(F.max(F.struct("computed_at", "phash", "dhash")).alias("f"))
    return images(s, d).select(F.col("image_id").alias("id"), "source", "split").join(f.select(F.col("image_id").alias("id"), "f.phash", "f.dhash"), "id")


def decided(s, d):
    """The latest row of each unordered pair of images, oriented by name, with its metrics."""
    x = table(s, d, "near_duplicate_pairs").withColumn("ia", file_name(F.col("image_a"))).withColumn("ib", file_name(F.col("image_b"))).where("ia <> ib")
    side = lambda lo, c: F.when(F.col("ia") < F.col("ib"), F.col(c + ("_a" if lo else "_b"))).otherwise(F.col(c + ("_b" if lo else "_a")))
    row = F.max(F.struct("audited_at", "visual_review", "source", split_name(side(True, "split")).alias("split_a"), split_name(side(False, "split")).alias("split_b"), "phash_distance", "dhash_distance", "pixel_ncc", "pixel_mae", "color_hist_cosine", "same_filename_family", "frame_delta"))
    return x.groupBy(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).agg(row.alias("r")).select("a", "b", "r.*")


def _scored(s, d):
    c = F.col
    x = decided(s, d).withColumn("pair_id", pairs.pair_id(c("a"), c("b"))).withColumn("audit_key", F.concat("a", F.lit("|"), "b"))
    delta = F.when(c("same_filename_family"), c("frame_delta"))
    x = x.withColumn("suspicion_score", F.round(pairs.suspicion(c("phash_distance"), c("dhash_distance"), c("pixel_ncc"), c("color_hist_cosine"), delta), 9))
    return x.withColumn("metric_verdict", pairs.triage(c("phash_distance"), c("dhash_distance"), c("pixel_ncc"), c("pixel_mae"), c("same_filename_family"), c("frame_delta")))


def _reviewed(s, d):
    x = pairs.ranked(_scored(s, d))
    listed = decided(s, d).where(f"visual_review = '{pairs.HIGH}'").select(pairs.pair_id(F.col("a"), F.col("b")).alias("pair_id"))
    return pairs.reviewed(x, listed)


def _edges(s, d):
    """Edges that make groups: confirmed pairs; outside of d6 also near frames that look alike."""
    x = decided(s, d).withColumn("confirmed", F.coalesce(F.col("visual_review") == pairs.HIGH, F.lit(False)))
    delta = F.abs(nm.frame_number(F.col("a")) - nm.frame_number(F.col("b")))
    sequence = F.coalesce((delta <= 30) & (F.col("pixel_ncc") >= 0.9) & (F.col("phash_distance") <= 12), F.lit(False))
    return x.where(F.col("confirmed") | ((F.col("source") != "d6") & sequence)).select("source", "a", "b", "split_a", "split_b", "confirmed")


def _members(s, d):
    scratch = Scratch(s, "pairs")
    e = scratch.save(_edges(s, d), "edges")  # read by the rounds, for the nodes and for the report
    comp = scratch.save(graph.components(s, e.select("a", "b")), "components")
    node = e.select(F.explode(F.array(F.struct("source", F.col("a").alias("node"), F.col("split_a").alias("split")), F.struct("source", F.col("b").alias("node"), F.col("split_b").alias("split")))).alias("n")).select("n.*")
    node = node.groupBy("node").agg(F.min("source").alias("source"), F.min("split").alias("split"))
    return node.join(comp, "node").withColumn("frame", nm.frame_number(F.col("node"))), e.join(comp.withColumnRenamed("node", "a"), "a")


def _profile(s, d):
    return graph.component_profile(*_members(s, d))


def _vectors(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", "label", v.alias("v"))


def _vector_pairs(s, d):
    """Pairs of neighbours in each label's own order, with all vector metrics; the distance of sign bits is taken from packed bits."""
    x = _vectors(s, d).withColumn("bits", vx.pack_bits(vx.sign_bits(F.col("v")))).withColumn("rise", vx.pack_bits(vx.rise_bits(F.col("v"))))
    x = Scratch(s, "vectors").save(row_numbers(x, ["label"], [F.asc("vec_id")], "n"), "numbered")
    nxt = x.select("label", (F.col("n") - 1).alias("n"), F.struct("vec_id", "v", "bits", "rise").alias("nxt"))
    y = x.join(nxt, ["label", "n"])
    a, b = F.col("v"), F.col("nxt.v")
    r = lambda c: F.round(c, 4) + F.lit(0.0)  # no negative zero
    return y.select("label", F.col("vec_id").alias("a"), F.col("nxt.vec_id").alias("b"), vx.hamming(F.col("bits"), F.col("nxt.bits")).alias("sign_distance"), vx.hamming(F.col("rise"), F.col("nxt.rise")).alias("rise_distance"), r(vx.cosine(a, b)).alias("cosine"), r(vx.ncc(a, b)).alias("ncc"), r(vx.mae(a, b)).alias("mae"))


def queries() -> dict:
    scored = ["pair_id", "source", "a", "b", "suspicion_score", "metric_verdict", "review_rank"]
    edge = ["source", "a", "b", "metric_verdict", "frame_delta"]
    return {
        "sequence_edges": lambda s, d: pairs.sequence_edges(_scored(s, d), "metric_verdict").select(*edge),
        "near_dup_scope": lambda s, d: pairs.cross_split_candidates(_items(s, d), sources=SCOPE),
        "near_dup_candidates": lambda s, d: pairs.cross_split_candidates(_items(s, d)),
        "near_dup_scored": lambda s, d: pairs.ranked(_scored(s, d)).select(*scored),
        "near_dup_reviewed": lambda s, d: _reviewed(s, d).select("pair_id", "source", "review_rank", "reviewed_visually", "metric_verdict", "final_verdict"),
        "pair_summary": lambda s, d: pairs.verdict_summary(_reviewed(s, d), "final_verdict"),
        "components": lambda s, d: graph.numbered(_members(s, d)[0]).select("source", F.col("node").alias("image"), "component", "number"),
        "component_profile": _profile,
        "vector_pairs": _vector_pairs,
    }


_SIDE = "CASE WHEN ia < ib THEN {0} ELSE {1} END"
SQL = f"""
WITH RECURSIVE px AS (SELECT *, {sql.file_name("image_a")} AS ia, {sql.file_name("image_b")} AS ib FROM near_duplicate_pairs),
decided AS (SELECT least(ia, ib) AS a, greatest(ia, ib) AS b, audited_at, visual_review, source, {_SIDE.format(sql.split_name("split_a"), sql.split_name("split_b"))} AS sa, {_SIDE.format(sql.split_name("split_b"), sql.split_name("split_a"))} AS sb,
    phash_distance AS p, dhash_distance AS d, pixel_ncc AS ncc, pixel_mae AS mae, color_hist_cosine AS hist, same_filename_family AS fam, frame_delta AS delta FROM px WHERE ia <> ib
  QUALIFY row_number() OVER (PARTITION BY least(ia, ib), greatest(ia, ib) ORDER BY audited_at DESC NULLS LAST, visual_review DESC NULLS LAST, source DESC NULLS LAST, sa DESC NULLS LAST, sb DESC NULLS LAST, p DESC NULLS LAST, d DESC NULLS LAST, ncc DESC NULLS LAST, mae DESC NULLS LAST, hist DESC NULLS LAST) = 1),
scored AS (SELECT *, left(sha1(a || '|' || b), 12) AS pair_id, round(0.30 * (1 - p / 64) + 0.15 * (1 - d / 64) + 0.40 * CASE WHEN ncc > 0 OR ncc IS NULL THEN coalesce(ncc, 0.0) ELSE 0.0 END + 0.15 * hist + CASE WHEN fam AND delta IS NOT NULL THEN 0.05 * exp(-delta / 10) ELSE 0 END, 9) AS score,
  CASE WHEN coalesce(p <= 3 AND d <= 5 AND ncc >= 0.985 AND mae <= 0.04, false) OR coalesce(fam AND delta <= 3 AND ncc >= 0.94, false) THEN '{pairs.HIGH}'
    WHEN coalesce(p <= 8 AND ncc >= 0.94, false) OR coalesce(p <= 12 AND d <= 10 AND ncc >= 0.90, false) OR coalesce(fam AND delta <= 15 AND ncc >= 0.84, false) THEN '{pairs.POSSIBLE}' ELSE '{pairs.NOT}' END AS metric FROM decided),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, p NULLS LAST, pair_id, a || '|' || b)::INT AS rank FROM scored),
reviewed AS (SELECT *, rank <= {pairs.REVIEWED} AS seen, CASE WHEN rank <= {pairs.REVIEWED} THEN CASE WHEN visual_review = '{pairs.HIGH}' THEN '{pairs.HIGH}' ELSE '{pairs.NOT}' END WHEN metric = '{pairs.NOT}' THEN '{pairs.NOT}' ELSE '{pairs.POSSIBLE}' END AS final FROM ranked),
fr AS (SELECT *, try_cast(nullif(regexp_extract(a, '{nm.FRAME}', 1), '') AS BIGINT) AS fa, try_cast(nullif(regexp_extract(b, '{nm.FRAME}', 1), '') AS BIGINT) AS fb FROM decided),
edges AS (SELECT source, a, b, sa, sb, fa, fb, coalesce(visual_review = '{pairs.HIGH}', false) AS confirmed FROM fr WHERE coalesce(visual_review = '{pairs.HIGH}', false) OR (source <> 'd6' AND coalesce(abs(fa - fb) <= 30 AND ncc >= 0.9 AND p <= 12, false))),
e2 AS (SELECT a AS s, b AS t FROM edges UNION SELECT b, a FROM edges),
r(s, t) AS (SELECT s, t FROM e2 UNION SELECT r.s, e2.t FROM r JOIN e2 ON r.t = e2.s),
comp AS (SELECT s AS node, min(t) AS component FROM r GROUP BY 1),
nodes AS (SELECT node, min(source) AS source, min(split) AS split, min(frame) AS frame FROM (SELECT a AS node, source, sa AS split, fa AS frame FROM edges UNION ALL SELECT b, source, sb, fb FROM edges) GROUP BY 1),
members AS (SELECT * FROM nodes JOIN comp USING (node))
"""


def oracle_sql() -> dict:
    p, q = pairs.P_RADIUS, pairs.D_RADIUS
    order = "CASE {} WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 END"
    f = "list_transform(embedding, lambda x: x::DOUBLE)"
    centre = "list_transform({0}, lambda x: x - list_avg({0}))"
    near = f"WITH {IMAGES_SQL}, f AS (SELECT image_id, phash, dhash FROM fingerprints QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY computed_at DESC NULLS LAST, phash DESC NULLS LAST, dhash DESC NULLS LAST) = 1), x AS (SELECT image_id, source, {order.format('split')} AS n, phash, dhash FROM images JOIN f USING (image_id)) SELECT l.image_id AS a, r.image_id AS b, bit_count(xor(l.phash, r.phash))::INT AS phash_distance, bit_count(xor(l.dhash, r.dhash))::INT AS dhash_distance FROM x l JOIN x r ON l.source = r.source AND l.n < r.n WHERE l.phash IS NOT NULL AND r.phash IS NOT NULL AND l.dhash IS NOT NULL AND r.dhash IS NOT NULL AND (bit_count(xor(l.phash, r.phash)) <= {p} OR bit_count(xor(l.dhash, r.dhash)) <= {q})"
    return {
        "sequence_edges": SQL + f"SELECT source, a, b, metric AS metric_verdict, delta AS frame_delta FROM scored WHERE metric <> '{pairs.NOT}' AND fam AND delta <= 30",
        "near_dup_scope": near + f" AND l.source IN {SCOPE}",
        "near_dup_candidates": near,
        "near_dup_scored": SQL + "SELECT pair_id, source, a, b, score AS suspicion_score, metric AS metric_verdict, rank AS review_rank FROM ranked",
        "near_dup_reviewed": SQL + "SELECT pair_id, source, rank AS review_rank, seen AS reviewed_visually, metric AS metric_verdict, final AS final_verdict FROM reviewed",
        "pair_summary": SQL + f"SELECT source, count(*) AS pairs, count(*) FILTER (final = '{pairs.HIGH}') AS high, count(*) FILTER (final = '{pairs.POSSIBLE}') AS possible, count(*) FILTER (final = '{pairs.NOT}') AS not_leakage, any_value(coalesce(n, 0)) AS images_in_high FROM reviewed LEFT JOIN (SELECT source, count(DISTINCT i) AS n FROM (SELECT source, unnest([a, b]) AS i FROM reviewed WHERE final = '{pairs.HIGH}') GROUP BY 1) USING (source) GROUP BY source",
        "components": SQL + "SELECT source, node AS image, component, dense_rank() OVER (PARTITION BY source ORDER BY component)::INT AS number FROM members",
        "component_profile": SQL + ", g AS (SELECT source, component, count(*) AS n_images, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, min(frame) AS min_frame, max(frame) AS max_frame, count(DISTINCT split) AS k FROM members GROUP BY ALL), c AS (SELECT component, count(*) FILTER (confirmed) AS confirmed_edges FROM edges JOIN comp ON a = node GROUP BY 1) SELECT g.* EXCLUDE (k), confirmed_edges, CASE WHEN confirmed_edges > 0 THEN 'high_confidence_cross_split' ELSE 'possible_cross_split' END AS status FROM g LEFT JOIN c USING (component) WHERE k > 1",
        "vector_pairs": f"WITH x AS (SELECT vec_id, label, {f} AS v FROM embeddings), y AS (SELECT label, vec_id AS a, lead(vec_id) OVER w AS b, v, lead(v) OVER w AS u FROM x WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT label, a, b, len(list_filter(list_zip(v, u), lambda z: (z[1] > 0) <> (z[2] > 0)))::INT AS sign_distance, len(list_filter(range(1, len(v)), lambda i: (v[i + 1] > v[i]) <> (u[i + 1] > u[i])))::INT AS rise_distance, round(list_cosine_similarity(v, u), 4) + 0.0 AS cosine, round(list_cosine_similarity({centre.format('v')}, {centre.format('u')}), 4) + 0.0 AS ncc, round(list_avg(list_transform(list_zip(v, u), lambda z: abs(z[1] - z[2]))), 4) AS mae FROM y WHERE b IS NOT NULL",
    }
