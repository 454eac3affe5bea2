"""Queries of the general training-data operators: snapshots and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkyard.functions import sql
from sparkyard.operators import shred, snapshot_diff
from sparkyard.sources.tables import table


# the columns of the flat tables that are held against SQL; JSON text kept in `raw`, `extra` and `active_conditions` is written differently there
_RECORD = ["record_id", "camera_id", "fixture_id", "mode", "planned_work", "observed_at", "zone_id", "window_seconds", "min_observations", "persistence_ratio", "status", "observability", "score", "coverage"]
_OBSERVATION = ["record_id", "obs_no", "kind", "planned_work", "observed_at", "zone_id"]
_DETECTION = ["record_id", "obs_no", "item_no", "kind", "class", "class_name", "confidence", "zone_id"]
_REQUIREMENT = ["record_id", "child", "item_no", "kind", "id", "condition", "reason"]


def _levels(spark, d, *tables):
    return shred.levels_for(table(spark, d, "raw_requests"), *tables)


def queries() -> dict:
    return {
        "p3_found": lambda s, d: shred.children(table(s, d, "raw_requests")),
        "p3_records": lambda s, d: shred.records(_levels(s, d, "records")).select(*_RECORD),
        "p3_observations": lambda s, d: shred.observations(_levels(s, d, "observations")).select(*_OBSERVATION),
        "p3_detections": lambda s, d: shred.detections(_levels(s, d, "detections")).select(*_DETECTION, F.array_join("bbox", ";", "null").alias("bbox")),
        "p3_requirements": lambda s, d: shred.requirements(_levels(s, d, "requirements")).select(*_REQUIREMENT),
        # every column of the flat tables; no SQL
        **{f"p3_{t}_whole": lambda s, d, t=t: getattr(shred, t)(_levels(s, d, t)) for t in shred.TABLES},
        "p4_found": lambda s, d: snapshot_diff.planned_move_changes(table(s, d, "move_plan_snapshots")),
        "p4_change_counts": lambda s, d: snapshot_diff.change_counts(table(s, d, "move_plan_snapshots")),
    }


_COMPARED = ", ".join(
    [sql.strip_or_null("group_id")]
    + [sql.split_name(c) for c in ("from_split", "to_split")]
    + [sql.path_text(c) for c in ("old_image", "new_image", "old_label", "new_label")]
    + [sql.folded(c) for c in ("image_sha256", "label_sha256")]
)
P4 = f"""
WITH v AS (SELECT snapshot_date AS s, {sql.file_name("old_image")} AS image, row({_COMPARED}) AS r
  FROM move_plan_snapshots WHERE snapshot_date IS NOT NULL AND {sql.file_name("old_image")} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY s, image ORDER BY delivered_at DESC NULLS LAST) = 1),
n AS (SELECT s, lead(s) OVER (ORDER BY s) AS t FROM (SELECT DISTINCT s FROM v)),
o AS (SELECT n.t, v.image, v.r FROM v JOIN n USING (s) WHERE n.t IS NOT NULL),
w AS (SELECT v.s AS t, v.image, v.r FROM v WHERE v.s > (SELECT min(s) FROM v)),
x AS (SELECT coalesce(o.t, w.t) AS t, coalesce(o.image, w.image) AS image, CASE WHEN o.t IS NULL THEN 'added' WHEN w.t IS NULL THEN 'removed' WHEN o.r IS DISTINCT FROM w.r THEN 'changed' END AS change
  FROM o FULL JOIN w ON o.t = w.t AND o.image = w.image)
"""


_AGAIN = "SELECT record_id, camera_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM"
P3 = f"""
WITH v AS (SELECT record_id, camera_id, payload FROM raw_requests QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY received_at DESC NULLS LAST, payload DESC NULLS LAST) = 1),
j0 AS (SELECT record_id, camera_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM v),
j1 AS ({_AGAIN} j0), j2 AS ({_AGAIN} j1), j3 AS ({_AGAIN} j2), j AS (SELECT * FROM j3 WHERE j IS NOT NULL AND json_type(j) <> 'NULL'),
obs AS (SELECT record_id, i AS obs_no, json_extract(j, '$.request.observations[' || i || ']') AS o FROM j, LATERAL (SELECT unnest(range(coalesce(json_array_length(j, '$.request.observations'), 0)::BIGINT)) AS i) WHERE json_type(j, '$.request.observations') = 'ARRAY'),
parents AS (SELECT record_id, 'detection' AS child, 0 AS obs_no, json_extract(j, '$.request.detections') AS a FROM j
  UNION ALL SELECT record_id, 'detection', obs_no, json_extract(o, '$.detections') FROM obs
  UNION ALL SELECT record_id, 'missing', 0, json_extract(j, '$.expected.match.missing') FROM j
  UNION ALL SELECT record_id, 'persistent_missing', 0, json_extract(j, '$.expected.temporal.persistent_missing') FROM j
  UNION ALL SELECT record_id, 'persistent_uncertain', 0, json_extract(j, '$.expected.temporal.persistent_uncertain') FROM j),
items AS (SELECT record_id, child, obs_no::INT AS obs_no, i::INT AS item_no, json_extract(a, '$[' || i || ']') AS e FROM parents, LATERAL (SELECT unnest(range(coalesce(json_array_length(a), 0)::BIGINT)) AS i) WHERE json_type(a) = 'ARRAY'),
kept AS (SELECT * FROM items WHERE json_type(e) <> 'NULL'),
dets AS (SELECT *, CASE WHEN json_type(e) = 'OBJECT' THEN e END AS o FROM kept WHERE child = 'detection')
"""


_KIND = "CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"
_CONTEXT_PATHS = {"planned_work": "context.planned_work", "observed_at": "context.timestamp", "zone_id": "context.zone_id"}
_RECORD_PATHS = (
    {"fixture_id": "fixture_id", "mode": "mode"}
    | {k: f"request.{v}" for k, v in _CONTEXT_PATHS.items()}
    | {k: f"request.temporal_config.{k}" for k in ("window_seconds", "min_observations", "persistence_ratio")}
    | {"status": "expected.status", "observability": "expected.observability.score", "score": "expected.match.score", "coverage": "expected.match.coverage"}
)


def _fields(table: str, paths: dict[str, str]) -> str:
    return ", ".join(f"{table}->>'$.{p}' AS {n}" for n, p in paths.items())


def oracle_sql() -> dict:
    return {
        "p3_found": P3 + "SELECT record_id, child, obs_no, item_no FROM kept WHERE child <> 'persistent_uncertain'",
        "p3_records": P3 + f"SELECT record_id, camera_id, {_fields('j', _RECORD_PATHS)} FROM j",
        "p3_observations": P3 + f"SELECT record_id, obs_no::INT AS obs_no, {_KIND.format('o')} AS kind, {_fields('o', _CONTEXT_PATHS)} FROM obs WHERE json_type(o) <> 'NULL' UNION ALL SELECT record_id, 0, 'object', {_fields('j', {k: 'request.' + v for k, v in _CONTEXT_PATHS.items()})} FROM j WHERE coalesce(j->>'$.mode', '') <> 'temporal'",
        "p3_detections": P3 + f"SELECT record_id, obs_no, item_no, {_KIND.format('e')} AS kind, {_fields('o', {k: k for k in _DETECTION[4:]})}, CASE WHEN json_type(o, '$.bbox') = 'ARRAY' THEN array_to_string(list_transform(from_json(o->'$.bbox', '[\"VARCHAR\"]'), lambda x: coalesce(x, 'null')), ';') END AS bbox FROM dets",
        "p3_requirements": P3 + f"SELECT record_id, child, item_no, {_KIND.format('e')} AS kind, {_fields('e', {k: k for k in _REQUIREMENT[4:]})} FROM kept WHERE child <> 'detection'",
        "p4_found": P4 + "SELECT strftime(t, '%Y-%m-%d') AS snapshot_date, image, change FROM x WHERE change IS NOT NULL",
        "p4_change_counts": P4 + "SELECT strftime(t, '%Y-%m-%d') AS snapshot_date, change, count(*) AS n FROM x WHERE change IS NOT NULL GROUP BY ALL",
    }
