"""Queries over the detections and observations of request envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkyard.functions import sql
from sparkyard.functions.taxonomy import BACKGROUND, CLASSES
from sparkyard.functions.text import strip_or_null
from sparkyard.operators import catalog, shred, status
from sparkyard.operators import detections as dt
from sparkyard.plans import data_queries
from sparkyard.session import Scratch
from sparkyard.sources.tables import table

# Requirement tables of some kinds of work.
PROFILES = [
    *dt.requirement_rows(2, conditionals=[("при необходимости, для доставки и погрузки", ["truck", "crane_manipulator"], "any", [], "additional")]),
    *dt.requirement_rows(3, alternatives=[(["concrete_mixer"], ["автобетононасос", "кран с бадьей"])], undetectable=["глубинные вибраторы"], conditionals=[("при арматурных/монтажных операциях", ["mobile_crane"], "all", [], "additional")]),
    *dt.requirement_rows(12, alternatives=[([], ["монтажный подъемник", "лестницы"])], undetectable=["электромонтажный инструмент"], conditionals=[("для тяжелого оборудования", ["crane_manipulator"], "any", ["грузовой подъемник"], "alternative")]),
    *dt.requirement_rows(15, ["excavator", "dump_truck"], conditionals=[("для планировки/зачистки", ["bulldozer"], "all", [], "additional")]),
    *dt.requirement_rows(17, ["dump_truck"], [(["excavator", "bulldozer"], [])], conditionals=[("для уплотнения", ["roller"], "all", [], "additional")]),
    *dt.requirement_rows(22, alternatives=[(["mobile_crane", "tower_crane"], [])], undetectable=["сварочное оборудование"], conditionals=[("при бетонных работах", ["concrete_mixer"], "all", ["автобетононасос"], "additional")]),
    *dt.requirement_rows(24, ["dump_truck", "roller"], [(["motor_grader", "bulldozer"], [])], conditionals=[("для бетонного основания", ["concrete_mixer"], "all", [], "additional")]),
    *dt.requirement_rows(30, ["truck"], [(["excavator"], ["ямокопатель"]), (["mobile_crane", "crane_manipulator"], [])]),
]
#: Display names of some classes; the others show their id.
DISPLAY = {"truck": "грузовик", "excavator": "экскаватор", "roller": "каток"}
IDS = [2, 3, 12, 15, 17, 22, 24, 30]


def requirements(s):
    return s.createDataFrame(PROFILES, dt.REQUIREMENTS)


def _levels(s, d, *tables):
    return shred.levels_for(table(s, d, "raw_requests"), *tables)


def observed(s, d):
    """Observations with the profile of their work, by a catalogue of the works that occur, and instant; a null or blank work has no profile."""
    x = shred.observations(_levels(s, d, "observations")).where("kind = 'object'").withColumn("zone", strip_or_null(F.col("zone_id")))
    x = Scratch(s, "observed").save(x.select("record_id", "obs_no", F.col("zone").alias("target_zone"), "planned_work", F.try_to_timestamp("observed_at").alias("ts"), (F.col("record_id") % 2 == 0).alias("all_active")))
    name = catalog.normalize_name(F.col("planned_work"))
    works = x.where(name != "").select(name.alias("work")).distinct()
    works = works.select("work", F.lit(1).alias("ordinal"), F.element_at(F.array(*map(F.lit, IDS)), F.length("work") % len(IDS) + 1).alias("profile_id"))
    return catalog.look_up(x, "planned_work", works).drop("how")


def routed(s, d, x=None):
    d0 = shred.detections(_levels(s, d, "detections"))
    zones = (observed(s, d) if x is None else x).select("record_id", "obs_no", "target_zone")
    return dt.routed(dt.normalized(d0.join(zones, ["record_id", "obs_no"], "left").withColumn("frame_zone", F.col("target_zone"))))


def frames(s, d, x=None):
    """Observations with the classes that were accepted and verified; there are only as many as the taxonomy has."""
    x = observed(s, d) if x is None else x
    ok = routed(s, d, x).where("bucket = 'accepted'").groupBy("record_id", "obs_no").agg(F.collect_set("class").alias("accepted"), F.collect_set(F.when(F.col("zone_verified"), F.col("class"))).alias("verified"))
    x = x.join(ok, ["record_id", "obs_no"], "left")
    e = F.array().cast("array<string>")
    conditions = requirements(s).where("condition IS NOT NULL").groupBy("profile_id").agg(F.collect_set("condition").alias("c"))
    x = x.join(F.broadcast(conditions), "profile_id", "left").withColumn("active", F.when(F.col("all_active"), F.coalesce("c", e)).otherwise(e))
    return x.select(F.struct("record_id", "obs_no").alias("frame_key"), "record_id", "obs_no", "profile_id", "target_zone", "active", "ts", F.coalesce("accepted", e).alias("accepted"), F.coalesce("verified", e).alias("verified"))


def _requirement_rows(s, d):
    return dt.requirement_results(frames(s, d), requirements(s)).select("frame_key.*", "id", "bucket", F.array_join(F.array_sort("found"), ";").alias("found"))


def _summary(s, d):
    f = Scratch(s, "frames").save(frames(s, d))
    x = dt.frame_summary(f, dt.requirement_results(f, requirements(s)))
    return x.select("frame_key.*", "satisfied", "missing", "uncertain", "supporting", "score", "coverage")


def _window(s, d, x=None):
    conf = shred.records(_levels(s, d, "records")).where("mode = 'temporal'").select("record_id", dt.number(F.col("window_seconds")).alias("seconds"))
    x = (observed(s, d) if x is None else x).where("ts IS NOT NULL").join(conf, "record_id")
    return dt.trailing_window(x, ["record_id"], "ts", F.col("seconds")).select("record_id", "obs_no")


def _persistence(s, d):
    x = observed(s, d)
    f = Scratch(s, "frames").save(frames(s, d, x).join(_window(s, d, x), ["record_id", "obs_no"]))
    r = dt.requirement_results(f, requirements(s)).select("frame_key.*", "id", "bucket").join(f.select("record_id", "obs_no", "ts"), ["record_id", "obs_no"])
    return dt.persistence(r, f.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")), ["record_id"])


def _frames_and_results(s, d, x=None):
    f = Scratch(s, "frames").save(frames(s, d, x))
    return f, Scratch(s, "results").save(dt.requirement_results(f, requirements(s)))


def _instants(s, d, f=None, r=None):
    if f is None:
        f, r = _frames_and_results(s, d)
    return status.instant_status(f, requirements(s), r)


def _evidence(s, d):
    x = observed(s, d)
    f, r = _frames_and_results(s, d, x)
    rows = routed(s, d, x).select(F.struct("record_id", "obs_no").alias("frame_key"), "bucket", "class")
    return status.evidence(f, requirements(s), r, rows).select("frame_key.*", "code", "severity", "requirement_id", "n", F.array_join("classes", ";").alias("classes"))


def _settings(s, d):
    """The least number of observations and the ratio that each request asks for; the usual ones where it asks for none that can be."""
    c = shred.records(_levels(s, d, "records")).select("record_id", dt.number(F.col("min_observations")).alias("m"), dt.number(F.col("persistence_ratio")).alias("r"))
    least = F.when((F.col("m") >= 1) & (F.col("m") == F.floor("m")), F.col("m")).otherwise(float(dt.MIN_OBSERVATIONS))
    return c.select("record_id", least.alias("least"), F.when((F.col("r") > 0) & (F.col("r") <= 1), F.col("r")).otherwise(dt.PERSISTENCE).alias("ratio"))


def _series(s, d, more):
    """The frames of the window of each series, with their results and what persists."""
    x = observed(s, d)
    f, r = _frames_and_results(s, d, x)
    kept = Scratch(s, "window").save(_window(s, d, x))
    f = f.join(kept, ["record_id", "obs_no"])
    r = r.select("frame_key.*", "id", "bucket", "ord", "pos", "found").join(f.select("record_id", "obs_no", "ts"), ["record_id", "obs_no"])
    sizes = f.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).join(_settings(s, d), "record_id")
    p = Scratch(s, "persistence").save(dt.persistence(r, sizes, ["record_id"], F.col("least"), F.col("ratio")))
    if more == "frames":
        return status.unresolved_frames(r.where("record_id IS NOT NULL"), p, ["record_id"], "obs_no").select("record_id", "id", "state", *(F.array_join(c, ";").alias(c) for c in ("missing_in", "unresolved_in")))
    i = status.instant_status(f, requirements(s), r.select(F.struct("record_id", "obs_no").alias("frame_key"), "bucket")).select("frame_key.*", "status").join(f.select("record_id", "obs_no", "ts"), ["record_id", "obs_no"]).join(_settings(s, d), "record_id")
    return status.series_status(i, p, ["record_id"], F.col("least")).withColumns({c: F.array_join(c, ";") for c in ("persistent_missing", "persistent_uncertain")})


def _conditions(s, d):
    x = shred.observations(_levels(s, d, "observations")).where("kind = 'object'")
    return x.select("record_id", "obs_no", F.array_join(status.condition_names(F.col("active_conditions")), ";").alias("conditions"))


def _native(s, d):
    """Detections as a detector gives them, in parallel arrays, those of every seventh record of unequal lengths; read back as rows."""
    x = shred.detections(_levels(s, d, "detections"))
    name = F.when(F.col("kind") == "string", F.col("raw")).otherwise(F.coalesce("class", "class_name"))
    rows = F.array_sort(F.collect_list(F.struct("item_no", name.alias("name"), dt.number(F.col("confidence")).alias("score"))))  # of one frame
    f = x.groupBy("record_id", "obs_no").agg(rows.alias("r"))
    scores = F.when(F.col("record_id") % 7 == 0, F.slice("r.score", 2, 1000)).otherwise(F.col("r.score"))
    f = f.select("record_id", "obs_no", F.col("r.name").alias("class_names"), scores.alias("scores"), F.transform("r", lambda x: F.array(x["score"])).alias("boxes"))
    return dt.from_arrays(f, ["record_id", "obs_no"]).select("record_id", "obs_no", "pos", "class", "confidence", "problem")


def _keys(s, d):
    """Of each series the number of its keys, and whether camera and zone are consistent."""
    x = shred.observations(_levels(s, d, "observations")).where("kind = 'object'")
    x = x.select("record_id", catalog.normalize_name(F.col("planned_work")).alias("work"), F.col("context_camera_id").alias("camera"), F.col("zone_id").alias("zone"), status.condition_names(F.col("active_conditions")).alias("conditions"))
    keys = dt.series_keys(x, ["record_id"], ["work", "camera", "zone", "conditions"])
    return keys.join(dt.stream_fields(x, ["record_id"], ["camera", "zone"]), "record_id")


def queries() -> dict:
    return {
        "instant_status": lambda s, d: _instants(s, d).select("frame_key.*", "profile_id", "status", "observability", "level", "score", "coverage"),
        "evidence_rows": _evidence,
        "temporal_status": lambda s, d: _series(s, d, "status"),
        "persistent_frames": lambda s, d: _series(s, d, "frames"),
        "expected_classes": lambda s, d: status.expected_classes(requirements(s)).withColumn("expected", status.enumeration(F.transform("expected", lambda x: status.display(x, DISPLAY)))),
        "active_conditions": _conditions,
        "native_adapter": _native,
        "canonical_detections": lambda s, d: routed(s, d).where("bucket = 'accepted'").select("record_id", "obs_no", "item_no", "class", "confidence", F.array_join(F.transform("bbox", lambda x: F.round(x, 3).cast("string")), ";").alias("bbox"), "zone_id"),
        "series_keys": _keys,
        "detection_buckets": lambda s, d: routed(s, d).groupBy("bucket", "invalid_reason", "zone_verified").agg(F.count(F.lit(1)).alias("n")),
        "detection_rows": lambda s, d: routed(s, d).select("record_id", "obs_no", "item_no", "class", "bucket", "invalid_reason"),
        "requirement_results": _requirement_rows,
        "frame_summary": _summary,
        "observability": lambda s, d: dt.observability(requirements(s), F.lit(True)).withColumn("level", dt.level(F.col("observability"))),
        "series_problems": lambda s, d: dt.series_problems(observed(s, d), ["record_id"], "ts", ["planned_work", "target_zone"]),
        "temporal_window": _window,
        "temporal_persistence": _persistence,
    }


_NUM = "try_cast({0} AS DOUBLE)"
SQL = (
    data_queries.P3
    + f""", observed AS (SELECT record_id, obs_no::INT AS obs_no, o->>'$.context.planned_work' AS work, {sql.strip_or_null("o->>'$.context.zone_id'")} AS zone, try_cast(o->>'$.context.timestamp' AS TIMESTAMPTZ) AS ts FROM obs WHERE json_type(o) = 'OBJECT'
  UNION ALL SELECT record_id, 0, j->>'$.request.context.planned_work', {sql.strip_or_null("j->>'$.request.context.zone_id'")}, try_cast(j->>'$.request.context.timestamp' AS TIMESTAMPTZ) FROM j WHERE coalesce(j->>'$.mode', '') <> 'temporal'),
zones AS (SELECT record_id, obs_no::INT AS obs_no, {sql.strip_or_null("o->>'$.context.zone_id'")} AS target FROM obs WHERE json_type(o) = 'OBJECT'
  UNION ALL SELECT record_id, 0, {sql.strip_or_null("j->>'$.request.context.zone_id'")} FROM j WHERE coalesce(j->>'$.mode', '') <> 'temporal'),
nd AS (SELECT d.record_id, d.obs_no, item_no, target, CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$' ELSE coalesce(o->>'$.class', o->>'$.class_name') END AS class, json_type(e) AS kind,
  CASE WHEN json_type(e) = 'VARCHAR' OR o->>'$.confidence' IS NULL THEN 1.0 ELSE try_cast(o->>'$.confidence' AS DOUBLE) END AS conf0, CASE WHEN json_type(o, '$.bbox') = 'ARRAY' THEN list_transform(from_json(o->'$.bbox', '["VARCHAR"]'), lambda x: try_cast(x AS DOUBLE)) END AS b,
  coalesce({sql.strip_or_null("o->>'$.zone_id'")}, target) AS zone FROM dets d LEFT JOIN zones z ON z.record_id = d.record_id AND z.obs_no = d.obs_no),
ne AS (SELECT *, CASE WHEN conf0 BETWEEN 0 AND 1 THEN conf0 END AS conf, coalesce(len(b) = 4 AND b[1] IS NOT NULL AND b[2] IS NOT NULL AND b[3] IS NOT NULL AND b[4] IS NOT NULL AND b[1] >= 0 AND b[2] >= 0 AND b[3] > b[1] AND b[4] > b[2], false) AS okb FROM nd),
nr AS (SELECT *, CASE WHEN kind NOT IN ('OBJECT', 'VARCHAR') THEN 'invalid_detection_type' WHEN class IS NULL THEN 'missing_class' WHEN conf IS NULL THEN 'invalid_confidence' WHEN b IS NOT NULL AND NOT okb THEN 'invalid_bbox' END AS invalid_reason FROM ne),
routed AS (SELECT *, CASE WHEN invalid_reason IS NOT NULL THEN 'invalid' WHEN class NOT IN {CLASSES} THEN 'unknown_class' WHEN conf < {dt.MIN_CONFIDENCE} THEN 'low_confidence' WHEN coalesce(target <> zone, false) THEN 'zone_mismatch' ELSE 'accepted' END AS bucket, coalesce(target = zone, target IS NULL) AS zone_verified FROM nr)
"""
)


def _lit(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_lit, v)) + "]::VARCHAR[]"
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def rows_sql(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)


_NORM = "trim(regexp_replace(lower(o.work), '[\\s\\p{Z}]+', ' ', 'g'))"
_HELD = "CASE WHEN target IS NOT NULL AND len({0}) > 0 AND NOT list_has_any({0}, ver) THEN 'uncertain' ELSE 'satisfied' END"
_WHOLE = "len(und) > 0 AND coalesce(relation = 'alternative', false) AND len(found) < len(det)"
RESULTS = f"""{SQL}, rq(profile_id, ord, kind, name, det, und, condition, mode, relation) AS (VALUES {rows_sql(PROFILES)}),
acc AS (SELECT record_id, obs_no, list(DISTINCT class) AS acc, coalesce(list(DISTINCT class) FILTER (zone_verified), []) AS ver FROM routed WHERE bucket = 'accepted' GROUP BY ALL),
fr AS (SELECT o.record_id, o.obs_no, zone AS target, ts, CASE WHEN {_NORM} <> '' THEN {IDS}[(length({_NORM}) % {len(IDS)} + 1)::INT] END AS profile_id, o.record_id % 2 = 0 AS active, coalesce(acc, []::VARCHAR[]) AS acc, coalesce(ver, []::VARCHAR[]) AS ver FROM observed o LEFT JOIN acc a ON a.record_id = o.record_id AND a.obs_no = o.obs_no),
x AS (SELECT *, list_filter(det, lambda d: list_contains(acc, d)) AS found, kind = 'conditional' AS cond FROM fr JOIN rq USING (profile_id)),
res AS (
  SELECT record_id, obs_no, ts, CASE WHEN cond AND NOT active THEN replace(name, 'conditional', 'conditional_support') ELSE name END AS id, CASE WHEN len(found) > 0 AND ({_WHOLE}) IS NOT TRUE OR NOT cond THEN found ELSE [] END AS found,
    CASE WHEN cond AND NOT active THEN CASE WHEN len(found) > 0 THEN 'supporting' END
      WHEN cond AND mode = 'all' THEN CASE WHEN {_WHOLE} THEN 'uncertain' END
      WHEN kind = 'undetectable' THEN 'uncertain' WHEN len(found) > 0 THEN {_HELD.format('found')}
      WHEN kind = 'required' THEN 'missing' WHEN kind = 'alternative' THEN CASE WHEN len(und) > 0 THEN 'uncertain' ELSE 'missing' END
      WHEN len(und) > 0 AND relation = 'alternative' THEN 'uncertain' WHEN len(det) > 0 THEN 'missing' END AS bucket FROM x
  UNION ALL SELECT record_id, obs_no, ts, name || ':' || d, CASE WHEN list_contains(acc, d) THEN [d] ELSE [] END, CASE WHEN list_contains(acc, d) THEN {_HELD.format('[d]')} ELSE 'missing' END FROM x, unnest(det) t(d) WHERE cond AND active AND mode = 'all' AND NOT ({_WHOLE})
  UNION ALL SELECT record_id, obs_no, ts, replace(name, 'conditional', 'conditional_undetectable') || ':' || (j - 1), [], 'uncertain' FROM x, LATERAL (SELECT unnest(range(1, len(und) + 1)) AS j) WHERE cond AND active AND relation = 'additional'),
results AS (SELECT * FROM res WHERE bucket IS NOT NULL),
win AS (SELECT record_id, obs_no FROM (SELECT record_id, obs_no, epoch_us(max(ts) OVER (PARTITION BY record_id)) - epoch_us(ts) AS age, try_cast(j->>'$.request.temporal_config.window_seconds' AS DOUBLE) AS secs FROM observed JOIN j USING (record_id) WHERE ts IS NOT NULL AND j->>'$.mode' = 'temporal') WHERE secs IS NULL OR age <= secs * 1e6),
n AS (SELECT record_id, count(*) AS n FROM win GROUP BY 1),
cnt AS (SELECT f.record_id, f.obs_no, any_value(f.profile_id) AS profile_id, any_value(f.ts) AS ts, count(*) FILTER (bucket = 'satisfied') AS s, count(*) FILTER (bucket = 'missing') AS m, count(*) FILTER (bucket = 'uncertain') AS u FROM fr f LEFT JOIN results r ON r.record_id = f.record_id AND r.obs_no = f.obs_no GROUP BY ALL),
wt AS (SELECT *, coalesce(relation = 'alternative', false) AND len(und) > 0 AS swap, CASE WHEN mode = 'all' THEN len(det) ELSE (len(det) > 0)::INT END AS nd, CASE WHEN len(und) = 0 THEN 1.0 WHEN len(det) > 0 THEN 0.5 ELSE 0.0 END AS half FROM rq),
obsv AS (SELECT profile_id, a, CASE WHEN t > 0 THEN round_even(p / t, 3) ELSE 0.0 END AS observability FROM (SELECT profile_id, a, sum(CASE WHEN kind <> 'conditional' THEN 1 WHEN NOT a THEN 0 WHEN swap THEN 1 ELSE nd + len(und) END)::DOUBLE AS t,
  sum(CASE WHEN kind = 'required' THEN 1 WHEN kind = 'alternative' THEN half WHEN kind = 'undetectable' OR NOT a THEN 0 WHEN swap THEN half ELSE nd END)::DOUBLE AS p FROM wt, (SELECT unnest([true, false]) AS a) GROUP BY ALL)),
st AS (SELECT c.record_id, c.obs_no, c.profile_id, ts, s, m, u, coalesce(observability, 0.0) AS observability, CASE WHEN c.profile_id IS NULL THEN 'UNKNOWN_WORK' WHEN m > 0 THEN 'WARNING' WHEN u > 0 THEN CASE WHEN observability > 0 THEN 'UNCERTAIN' ELSE 'NOT_MONITORABLE' END WHEN s > 0 THEN 'OK' ELSE 'NOT_MONITORABLE' END AS status
  FROM cnt c LEFT JOIN obsv o ON o.profile_id = c.profile_id AND o.a = (c.record_id % 2 = 0)),
conf AS (SELECT record_id, CASE WHEN coalesce(isfinite(m) AND m >= 1 AND m = floor(m), false) THEN m ELSE {dt.MIN_OBSERVATIONS} END AS least, CASE WHEN coalesce(r > 0 AND r <= 1, false) THEN r ELSE {dt.PERSISTENCE} END AS ratio
  FROM (SELECT record_id, try_cast(j->>'$.request.temporal_config.min_observations' AS DOUBLE) AS m, try_cast(j->>'$.request.temporal_config.persistence_ratio' AS DOUBLE) AS r FROM j)),
pers AS (SELECT record_id, id, n, m, u, CASE WHEN n < least THEN 'insufficient_data' WHEN m / n >= ratio THEN 'persistent_missing' WHEN u > 0 AND (m + u) / n >= ratio THEN 'persistent_uncertain' ELSE 'transient' END AS state
  FROM (SELECT r.record_id, id, count(*) FILTER (bucket = 'missing') AS m, count(*) FILTER (bucket = 'uncertain') AS u FROM results r JOIN win w ON w.record_id = r.record_id AND w.obs_no = r.obs_no GROUP BY ALL) JOIN n USING (record_id) JOIN conf USING (record_id) WHERE m + u > 0),
ins AS (SELECT st.record_id, count(*) AS n, arg_max(status, ts) AS instant_status, count(*) FILTER (status = 'WARNING') AS warnings FROM st JOIN win w ON w.record_id = st.record_id AND w.obs_no = st.obs_no GROUP BY 1),
lists AS (SELECT record_id, coalesce(string_agg(id, ';' ORDER BY id) FILTER (state = 'persistent_missing'), '') AS pm, coalesce(string_agg(id, ';' ORDER BY id) FILTER (state = 'persistent_uncertain'), '') AS pu FROM pers GROUP BY 1),
ser AS (SELECT record_id, n, instant_status, instant_status IN ('UNKNOWN_WORK', 'NOT_MONITORABLE') AS final, n < least AND NOT final AS few, warnings, CASE WHEN final OR few THEN '' ELSE coalesce(pm, '') END AS persistent_missing, CASE WHEN final OR few THEN '' ELSE coalesce(pu, '') END AS persistent_uncertain FROM ins JOIN conf USING (record_id) LEFT JOIN lists USING (record_id)),
ser2 AS (SELECT *, CASE WHEN final THEN instant_status WHEN few THEN 'INSUFFICIENT_DATA' WHEN persistent_missing <> '' THEN 'WARNING' WHEN persistent_uncertain <> '' THEN 'UNCERTAIN' ELSE 'OK' END AS persistent_status FROM ser),
expc AS (SELECT profile_id, list_sort(list_distinct(flatten(list(det)))) AS expected FROM rq GROUP BY 1),
ev AS (SELECT record_id, obs_no, CASE bucket WHEN 'missing' THEN 0 ELSE 1 END AS k, id AS requirement_id, NULL::BIGINT AS n, NULL::VARCHAR AS classes FROM results WHERE bucket IN ('missing', 'uncertain')
  UNION ALL SELECT f.record_id, f.obs_no, 2, NULL, count(*), NULL FROM fr f JOIN routed r ON r.record_id = f.record_id AND r.obs_no = f.obs_no WHERE f.profile_id IS NOT NULL AND bucket = 'low_confidence' GROUP BY ALL
  UNION ALL SELECT f.record_id, f.obs_no, 3, NULL, NULL, string_agg(DISTINCT class, ';' ORDER BY class) FROM fr f JOIN routed r ON r.record_id = f.record_id AND r.obs_no = f.obs_no WHERE f.profile_id IS NOT NULL AND bucket = 'unknown_class' GROUP BY f.record_id, f.obs_no
  UNION ALL SELECT f.record_id, f.obs_no, 4, NULL, count(*), NULL FROM fr f JOIN routed r ON r.record_id = f.record_id AND r.obs_no = f.obs_no WHERE f.profile_id IS NOT NULL AND bucket = 'zone_mismatch' GROUP BY ALL
  UNION ALL SELECT record_id, obs_no, 5, NULL, NULL, array_to_string(list_sort(list_filter(acc, lambda a: NOT list_contains(expected, a))), ';') FROM fr JOIN expc USING (profile_id) WHERE len(list_filter(acc, lambda a: NOT list_contains(expected, a))) > 0)
"""


def oracle_sql() -> dict:
    mixed = "count(DISTINCT {0}) + max(({0} IS NULL)::INT) > 1"
    at = lambda i: "[" + ", ".join(f"'{e[i]}'" for e in status.EVIDENCE) + "][k + 1]"
    show = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DISPLAY.items()) + " ELSE x END"
    return {
        "instant_status": RESULTS + "SELECT record_id, obs_no, profile_id, status, observability, CASE WHEN observability <= 0 THEN 'NONE' WHEN observability < 0.4 THEN 'LOW' WHEN observability < 0.75 THEN 'MEDIUM' ELSE 'HIGH' END AS level, CASE WHEN s + m > 0 THEN round_even(s / (s + m), 3) END AS score, CASE WHEN s + m + u > 0 THEN round_even((s + m) / (s + m + u), 3) ELSE 0.0 END AS coverage FROM st",
        "evidence_rows": RESULTS + f"SELECT record_id, obs_no, {at(0)} AS code, {at(1)} AS severity, requirement_id, n, classes FROM ev",
        "temporal_status": RESULTS + "SELECT record_id, n, instant_status, persistent_status, CASE WHEN few THEN instant_status ELSE persistent_status END AS status, persistent_missing, persistent_uncertain, CASE WHEN persistent_status = 'OK' THEN warnings ELSE 0 END AS transient_warnings FROM ser2",
        "persistent_frames": RESULTS + "SELECT p.record_id, p.id, p.state, array_to_string(list_sort(coalesce(list(DISTINCT r.obs_no) FILTER (bucket = 'missing'), [])), ';') AS missing_in, array_to_string(list_sort(list(DISTINCT r.obs_no)), ';') AS unresolved_in FROM pers p JOIN results r ON r.record_id = p.record_id AND r.id = p.id JOIN win w ON w.record_id = r.record_id AND w.obs_no = r.obs_no WHERE p.state LIKE 'persistent%' AND bucket IN ('missing', 'uncertain') GROUP BY ALL",
        "expected_classes": RESULTS + f"SELECT profile_id, CASE WHEN len(e) < 2 THEN array_to_string(e, '') ELSE array_to_string(e[:-2], ', ') || ' и ' || e[-1] END AS expected FROM (SELECT profile_id, list_transform(expected, lambda x: {show}) AS e FROM expc)",
        "active_conditions": SQL + ", c AS (SELECT record_id, obs_no::INT AS obs_no, json_extract(o, '$.context.active_conditions') AS c FROM obs WHERE json_type(o) = 'OBJECT' UNION ALL SELECT record_id, 0, json_extract(j, '$.request.context.active_conditions') FROM j WHERE coalesce(j->>'$.mode', '') <> 'temporal') SELECT record_id, obs_no, CASE WHEN json_type(c) = 'OBJECT' THEN array_to_string(list_sort(list_filter(json_keys(c), lambda k: (c->>('$.\"' || k || '\"')) = 'true')), ';') ELSE '' END AS conditions FROM c",
        "native_adapter": SQL + f", na AS (SELECT record_id, obs_no, item_no, CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$' ELSE coalesce(o->>'$.class', o->>'$.class_name') END AS name, try_cast(o->>'$.confidence' AS DOUBLE) AS score, row_number() OVER (PARTITION BY record_id, obs_no ORDER BY item_no)::INT - 1 AS pos FROM dets) SELECT record_id, obs_no, pos, lower(trim(name)) AS class, CASE WHEN isfinite(score) THEN score END AS confidence, NULL::VARCHAR AS problem FROM na WHERE record_id % 7 <> 0 AND lower(trim(name)) NOT IN {BACKGROUND} UNION ALL SELECT DISTINCT record_id, obs_no, NULL, NULL, NULL, 'inconsistent_result' FROM na WHERE record_id % 7 = 0",
        "canonical_detections": SQL + "SELECT record_id, obs_no, item_no, class, conf AS confidence, coalesce(array_to_string(list_transform(b, lambda x: round(x, 3)::VARCHAR), ';'), NULL) AS bbox, zone AS zone_id FROM routed WHERE bucket = 'accepted'",
        "series_keys": SQL + f", c AS (SELECT record_id, o->>'$.context.planned_work' AS w, o->>'$.context.camera_id' AS cam, o->>'$.context.zone_id' AS z, json_extract(o, '$.context.active_conditions') AS c FROM obs WHERE json_type(o) = 'OBJECT' UNION ALL SELECT record_id, j->>'$.request.context.planned_work', j->>'$.request.context.camera_id', j->>'$.request.context.zone_id', json_extract(j, '$.request.context.active_conditions') FROM j WHERE coalesce(j->>'$.mode', '') <> 'temporal'), k AS (SELECT record_id, row({_NORM.replace('o.work', 'w')}, cam, z, CASE WHEN json_type(c) = 'OBJECT' THEN list_sort(list_filter(json_keys(c), lambda k: (c->>('$.\"' || k || '\"')) = 'true')) ELSE [] END) AS key, cam, z FROM c) SELECT record_id, count(DISTINCT key) AS n_keys, count(cam) = 0 OR (count(cam) = count(*) AND count(DISTINCT cam) = 1) AS one_camera, count(z) = 0 OR (count(z) = count(*) AND count(DISTINCT z) = 1) AS one_zone FROM k GROUP BY 1",
        "series_problems": SQL + f"SELECT record_id, count(*) AS n, count(ts) < count(*) AS no_timestamp, count(DISTINCT ts) < count(ts) AS duplicate_timestamps, {mixed.format('work')} AS mixed_planned_work, {mixed.format('zone')} AS mixed_target_zone FROM observed GROUP BY 1",
        "observability": RESULTS + "SELECT profile_id, round_even(p / t, 3) AS observability, CASE WHEN p = 0 THEN 'NONE' WHEN round_even(p / t, 3) < 0.4 THEN 'LOW' WHEN round_even(p / t, 3) < 0.75 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM (SELECT profile_id, sum(CASE WHEN kind <> 'conditional' OR swap THEN 1 ELSE nd + len(und) END)::DOUBLE AS t, sum(CASE WHEN kind = 'required' THEN 1 WHEN kind = 'alternative' OR swap THEN half WHEN kind = 'undetectable' THEN 0 ELSE nd END)::DOUBLE AS p FROM (SELECT *, coalesce(relation = 'alternative', false) AND len(und) > 0 AS swap, CASE WHEN mode = 'all' THEN len(det) ELSE (len(det) > 0)::INT END AS nd, CASE WHEN len(und) = 0 THEN 1.0 WHEN len(det) > 0 THEN 0.5 ELSE 0.0 END AS half FROM rq) GROUP BY 1)",
        "temporal_window": RESULTS + "SELECT record_id, obs_no FROM win",
        "requirement_results": RESULTS + "SELECT record_id, obs_no, id, bucket, array_to_string(list_sort(found), ';') AS found FROM results",
        "frame_summary": RESULTS + "SELECT record_id, obs_no, s AS satisfied, m AS missing, u AS uncertain, p AS supporting, CASE WHEN s + m > 0 THEN round_even(s / (s + m), 3) END AS score, CASE WHEN s + m + u > 0 THEN round_even((s + m) / (s + m + u), 3) ELSE 0.0 END AS coverage FROM (SELECT f.record_id, f.obs_no, count(*) FILTER (bucket = 'satisfied') AS s, count(*) FILTER (bucket = 'missing') AS m, count(*) FILTER (bucket = 'uncertain') AS u, count(*) FILTER (bucket = 'supporting') AS p FROM fr f LEFT JOIN results r ON r.record_id = f.record_id AND r.obs_no = f.obs_no GROUP BY ALL)",
        "temporal_persistence": RESULTS + f"SELECT record_id, id, n, m AS missing_n, u AS uncertain_n, last_bucket, round_even(m / n, 3) AS missing_ratio, round_even((m + u) / n, 3) AS unresolved_ratio, CASE WHEN n < {dt.MIN_OBSERVATIONS} THEN 'insufficient_data' WHEN m / n >= {dt.PERSISTENCE} THEN 'persistent_missing' WHEN u > 0 AND (m + u) / n >= {dt.PERSISTENCE} THEN 'persistent_uncertain' ELSE 'transient' END AS state FROM (SELECT r.record_id, id, count(*) FILTER (bucket = 'missing') AS m, count(*) FILTER (bucket = 'uncertain') AS u, arg_max(bucket, ts) AS last_bucket FROM results r JOIN win w ON w.record_id = r.record_id AND w.obs_no = r.obs_no GROUP BY ALL) JOIN n USING (record_id) WHERE m + u > 0",
        "detection_buckets": SQL + "SELECT bucket, invalid_reason, zone_verified, count(*) AS n FROM routed GROUP BY ALL",
        "detection_rows": SQL + "SELECT record_id, obs_no, item_no, class, bucket, invalid_reason FROM routed",
    }
