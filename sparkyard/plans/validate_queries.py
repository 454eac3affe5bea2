"""Queries of contract checks, the work catalogue and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkyard.operators import catalog, contract, labels, shred, validate
from sparkyard.operators import detections as dt
from sparkyard.functions.taxonomy import CLASSES
from sparkyard.plans import data_queries, detection_queries
from sparkyard.plans.label_queries import SQL as LABEL_SQL
from sparkyard.sources.adapters import images, raw_boxes
from sparkyard.sources.tables import table


def works(s, d):
    """A catalogue out of part names; some names come in other spellings."""
    name = F.concat("p_name", F.lit(" "), "p_brand")
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper(name)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), name)).otherwise(name)
    return table(s, d, "part").select(name.alias("work"), F.col("p_partkey").alias("ordinal"), (F.col("p_size") % 35).alias("profile_id"))


def described(s, d):
    """Works with a profile and a description out of part types; the types of one material are described, most by the right profile."""
    return table(s, d, "part").select(F.col("p_name").alias("work"), (F.col("p_size") % 5).cast("int").alias("profile_id"), F.element_at(F.split("p_type", " "), -1).alias("description"))


#: Requirement rows with problems, beside the sound ones.
BROKEN = [
    (90, 0, "required", "required:digger", ["digger"], [], None, None, None), (90, 1, "alternative", "alternative:0", [], [], None, None, None), (91, 0, "wish", "wish:0", ["truck"], [], None, None, None),
    (91, 1, "conditional", "conditional:0", ["truck"], [], " ", "some", None), (92, 0, "required", "required:truck", ["truck"], [], None, None, None), (92, 1, "required", "required:truck", ["truck"], [], None, None, None),
]
DESCRIPTIONS = [(0, "COPPER"), (1, "BRASS"), (2, "TIN"), (3, "TIN"), (4, "GOLD")]


def _lookup(s, d):
    asked = table(s, d, "part").select(F.concat("p_name", F.lit(" "), "p_brand").alias("asked")).distinct()
    return catalog.look_up(asked, "asked", works(s, d))


#: A catalogue of some of the works that occur, in lower case, with the conditions they know.
CONDITIONS = ["для ночной смены", "при высоком уровне воды"]
WORKS = {w: CONDITIONS for w in ("retaining wall backfill", "устройство временного проезда", "планировка откосов", "бетонирование ростверка", "погружение свай", "steel deck lift", "вывоз грунта со стоянки")}


def _issues(s, d):
    return contract.issues(shred.valid_requests(table(s, d, "raw_requests")), "payload", ["record_id"], WORKS)


def queries() -> dict:
    return {
        "catalog_lookup": _lookup,
        "catalog_works": lambda s, d: catalog.distinct_works(works(s, d)),
        "catalog_problems": lambda s, d: catalog.catalog_problems(works(s, d), s.range(40).select(F.col("id").cast("int").alias("profile_id"))),
        "description_problems": lambda s, d: catalog.description_problems(described(s, d), s.createDataFrame(DESCRIPTIONS, "profile_id int, description string")),
        "work_conditions": lambda s, d: catalog.sorted_conditions(works(s, d), detection_queries.requirements(s)).withColumn("conditions", F.array_join("conditions", ";")),
        "upload_problems": lambda s, d: validate.series_problems(detection_queries.observed(s, d), ["record_id"], "ts", most=2),
        "request_issues": _issues,
        "request_verdicts": lambda s, d: contract.verdicts(_issues(s, d), shred.valid_requests(table(s, d, "raw_requests")), ["record_id"]),
        "dataset_problems": lambda s, d: validate.dataset_problems(images(s, d), labels.clean_boxes(raw_boxes(s, d))),
        "requirement_problems": lambda s, d: validate.requirement_problems(s.createDataFrame(detection_queries.PROFILES + BROKEN, dt.REQUIREMENTS)),
        "latency_summary": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("value", 2).cast("decimal(20,2)")).cast("double"), 2).alias("total"), F.round(F.max("value"), 6).alias("longest")),
    }


_WORKS = "WITH works AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name || ' ' || p_brand) WHEN 1 THEN ' ' || p_name || ' ' || p_brand ELSE p_name || ' ' || p_brand END AS work, p_partkey AS ordinal, p_size % 35 AS profile_id FROM part), "
_NORM = "trim(regexp_replace(lower({0}), '[\\s\\p{{Z}}]+', ' ', 'g'))"


_ZONED = r"(Z|[+-]\d{2}:\d{2})$"
_TEXT = "json_type({0}) = 'VARCHAR' AND trim({0}->>'$', ' \t\n\r') <> ''"
_NUMBER = "(json_type({0}) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') AND isfinite(try_cast({0}->>'$' AS DOUBLE)))"
_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def _is(template: str, c: str) -> str:
    return f"coalesce({template.format(c)}, false)"


def _quoted(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def _fields(table: str, path: str, c: str, allowed) -> str:
    return f"SELECT record_id, p, p || '{path}.' || k AS path, 'unknown_field' AS code FROM (SELECT record_id, p, unnest(json_keys({c})) AS k FROM {table} WHERE json_type({c}) = 'OBJECT') WHERE k NOT IN {_quoted(allowed)}"


def _text_sql(table: str, c: str, path: str, need: bool) -> str:
    return f"SELECT record_id, p, p || '{path}', 'invalid_string' FROM {table} WHERE {'true' if need else f'{c} IS NOT NULL'} AND NOT {_is(_TEXT, c)}"


_LATE = "json_type(r) = 'OBJECT'"
ISSUES = f"""{data_queries.P3},
fr AS (SELECT record_id, 'request' AS p, json_extract(j, '$.request') AS r FROM j WHERE coalesce(json_type(j, '$.mode') = 'VARCHAR' AND j->>'$.mode' = 'temporal', false) = false
  UNION ALL SELECT record_id, 'request.observations[' || obs_no || ']', o FROM obs JOIN j USING (record_id) WHERE coalesce(json_type(j, '$.mode') = 'VARCHAR' AND j->>'$.mode' = 'temporal', false)),
ok AS (SELECT record_id, p, r, CASE WHEN json_type(r, '$.context') = 'OBJECT' THEN json_extract(r, '$.context') ELSE '{{}}'::JSON END AS c, json_extract(r, '$.context') AS c0, json_extract(r, '$.detections') AS ds FROM fr WHERE {_LATE}),
cx AS (SELECT record_id, p, json_extract(c, '$.planned_work') AS work, json_extract(c, '$.active_conditions') AS cond, json_extract(c, '$.timestamp') AS ts, json_extract(c, '$.camera_id') AS cam, json_extract(c, '$.zone_id') AS zone FROM ok),
known AS (SELECT *, CASE WHEN {_is(_TEXT, 'work')} THEN {_NORM.format("work->>'$'")} IN {_quoted(WORKS)} END AS is_known FROM cx),
cs AS (SELECT record_id, p, is_known, k, json_extract(cond, '$."' || k || '"') AS v FROM (SELECT record_id, p, is_known, cond, unnest(json_keys(cond)) AS k FROM known WHERE json_type(cond) = 'OBJECT')),
di AS (SELECT record_id, p, i, json_extract(ds, '$[' || i || ']') AS e FROM ok, LATERAL (SELECT unnest(range(json_array_length(ds)::BIGINT)) AS i) WHERE json_type(ds) = 'ARRAY'),
de AS (SELECT record_id, p, p || '.detections[' || i || ']' AS q, json_extract(e, '$.class') AS cls, json_extract(e, '$.confidence') AS conf, json_extract(e, '$.bbox') AS box, json_extract(e, '$.zone_id') AS zone, e FROM di WHERE json_type(e) = 'OBJECT'),
bx AS (SELECT *, list_transform([0, 1, 2, 3], lambda i: CASE WHEN {_is(_NUMBER, "json_extract(box, '$[' || i || ']')")} THEN try_cast(json_extract(box, '$[' || i || ']')->>'$' AS DOUBLE) END) AS b FROM de WHERE json_type(box) = 'ARRAY' AND json_array_length(box) = 4),
tc AS (SELECT record_id, json_extract(j, '$.request') AS r, json_extract(j, '$.request.temporal_config') AS t FROM j WHERE json_type(j, '$.mode') = 'VARCHAR' AND j->>'$.mode' = 'temporal'),
it AS (
  SELECT record_id, p, p AS path, 'invalid_request' AS code FROM fr WHERE NOT coalesce({_LATE}, false)
  UNION ALL {_fields("ok", "", "r", ["context", "detections"])}
  UNION ALL SELECT record_id, p, p || '.context', 'invalid_context' FROM ok WHERE NOT coalesce(json_type(c0) = 'OBJECT', false)
  UNION ALL {_fields("ok", ".context", "c0", ["planned_work", "active_conditions", "timestamp", "camera_id", "zone_id"])}
  UNION ALL {_text_sql("cx", "work", ".context.planned_work", True)}
  UNION ALL SELECT record_id, p, p || '.context.planned_work', 'unknown_planned_work' FROM known WHERE is_known = false
  UNION ALL SELECT record_id, p, p || '.context.active_conditions', 'invalid_active_conditions' FROM cx WHERE cond IS NOT NULL AND json_type(cond) <> 'OBJECT'
  UNION ALL SELECT record_id, p, CASE WHEN k = '' THEN p || '.context.active_conditions' ELSE p || '.context.active_conditions.' || k END, CASE WHEN k = '' THEN 'invalid_condition_name' ELSE 'invalid_condition_state' END FROM cs WHERE k = '' OR json_type(v) <> 'BOOLEAN'
  UNION ALL SELECT record_id, p, p || '.context.active_conditions.' || k, 'unknown_active_condition' FROM cs WHERE k <> '' AND json_type(v) = 'BOOLEAN' AND is_known AND k NOT IN {_quoted(CONDITIONS)}
  UNION ALL SELECT record_id, p, p || '.context.timestamp', CASE WHEN NOT {_is(_TEXT, 'ts')} THEN 'invalid_string' WHEN NOT regexp_matches(ts->>'$', '{_TIME}') OR try_cast(ts->>'$' AS TIMESTAMPTZ) IS NULL THEN 'invalid_timestamp' ELSE 'timezone_required' END
    FROM cx WHERE NOT {_is(_TEXT, 'ts')} OR NOT regexp_matches(ts->>'$', '{_TIME}') OR try_cast(ts->>'$' AS TIMESTAMPTZ) IS NULL OR NOT regexp_matches(ts->>'$', '{_ZONED}')
  UNION ALL {_text_sql("cx", "cam", ".context.camera_id", True)}
  UNION ALL {_text_sql("cx", "zone", ".context.zone_id", False)}
  UNION ALL SELECT record_id, p, p || '.detections', 'invalid_detections' FROM ok WHERE NOT coalesce(json_type(ds) = 'ARRAY', false)
  UNION ALL SELECT record_id, p, p || '.detections[' || i || ']', 'invalid_detection' FROM di WHERE json_type(e) <> 'OBJECT'
  UNION ALL SELECT record_id, p, q || '.' || k, 'unknown_field' FROM (SELECT record_id, p, q, unnest(json_keys(e)) AS k FROM de) WHERE k NOT IN ('class', 'confidence', 'bbox', 'zone_id')
  UNION ALL SELECT record_id, p, q || '.class', CASE WHEN {_is(_TEXT, 'cls')} THEN 'unknown_detection_class' ELSE 'invalid_string' END FROM de WHERE NOT {_is(_TEXT, 'cls')} OR cls->>'$' NOT IN {_quoted(CLASSES)}
  UNION ALL SELECT record_id, p, q || '.confidence', CASE WHEN {_is(_NUMBER, 'conf')} THEN 'invalid_confidence' ELSE 'invalid_number' END FROM de WHERE NOT {_is(_NUMBER, 'conf')} OR try_cast(conf->>'$' AS DOUBLE) NOT BETWEEN 0 AND 1
  UNION ALL SELECT record_id, p, q || '.bbox', 'invalid_bbox' FROM de WHERE NOT coalesce(json_type(box) = 'ARRAY' AND json_array_length(box) = 4, false)
  UNION ALL SELECT record_id, p, q || '.bbox[' || i || ']', 'invalid_number' FROM (SELECT record_id, p, q, unnest(range(4)) AS i, unnest(b) AS v FROM bx) WHERE v IS NULL
  UNION ALL SELECT record_id, p, q || '.bbox', 'invalid_bbox' FROM bx WHERE len(list_filter(b, lambda v: v IS NULL)) = 0 AND NOT (b[1] >= 0 AND b[2] >= 0 AND b[3] > b[1] AND b[4] > b[2])
  UNION ALL SELECT record_id, p, q || '.zone_id', 'invalid_string' FROM de WHERE zone IS NOT NULL AND NOT {_is(_TEXT, 'zone')}),
va AS (SELECT cx.* FROM cx WHERE p <> 'request' AND NOT EXISTS (SELECT 1 FROM it WHERE it.record_id = cx.record_id AND it.p = cx.p)),
vk AS (SELECT record_id, row({_NORM.format("work->>'$'")}, cam->>'$', zone->>'$', list_sort(list_transform(coalesce(json_keys(cond), []), lambda k: k || '=' || (json_extract(cond, '$."' || k || '"')->>'$')))) AS key, try_cast(ts->>'$' AS TIMESTAMPTZ) AS instant FROM va),
issues AS (
  SELECT record_id, path, code FROM it
  UNION ALL SELECT record_id, 'request', 'invalid_request' FROM tc WHERE NOT coalesce({_LATE}, false)
  UNION ALL SELECT record_id, 'request.' || k, 'unknown_field' FROM (SELECT record_id, unnest(json_keys(r)) AS k FROM tc WHERE {_LATE}) WHERE k NOT IN ('observations', 'temporal_config')
  UNION ALL SELECT record_id, 'request.observations', 'invalid_observations' FROM tc WHERE {_LATE} AND NOT coalesce(json_type(r, '$.observations') = 'ARRAY' AND json_array_length(r, '$.observations') > 0, false)
  UNION ALL SELECT record_id, 'request.temporal_config', 'invalid_temporal_config' FROM tc WHERE {_LATE} AND t IS NOT NULL AND json_type(t) <> 'OBJECT'
  UNION ALL SELECT record_id, 'request.temporal_config.' || k, 'unknown_field' FROM (SELECT record_id, unnest(json_keys(t)) AS k FROM tc WHERE json_type(t) = 'OBJECT') WHERE k NOT IN ('window_seconds', 'min_observations', 'persistence_ratio')
  UNION ALL SELECT record_id, 'request.temporal_config.window_seconds', CASE WHEN {_is(_NUMBER, "w")} THEN 'invalid_window_seconds' ELSE 'invalid_number' END FROM (SELECT record_id, json_extract(t, '$.window_seconds') AS w FROM tc WHERE json_type(t) = 'OBJECT') WHERE w IS NOT NULL AND json_type(w) <> 'NULL' AND (NOT {_is(_NUMBER, "w")} OR try_cast(w->>'$' AS DOUBLE) <= 0)
  UNION ALL SELECT record_id, 'request.temporal_config.min_observations', 'invalid_min_observations' FROM (SELECT record_id, json_extract(t, '$.min_observations') AS w FROM tc WHERE json_type(t) = 'OBJECT') WHERE w IS NOT NULL AND NOT coalesce(json_type(w) IN ('BIGINT', 'UBIGINT') AND try_cast(w->>'$' AS BIGINT) >= 1, false)
  UNION ALL SELECT record_id, 'request.temporal_config.persistence_ratio', CASE WHEN {_is(_NUMBER, "w")} THEN 'invalid_persistence_ratio' ELSE 'invalid_number' END FROM (SELECT record_id, json_extract(t, '$.persistence_ratio') AS w FROM tc WHERE json_type(t) = 'OBJECT') WHERE w IS NOT NULL AND (NOT {_is(_NUMBER, "w")} OR NOT (try_cast(w->>'$' AS DOUBLE) > 0 AND try_cast(w->>'$' AS DOUBLE) <= 1))
  UNION ALL SELECT record_id, 'request.observations', 'mixed_temporal_context' FROM vk GROUP BY record_id HAVING count(DISTINCT key) > 1
  UNION ALL SELECT record_id, 'request.observations', 'duplicate_timestamps' FROM vk GROUP BY record_id HAVING count(DISTINCT instant) < count(*))
"""


def oracle_sql() -> dict:
    split = "CASE WHEN len(string_split(output_image, '/')) >= 4 THEN string_split(output_image, '/')[2] END"
    return {
        "description_problems": f"WITH w AS (SELECT p_size % 5 AS profile_id, string_split(p_type, ' ')[-1] AS description FROM part), ds(profile_id, description) AS (VALUES {', '.join(map(str, DESCRIPTIONS))}), d AS (SELECT description, min(profile_id) AS meant, count(DISTINCT profile_id) AS k FROM ds GROUP BY 1) SELECT CASE WHEN meant IS NULL THEN 'unknown_description' ELSE 'description_of_other_profile' END AS problem, coalesce(w.description, '') AS key, count(*) AS n FROM w LEFT JOIN d USING (description) WHERE meant IS NULL OR meant <> profile_id GROUP BY ALL UNION ALL SELECT 'repeated_description', description, k FROM d WHERE k > 1 UNION ALL SELECT DISTINCT 'description_without_work', description, 0 FROM ds WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.profile_id = ds.profile_id AND w.description = ds.description)",
        "work_conditions": detection_queries.RESULTS + ", " + _WORKS.removeprefix("WITH ") + "wk AS (SELECT work, min(ordinal) AS ordinal, arg_min(profile_id, ordinal) AS profile_id, count(*) AS records FROM works GROUP BY work) SELECT wk.*, coalesce(conditions, '') AS conditions FROM wk LEFT JOIN (SELECT profile_id, string_agg(DISTINCT condition, ';' ORDER BY condition) AS conditions FROM rq WHERE condition IS NOT NULL GROUP BY 1) USING (profile_id)",
        "upload_problems": detection_queries.SQL + ", n AS (SELECT record_id, count(*) AS n, count(ts) AS given, count(DISTINCT ts) AS different FROM observed GROUP BY 1) SELECT record_id, 'too_many_frames' AS problem, n FROM n WHERE n > 2 UNION ALL SELECT record_id, 'some_times_missing', n FROM n WHERE given > 0 AND given < n UNION ALL SELECT record_id, 'repeated_times', n FROM n WHERE different < given",
        "requirement_problems": f"WITH rq(profile_id, ord, kind, name, det, und, condition, mode, relation) AS (VALUES {detection_queries.rows_sql(detection_queries.PROFILES + BROKEN)}) SELECT profile_id, name, unnest(codes) AS code FROM (SELECT profile_id, name, list_filter([CASE WHEN len(list_filter(det, lambda x: x NOT IN {_quoted(CLASSES)})) > 0 THEN 'unknown_class' END, CASE WHEN len(det) = 0 AND len(und) = 0 THEN 'empty_requirement' END, CASE WHEN kind NOT IN ('required', 'alternative', 'undetectable', 'conditional') THEN 'unknown_kind' END, CASE WHEN kind = 'conditional' AND coalesce(mode NOT IN ('any', 'all'), true) THEN 'unknown_mode' END, CASE WHEN kind = 'conditional' AND coalesce(relation NOT IN ('alternative', 'additional'), true) THEN 'unknown_relation' END, CASE WHEN kind = 'conditional' AND coalesce(trim(condition), '') = '' THEN 'missing_condition' END], lambda x: x IS NOT NULL) AS codes FROM rq) WHERE len(codes) > 0 UNION ALL SELECT profile_id, name, 'repeated_name' FROM rq GROUP BY ALL HAVING count(*) > 1",
        "request_issues": ISSUES + "SELECT DISTINCT record_id, path, code FROM issues",
        "request_verdicts": ISSUES + "SELECT record_id, coalesce(n, 0) AS n_issues, coalesce(codes, '') AS codes, CASE WHEN n > 0 THEN 422 ELSE 200 END AS status FROM j LEFT JOIN (SELECT record_id, count(*) AS n, string_agg(DISTINCT code, ';' ORDER BY code) AS codes FROM (SELECT DISTINCT record_id, path, code FROM issues) GROUP BY 1) USING (record_id)",
        "catalog_lookup": _WORKS + f"asked AS (SELECT DISTINCT p_name || ' ' || p_brand AS asked FROM part), e AS (SELECT work, arg_max(profile_id, ordinal) AS pe FROM works GROUP BY 1), f AS (SELECT {_NORM.format('work')} AS n, max(profile_id) AS pf FROM works GROUP BY 1 HAVING count(*) = 1) SELECT asked, CASE WHEN e.work IS NOT NULL THEN pe ELSE pf END AS profile_id, CASE WHEN e.work IS NOT NULL THEN 'exact' WHEN f.n IS NOT NULL THEN 'normalized' END AS how FROM asked LEFT JOIN e ON asked = work LEFT JOIN f ON {_NORM.format('asked')} = n",
        "catalog_works": _WORKS + "x AS (SELECT 1) SELECT work, min(ordinal) AS ordinal, arg_min(profile_id, ordinal) AS profile_id, count(*) AS records FROM works GROUP BY 1",
        "catalog_problems": _WORKS + "u AS (SELECT profile_id, count(*) AS n FROM works GROUP BY 1) SELECT 'conflicting_profiles' AS problem, work AS key, count(DISTINCT profile_id) AS n FROM works GROUP BY 2 HAVING count(DISTINCT profile_id) > 1 UNION ALL SELECT 'profile_without_work', r::VARCHAR, 0 FROM range(40) t(r) WHERE r NOT IN (SELECT profile_id FROM u) UNION ALL SELECT 'unknown_profile', profile_id::VARCHAR, n FROM u WHERE profile_id NOT IN (SELECT r FROM range(40) t(r))",
        "dataset_problems": LABEL_SQL + f"SELECT 'duplicate_output_path' AS problem, output_image AS key, count(*) AS n FROM images WHERE output_image IS NOT NULL GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'invalid_split', image_id::VARCHAR, 1 FROM images WHERE split IS NULL OR split NOT IN ('train', 'val', 'test') UNION ALL SELECT 'path_of_other_split', image_id::VARCHAR, 1 FROM images WHERE {split} <> split UNION ALL SELECT 'invalid_box', image_id::VARCHAR, count(*) FROM boxes WHERE NOT coalesce(x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND h > 0 AND x - w / 2 >= -1e-8 AND x + w / 2 <= 1 + 1e-8 AND y - h / 2 >= -1e-8 AND y + h / 2 <= 1 + 1e-8, false) GROUP BY 2 UNION ALL SELECT 'digest_in_several_splits', sha1, count(DISTINCT split) FROM images WHERE sha1 IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1",
        "latency_summary": "SELECT event_type, count(*) AS n, round(sum(round(value, 2)::DECIMAL(20,2))::DOUBLE, 2) AS total, round(max(value), 6) AS longest FROM events GROUP BY 1",
    }
