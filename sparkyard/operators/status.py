"""States of frames and of series, worked out from what became of the requirements, with the evidence for them.

All small tables (requirements, a profile's rows) go to all tasks; frames are shuffled once, by their key, to count results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkyard.operators import detections as dt

UNKNOWN_WORK, WARNING, UNCERTAIN, NOT_MONITORABLE, OK, INSUFFICIENT = "UNKNOWN_WORK", "WARNING", "UNCERTAIN", "NOT_MONITORABLE", "OK", "INSUFFICIENT_DATA"
#: Evidence in its fixed order: code and severity.
EVIDENCE = [("MISSING_REQUIREMENT", "WARNING"), ("UNVERIFIABLE_REQUIREMENT", "UNCERTAIN"), ("LOW_CONFIDENCE_DETECTIONS", "INFO"), ("UNKNOWN_DETECTOR_CLASSES", "INFO"), ("ZONE_MISMATCH", "INFO"), ("POSSIBLE_UNEXPECTED_EQUIPMENT", "INFO")]


def frame_observability(frames: DataFrame, requirements: DataFrame) -> DataFrame:
    """The frames with ``observability`` of their profile under their own ``active`` conditions and its ``level``; 0 for a frame without a profile."""
    rules = requirements.groupBy("profile_id").agg(F.collect_list(F.struct("kind", "detectable", "undetectable", "condition", "mode", "relation")).alias("$rules"))  # the rows of one profile
    x = frames.join(F.broadcast(rules), "profile_id", "left")
    active = lambda r: F.coalesce(F.array_contains("active", r["condition"]), F.lit(False))
    weight = lambda i: F.aggregate("$rules", F.lit(0.0), lambda a, r: a + dt.weights(lambda k: r[k], active(r))[i].cast("double"))
    total, part = weight(0), weight(1)
    x = x.withColumn("observability", F.when(total > 0, F.bround(part / total, 3)).otherwise(0.0)).drop("$rules")
    return x.withColumn("level", dt.level(F.col("observability")))


def instant_status(frames: DataFrame, requirements: DataFrame, results: DataFrame) -> DataFrame:
    """``(frame_key, profile_id, status, observability, level, satisfied, missing, uncertain, supporting, score, coverage)`` of each frame.

    A frame whose work is in no profile is unknown; anything missing is a warning; anything uncertain is uncertain, or can't be monitored if nothing can
    be seen at all; anything satisfied is fine; else there is nothing to monitor.
    """
    x = frame_observability(frames, requirements).select("frame_key", "profile_id", "observability", "level").join(dt.frame_summary(frames, results), "frame_key")
    c = F.col
    state = (
        F.when(c("profile_id").isNull(), UNKNOWN_WORK)
        .when(c("missing") > 0, WARNING)
        .when(c("uncertain") > 0, F.when(c("observability") > 0, UNCERTAIN).otherwise(NOT_MONITORABLE))
        .when(c("satisfied") > 0, OK)
        .otherwise(NOT_MONITORABLE)
    )
    return x.select("frame_key", "profile_id", state.alias("status"), "observability", "level", "satisfied", "missing", "uncertain", "supporting", "score", "coverage")


def expected_classes(requirements: DataFrame) -> DataFrame:
    """``(profile_id, expected)``: every class that some row of a profile may ask for."""
    return requirements.groupBy("profile_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("detectable")))).alias("expected"))  # the rows of one profile


def evidence(frames: DataFrame, requirements: DataFrame, results: DataFrame, routed: DataFrame) -> DataFrame:
    """``(frame_key, seq, code, severity, requirement_id, n, classes)``: why a frame is in its state, numbered from 1 in the order of :data:`EVIDENCE`.

    ``routed`` has the frames' detections with ``frame_key``, ``bucket`` and ``class``. Frames without a profile have none. Invalid detections are no evidence.
    """
    none, text, number = F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("bigint")
    row = lambda k, at, pos, rid, n, classes: [F.lit(k).alias("k"), at.cast("int").alias("ord"), pos.cast("int").alias("pos"), rid.alias("requirement_id"), n.alias("n"), classes.alias("classes")]
    zero = F.lit(0)
    found = results.where("bucket IN ('missing', 'uncertain')").select("frame_key", *row(0, F.col("ord"), F.col("pos"), F.col("id"), number, none)[1:], F.when(F.col("bucket") == "missing", 0).otherwise(1).alias("k"))
    known = frames.where("profile_id IS NOT NULL")
    count = lambda b: F.count(F.when(F.col("bucket") == b, 1))
    rejected = routed.where("bucket IN ('low_confidence', 'unknown_class', 'zone_mismatch')").groupBy("frame_key").agg(count("low_confidence").alias("low"), F.array_sort(F.collect_set(F.when(F.col("bucket") == "unknown_class", F.col("class")))).alias("strange"), count("zone_mismatch").alias("zone"))
    x = known.select("frame_key", "profile_id", "accepted").join(F.broadcast(expected_classes(requirements)), "profile_id", "left").join(rejected, "frame_key", "left")
    more = F.array_sort(F.array_except("accepted", F.coalesce("expected", F.array().cast("array<string>"))))
    entry = lambda k, ok, n, classes: F.when(ok, F.struct(*row(k, zero, zero, text, n, classes)))
    rest = F.array_compact(F.array(
        entry(2, F.col("low") > 0, F.col("low"), none),
        entry(3, F.size("strange") > 0, number, F.col("strange")),
        entry(4, F.col("zone") > 0, F.col("zone"), none),
        entry(5, F.size(more) > 0, number, more),
    ))
    rest = x.select("frame_key", F.explode(rest).alias("e")).select("frame_key", "e.*")
    every = found.join(known.select("frame_key"), "frame_key").unionByName(rest)
    every = every.groupBy("frame_key").agg(F.array_sort(F.collect_list(F.struct("k", "ord", "pos", "requirement_id", "n", "classes"))).alias("rows"))  # the requirements of one frame
    out = every.select("frame_key", F.posexplode("rows").alias("seq", "e"))
    name = lambda i: F.element_at(F.array(*(F.lit(e[i]) for e in EVIDENCE)), F.col("e.k") + 1)
    return out.select("frame_key", (F.col("seq") + 1).alias("seq"), name(0).alias("code"), name(1).alias("severity"), "e.requirement_id", "e.n", "e.classes")


def series_status(instants: DataFrame, persistent: DataFrame, series: list[str], least: Column | int = dt.MIN_OBSERVATIONS) -> DataFrame:
    """Per series ``(n, instant_status, persistent_status, status, persistent_missing, persistent_uncertain, transient_warnings)``.

    ``instants``: series, ts, status of the observations in the window; ``persistent``: the rows of :func:`sparkyard.operators.detections.persistence`. The last
    observation decides where its work is unknown or can't be monitored; fewer than ``least`` observations, a number or a column of ``instants``, show the instant state alone.
    The lists hold requirement ids in order. Warnings that do not persist are counted where the series is fine.
    """
    x = instants.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), F.max_by("status", "ts").alias("instant_status"), F.count_if(F.col("status") == WARNING).alias("warnings"), F.max(F.lit(least) if isinstance(least, int) else least).alias("least"))
    ids = lambda s: F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("id"))))
    p = persistent.groupBy(*series).agg(ids("persistent_missing").alias("pm"), ids("persistent_uncertain").alias("pu"))  # the requirements of one profile
    none = F.array().cast("array<string>")
    x = x.join(p, series, "left")
    final = F.col("instant_status").isin(UNKNOWN_WORK, NOT_MONITORABLE)
    few = ~final & (F.col("n") < F.col("least"))
    lists = [F.when(final | few, none).otherwise(F.coalesce(c, none)).alias(n) for c, n in (("pm", "persistent_missing"), ("pu", "persistent_uncertain"))]
    x = x.select(*series, "n", "instant_status", final.alias("final"), few.alias("few"), "warnings", *lists)
    state = F.when(F.col("final"), F.col("instant_status")).when(F.col("few"), INSUFFICIENT).when(F.size("persistent_missing") > 0, WARNING).when(F.size("persistent_uncertain") > 0, UNCERTAIN).otherwise(OK)
    x = x.withColumn("persistent_status", state).withColumn("status", F.when(F.col("few"), F.col("instant_status")).otherwise(F.col("persistent_status")))
    return x.select(*series, "n", "instant_status", "persistent_status", "status", "persistent_missing", "persistent_uncertain", F.when(F.col("persistent_status") == OK, F.col("warnings")).otherwise(0).alias("transient_warnings"))


def unresolved_frames(results: DataFrame, persistent: DataFrame, series: list[str], frame: str) -> DataFrame:
    """Per series and requirement that persists the numbers of the frames in which it was missing, and in which it was missing or uncertain, in order."""
    keep = persistent.where("state IN ('persistent_missing', 'persistent_uncertain')").select(*series, "id", "state")
    at = lambda c: F.array_sort(F.collect_set(F.when(c, F.col(frame))))  # of one series
    return results.join(keep, [*series, "id"]).groupBy(*series, "id", "state").agg(at(F.col("bucket") == "missing").alias("missing_in"), at(F.col("bucket").isin("missing", "uncertain")).alias("unresolved_in"))


def condition_names(c: Column) -> Column:
    """The names of the conditions that hold: of a JSON object those whose value is true, of a JSON list all its strings, else none; in order, each once."""
    states = F.from_json(c, "map<string,string>")
    held = F.map_keys(F.map_filter(states, lambda k, v: v == "true"))
    listed = F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.coalesce(F.when(F.startswith(F.ltrim(c), F.lit("{")), held).when(F.startswith(F.ltrim(c), F.lit("[")), listed), F.array().cast("array<string>"))))


def enumeration(items: Column, last: str = " и ") -> Column:
    """The distinct items that are not empty as "a, b и c"; an empty text for none."""
    x = F.array_distinct(F.filter(items, lambda i: i.isNotNull() & (i != "")))
    n = F.size(x)
    return F.when(n <= 1, F.concat_ws("", x)).otherwise(F.concat(F.array_join(F.slice(x, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(last), F.element_at(x, F.greatest(n, F.lit(1)))))


def display(c: Column, names: dict[str, str]) -> Column:
    """The display name of an id, the id itself where it has none."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else None
    return c if table is None else F.coalesce(F.try_element_at(table, c), c)


def capitalized(c: Column) -> Column:
    """The first letter a capital, the others small."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000_000)))


def finite(c: Column) -> Column:
    """The number, null where it is not finite: what JSON can hold."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
