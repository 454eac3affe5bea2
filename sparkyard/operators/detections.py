"""Detections of frames: normalisation, routing, and how far they meet a table of requirements, frame by frame and over a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkyard.functions.taxonomy import BACKGROUND, CLASSES
from sparkyard.functions.text import strip_or_null

MIN_CONFIDENCE = 0.25
MIN_OBSERVATIONS, PERSISTENCE = 3, 0.75


def number(c: Column) -> Column:
    """The text as a finite number, else null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def box_of(texts: Column) -> Column:
    """Four finite numbers, not negative, the second corner beyond the first; else null."""
    v = F.transform(texts, number)
    ok = (F.size(texts) == 4) & F.forall(v, lambda x: x.isNotNull()) & (v[0] >= 0) & (v[1] >= 0) & (v[2] > v[0]) & (v[3] > v[1])
    return F.when(F.coalesce(ok, F.lit(False)), v)


def normalized(d: DataFrame) -> DataFrame:
    """Detections ``kind, raw, class, class_name, confidence, zone_id, bbox`` (texts; ``bbox`` an array) with typed values and ``invalid_reason``.

    A bare string is a class of confidence 1; so is an object without a confidence. First reason that applies: neither object nor
    string, no class, confidence outside 0 to 1, a box that is none. The zone is the frame's (``frame_zone``) if the detection has none.
    """
    string = F.col("kind") == "string"
    cls = F.when(string, F.col("raw")).otherwise(F.coalesce("class", "class_name"))
    conf = F.when(string, 1.0).when(F.col("confidence").isNull(), 1.0).otherwise(number(F.col("confidence")))
    conf = F.when(conf.between(0, 1), conf)
    reason = F.when(~F.col("kind").isin("object", "string"), "invalid_detection_type").when(cls.isNull(), "missing_class").when(conf.isNull(), "invalid_confidence").when(F.col("bbox").isNotNull() & box_of(F.col("bbox")).isNull(), "invalid_bbox")
    return d.select(*[c for c in d.columns if c not in ("class", "class_name", "confidence", "bbox", "zone_id", "kind", "raw")], cls.alias("class"), conf.alias("confidence"), box_of(F.col("bbox")).alias("bbox"), F.coalesce(strip_or_null(F.col("zone_id")), F.col("frame_zone")).alias("zone_id"), reason.alias("invalid_reason"))


def routed(d: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """With ``bucket``, first that applies: invalid, unknown_class, low_confidence, zone_mismatch, accepted; and ``zone_verified``.

    A zone mismatches only if the frame's target zone and the detection's are both known and differ.
    """
    differ = F.coalesce(F.col("target_zone") != F.col("zone_id"), F.lit(False))
    bucket = F.when(F.col("invalid_reason").isNotNull(), "invalid").when(~F.col("class").isin(*CLASSES), "unknown_class").when(F.col("confidence") < least, "low_confidence").when(differ, "zone_mismatch").otherwise("accepted")
    return d.withColumn("bucket", bucket).withColumn("zone_verified", F.coalesce(F.col("target_zone") == F.col("zone_id"), F.col("target_zone").isNull()))


def from_arrays(frames: DataFrame, key: list[str]) -> DataFrame:
    """A detector's parallel arrays ``class_names, scores, boxes`` as rows ``(key, pos, class, confidence, bbox)``, with ``problem`` in place of rows where the lengths differ.

    Names are trimmed and in lower case; background names are left out.
    """
    same = (F.size("class_names") == F.size("scores")) & (F.size("scores") == F.size("boxes"))
    x = frames.withColumn("problem", F.when(~F.coalesce(same, F.lit(False)), "inconsistent_result"))
    z = F.when(F.col("problem").isNull(), F.arrays_zip("class_names", "scores", "boxes"))
    rows = x.select(*key, "problem", F.posexplode_outer(z).alias("pos", "d"))
    name = F.lower(F.trim("d.class_names"))
    return rows.select(*key, "pos", name.alias("class"), F.col("d.scores").alias("confidence"), F.col("d.boxes").alias("bbox"), "problem").where(F.col("problem").isNotNull() | (F.col("class").isNotNull() & ~F.col("class").isin(*BACKGROUND)))


#: A requirement table: profile_id, ord, kind (required, alternative, undetectable, conditional), name, detectable, undetectable, condition, mode (any, all), relation (alternative, additional).
REQUIREMENTS = "profile_id int, ord int, kind string, name string, detectable array<string>, undetectable array<string>, condition string, mode string, relation string"


def requirement_rows(profile: int, required=(), alternatives=(), undetectable=(), conditionals=()) -> list[tuple]:
    """The rows of one profile. ``alternatives``: (detectable, undetectable); ``conditionals``: (condition, detectable, mode, undetectable, relation)."""
    rows = [("required", f"required:{c}", [c], [], None, None, None) for c in required]
    rows += [("alternative", f"alternative:{i}", list(d), list(u), None, None, None) for i, (d, u) in enumerate(alternatives)]
    rows += [("undetectable", f"undetectable:{i}", [], [t], None, None, None) for i, t in enumerate(undetectable)]
    rows += [("conditional", f"conditional:{i}", list(d), list(u), c, m, r) for i, (c, d, m, u, r) in enumerate(conditionals)]
    return [(profile, i, *r) for i, r in enumerate(rows)]


_ENTRY = "struct<bucket:string,id:string,found:array<string>>"


def requirement_results(frames: DataFrame, requirements: DataFrame) -> DataFrame:
    """``(frame_key, ord, bucket, id, found)``: what becomes of each requirement of a frame's profile.

    ``frames``: frame_key, profile_id, target_zone, active (array of condition names), accepted and verified (arrays of class names).
    Found is satisfied, or uncertain where a target zone is set and no found class is verified to be in it; what can't be detected is uncertain.
    The requirement table is small and goes to all tasks; frames aren't shuffled.
    """
    c = F.col
    present = lambda x: F.array_intersect(x, c("accepted"))
    entry = lambda b, i, f: F.struct(b.alias("bucket"), i.alias("id"), f.alias("found"))
    held = lambda f: F.when(c("target_zone").isNotNull() & (F.size(f) > 0) & ~F.arrays_overlap(f, c("verified")), "uncertain").otherwise("satisfied")
    empty, none = F.array().cast("array<string>"), F.array().cast(f"array<{_ENTRY}>")
    found = present(c("detectable"))
    some, unseen = F.size(found) > 0, F.size("undetectable") > 0
    missing, unsure = (F.array(entry(F.lit(b), c("name"), empty)) for b in ("missing", "uncertain"))
    yes = F.array(entry(held(found), c("name"), found))
    substitute = unseen & (c("relation") == "alternative")
    each = F.transform("detectable", lambda d: entry(F.when(F.array_contains(c("accepted"), d), held(F.array(d))).otherwise("missing"), F.concat(c("name"), F.lit(":"), d), F.filter(F.array(d), lambda x: F.array_contains(c("accepted"), x))))
    whole = F.when(substitute & (F.size(found) < F.size("detectable")), unsure).otherwise(each)
    any_of = F.when(some, yes).when(substitute, unsure).when(F.size("detectable") > 0, missing).otherwise(none)
    terms = F.when(unseen & (c("relation") == "additional"), F.transform("undetectable", lambda t, j: entry(F.lit("uncertain"), F.concat(F.replace(c("name"), F.lit("conditional"), F.lit("conditional_undetectable")), F.lit(":"), j.cast("string")), empty))).otherwise(none)
    support = F.when(some, F.array(entry(F.lit("supporting"), F.replace(c("name"), F.lit("conditional"), F.lit("conditional_support")), found))).otherwise(none)
    active = F.coalesce(F.array_contains(c("active"), c("condition")), F.lit(False))
    out = (
        F.when(c("kind") == "required", F.when(some, yes).otherwise(missing))
        .when(c("kind") == "alternative", F.when(some, yes).when(unseen, unsure).otherwise(missing))
        .when(c("kind") == "undetectable", unsure)
        .otherwise(F.when(~active, support).otherwise(F.concat(F.when(c("mode") == "all", whole).otherwise(any_of), terms)))
    )
    return frames.join(F.broadcast(requirements), "profile_id").select("frame_key", "ord", F.posexplode(out).alias("pos", "e")).select("frame_key", "ord", "pos", "e.*")


def weights(c, active: Column) -> tuple[Column, Column]:
    """What a requirement row asks for and how much of it can be seen; ``c`` gives the row's columns by name, ``active`` says whether its condition holds."""
    seen, unseen = F.size(c("detectable")) > 0, F.size(c("undetectable")) > 0
    half = F.when(~unseen, 1.0).when(seen, 0.5).otherwise(0.0)
    n_det = F.when(c("mode") == "all", F.size(c("detectable"))).otherwise(seen.cast("int")).cast("double")
    swap = F.coalesce(c("relation") == "alternative", F.lit(False)) & unseen
    total = F.when(c("kind") != "conditional", 1.0).when(~active, 0.0).when(swap, 1.0).otherwise(n_det + F.size(c("undetectable")))
    part = F.when(c("kind") == "required", 1.0).when(c("kind") == "alternative", half).when(c("kind") == "undetectable", 0.0).when(~active, 0.0).when(swap, half).otherwise(n_det)
    return total, part


def observability(requirements: DataFrame, active: Column) -> DataFrame:
    """``(profile_id, observability)``: the share of what a profile asks for that can be seen at all, to 3 decimals; 0 if it asks for nothing.

    ``active`` says of each row whether its condition holds.
    """
    total, part = weights(F.col, active)
    s = requirements.groupBy("profile_id").agg(F.sum(total).alias("t"), F.sum(part).alias("p"))
    return s.select("profile_id", F.when(F.col("t") > 0, F.bround(F.col("p") / F.col("t"), 3)).otherwise(0.0).alias("observability"))


def level(c: Column) -> Column:
    return F.when(c <= 0, "NONE").when(c < 0.4, "LOW").when(c < 0.75, "MEDIUM").otherwise("HIGH")


def frame_summary(frames: DataFrame, results: DataFrame) -> DataFrame:
    """Per frame the number of requirements by bucket, score (satisfied of satisfied and missing, else null) and coverage (those of all but supporting, else 0)."""
    n = lambda b: F.count(F.when(F.col("bucket") == b, 1)).alias(b)
    x = frames.select("frame_key").join(results.groupBy("frame_key").agg(n("satisfied"), n("missing"), n("uncertain"), n("supporting")), "frame_key", "left").na.fill(0)
    known = F.col("satisfied") + F.col("missing")
    x = x.withColumn("score", F.when(known > 0, F.bround(F.col("satisfied") / known, 3)))
    return x.withColumn("coverage", F.when(known + F.col("uncertain") > 0, F.bround(known / (known + F.col("uncertain")), 3)).otherwise(0.0))


def trailing_window(obs: DataFrame, series: list[str], ts: str, seconds: Column) -> DataFrame:
    """The observations of a series within ``seconds`` before its last one, that bound included; null seconds keep all."""
    last = F.max(ts).over(Window.partitionBy(*series))
    x = obs.withColumn("$age", F.unix_micros(last) - F.unix_micros(F.col(ts))).withColumn("$most", seconds)
    return x.where("`$most` IS NULL OR `$age` <= `$most` * 1e6").drop("$age", "$most")


def series_problems(obs: DataFrame, series: list[str], ts: str, same: list[str]) -> DataFrame:
    """Per series its size and problems: unreadable or repeated instants, and columns ``same`` that aren't one value throughout."""
    mixed = [(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int")) > 1).alias(f"mixed_{c}") for c in same]
    return obs.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), (F.count(ts) < F.count(F.lit(1))).alias("no_timestamp"), (F.countDistinct(ts) < F.count(ts)).alias("duplicate_timestamps"), *mixed)


def upload_times(start: Column, position: Column) -> Column:
    """Instants of frames that were uploaded without any: a second apart, in the order of upload; ``start`` null is now."""
    return F.timestamp_seconds(F.unix_micros(F.coalesce(start, F.current_timestamp())) / 1_000_000 + position)


def stream_fields(obs: DataFrame, series: list[str], fields: list[str]) -> DataFrame:
    """Per series, for each field, whether it is consistent: in no observation, or in all with one value."""
    ok = lambda f: ((F.count(f) == 0) | ((F.count(f) == F.count(F.lit(1))) & (F.count_distinct(f) == 1))).alias(f"one_{f}")
    return obs.groupBy(*series).agg(*map(ok, fields))


def series_keys(obs: DataFrame, series: list[str], key: list[str]) -> DataFrame:
    """Per series how many different keys its observations have; more than one and it is no series. Nulls are a value; ``key`` may hold arrays."""
    return obs.groupBy(*series).agg(F.count_distinct(F.struct(*key)).alias("n_keys"))


def persistence(results: DataFrame, sizes: DataFrame, series: list[str], least: Column | int = MIN_OBSERVATIONS, ratio: Column | float = PERSISTENCE) -> DataFrame:
    """Per series and requirement how often it was missing and uncertain, and whether that persists.

    ``results``: series, ts, id, bucket; ``sizes``: series and ``n``, its observations; ``least`` and ``ratio`` are numbers, or columns of ``sizes``. Missing persists at a share of ``ratio`` or more; else, if it was
    ever uncertain, missing and uncertain together may persist as uncertain. A series of fewer than ``least`` observations has no persistence. Shares are compared
    unrounded, shown to 3 decimals.
    """
    n = lambda b: F.count(F.when(F.col("bucket") == b, 1))
    x = results.groupBy(*series, "id").agg(n("missing").alias("missing_n"), n("uncertain").alias("uncertain_n"), F.max_by("bucket", "ts").alias("last_bucket")).join(sizes, series).where("missing_n + uncertain_n > 0")
    m, u = F.col("missing_n") / F.col("n"), (F.col("missing_n") + F.col("uncertain_n")) / F.col("n")
    enough = F.col("n") >= least
    state = F.when(~enough, "insufficient_data").when(m >= ratio, "persistent_missing").when((F.col("uncertain_n") > 0) & (u >= ratio), "persistent_uncertain").otherwise("transient")
    return x.select(*series, "id", "n", "missing_n", "uncertain_n", "last_bucket", F.bround(m, 3).alias("missing_ratio"), F.bround(u, 3).alias("unresolved_ratio"), state.alias("state"))
