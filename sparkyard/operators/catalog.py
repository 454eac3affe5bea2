"""Look-ups in a catalogue of named works: exact names, else normalised ones that are unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_name(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", " "))


def look_up(names: DataFrame, name: str, works: DataFrame) -> DataFrame:
    """``names`` with ``profile_id`` and ``how``: ``exact`` (of equal works the last by ``ordinal``), else ``normalized`` if just one work has that form, else null.

    ``works``: work, ordinal, profile_id. Both look-up tables are aggregates of it; the planner broadcasts them if they are small.
    """
    exact = works.groupBy(F.col("work").alias("$w")).agg(F.max_by("profile_id", "ordinal").alias("$exact"))
    form = works.groupBy(normalize_name(F.col("work")).alias("$n")).agg(F.count(F.lit(1)).alias("$k"), F.max("profile_id").alias("$form")).where("`$k` = 1")
    x = names.join(exact, F.col(name) == F.col("$w"), "left").join(form, normalize_name(F.col(name)) == F.col("$n"), "left")
    how = F.when(F.col("$w").isNotNull(), "exact").when(F.col("$n").isNotNull(), "normalized")
    profile = F.when(F.col("$w").isNotNull(), F.col("$exact")).otherwise(F.col("$form"))
    return x.select(*names.columns, profile.alias("profile_id"), how.alias("how"))


def distinct_works(works: DataFrame) -> DataFrame:
    """Each work once, with its first record and the number of records."""
    return works.groupBy("work").agg(F.min("ordinal").alias("ordinal"), F.min_by("profile_id", "ordinal").alias("profile_id"), F.count(F.lit(1)).alias("records"))


def description_problems(works: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``(problem, key, n)``: works whose description no profile has or another profile than theirs has, and profiles without a work of their description.

    ``works``: work, profile_id, description; ``descriptions``: profile_id, description. Descriptions that several profiles share are a problem too.
    """
    d = descriptions.groupBy("description").agg(F.min("profile_id").alias("meant"), F.count_distinct("profile_id").alias("k"))
    x = works.join(d, "description", "left")
    problem = F.when(F.col("meant").isNull(), "unknown_description").when(F.col("meant") != F.col("profile_id"), "description_of_other_profile")
    rows = x.select(problem.alias("problem"), F.coalesce("description", F.lit("")).alias("key")).where("problem IS NOT NULL").groupBy("problem", "key").agg(F.count(F.lit(1)).alias("n"))
    shared = d.where("k > 1").select(F.lit("repeated_description").alias("problem"), F.col("description").alias("key"), F.col("k").alias("n"))
    unused = descriptions.join(works.select("profile_id", "description").distinct(), ["profile_id", "description"], "left_anti")
    return rows.unionByName(shared).unionByName(unused.select(F.lit("description_without_work").alias("problem"), F.col("description").alias("key"), F.lit(0).cast("bigint").alias("n")).distinct())


def sorted_conditions(works: DataFrame, requirements: DataFrame) -> DataFrame:
    """Each distinct work with its profile and the profile's conditions, in order; none gives an empty list."""
    c = requirements.where("condition IS NOT NULL").groupBy("profile_id").agg(F.array_sort(F.collect_set("condition")).alias("conditions"))  # of one profile
    x = distinct_works(works).join(F.broadcast(c), "profile_id", "left")
    return x.select("work", "ordinal", "profile_id", "records", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"))


def catalog_problems(works: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(problem, key, n)``: works of one name with several profiles, profiles without a work, works of an unknown profile."""
    conflict = works.groupBy(F.col("work").alias("key")).agg(F.countDistinct("profile_id").alias("n")).where("n > 1").select(F.lit("conflicting_profiles").alias("problem"), "key", "n")
    used = works.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    unused = profiles.select("profile_id").distinct().join(used, "profile_id", "left_anti").select(F.lit("profile_without_work").alias("problem"), F.col("profile_id").cast("string").alias("key"), F.lit(0).cast("bigint").alias("n"))
    unknown = used.join(profiles.select("profile_id").distinct(), "profile_id", "left_anti").select(F.lit("unknown_profile").alias("problem"), F.col("profile_id").cast("string").alias("key"), "n")
    return conflict.unionByName(unused).unionByName(unknown)
