"""What file names of exported images say: original stem, shooting group, frame number, sequence family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of export suffixes and of names that tell a group.
EXPORT_SUFFIX = r"(?i)\.rf\.[0-9a-f]+$"
TYPE_SUFFIX = r"(?i)_(?:jpg|jpeg|png)$"
D1_CAMERA = r"(?i)^camera_([^_]+)_(\d{4}-\d{2}-\d{2})T"
D1_DATE = r"-(\d{4}-\d{2}-\d{2})$"
D8_CC = r"(?i)^(cc-\d+_\d+)_(\d{8})T\d+"
D8_FLIGHT = r"(?i)^(.+_Flight[_-]?\d+)_\d+$"
D8_DJI = r"(?i)^DJI_\d+$"
D6_SERIES = r"(?i)^ezgif-frame-\d+$"
FRAME = r"(?:^|_)(\d+)_jpg\.rf\."
TRAILING = r"^(.*?)(\d+)$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def stem(path: Column) -> Column:
    """The file name without its last suffix, the export suffix and the type suffix."""
    s = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(s, EXPORT_SUFFIX, ""), TYPE_SUFFIX, "")


def group_of(source: Column, name: Column) -> Column:
    """Struct ``(group_id, method)`` that the stem ``name`` supports; both null where it supports none."""
    g = lambda p, i: F.regexp_extract(name, p, i)
    row = lambda i, m: F.struct(i.alias("group_id"), F.lit(m).alias("method"))
    first = F.substring_index(name, "_", 1)
    return (
        F.when((source == "d1") & name.rlike(D1_CAMERA), row(F.concat(F.lit("d1:camera="), F.lower(g(D1_CAMERA, 1)), F.lit(":date="), g(D1_CAMERA, 2)), "d1_camera_and_date"))
        .when((source == "d1") & first.rlike(r"^\d+$") & name.rlike(D1_DATE), row(F.concat(F.lit("d1:camera="), first, F.lit(":date="), g(D1_DATE, 1)), "d1_camera_and_date"))
        .when((source == "d8") & name.rlike(D8_CC), row(F.concat(F.lit("d8:"), F.lower(g(D8_CC, 1)), F.lit(":date="), g(D8_CC, 2)), "d8_cc_camera_and_date"))
        .when((source == "d8") & name.rlike(D8_FLIGHT), row(F.concat(F.lit("d8:"), F.lower(g(D8_FLIGHT, 1))), "d8_explicit_flight"))
        .when((source == "d8") & name.rlike(D8_DJI), row(F.lit("d8:dji_numbered_series"), "d8_dji_numbered_series"))
        .when((source == "d6") & name.rlike(D6_SERIES), row(F.lit("d6:ezgif-frame"), "d6_explicit_frame_series"))
    )


def family(name: Column) -> Column:
    """Sequence family of a stem that ends in digits: what is before them, without trailing ``_-.``, lower case; null without digits."""
    return F.when(name.rlike(TRAILING), F.lower(F.rtrim(F.regexp_extract(name, TRAILING, 1), F.lit("_-."))))


def sequence_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, TRAILING, 2), F.lit("")).try_cast("bigint")


def frame_number(path: Column) -> Column:
    return F.nullif(F.regexp_extract(base_name(path), FRAME, 1), F.lit("")).try_cast("bigint")


def split_of_path(path: Column) -> Column:
    """The second step of ``images/<split>/<source>/<file>``; null for a path with fewer than four steps."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 4, parts[1])


def moved_path(path: Column, split: Column) -> Column:
    """The path with its split replaced."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 4, F.array_join(F.concat(F.array(parts[0], split), F.slice(parts, 3, F.size(parts) - 2)), "/"))


def safe_name(source: Column, path: Column, sha1: Column) -> Column:
    """``source_stem_sha1.ext``: letters other than A-Z, a-z, 0-9, ``.``, ``_``, ``-`` become ``_``; 100 characters of the stem, 10 of the digest."""
    name = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    ext = F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1))
    return F.concat(source, F.lit("_"), F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), 1, 100), F.lit("_"), F.substring(sha1, 1, 10), ext)
