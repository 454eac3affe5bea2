"""The class taxonomy: canonical classes, the alias list, and label normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical classes by id, aliases by class, aliases that are dropped, labels too unspecific to keep, class ids of the source d1.
CLASSES = (
    "excavator", "dump_truck", "truck", "loader", "bulldozer", "motor_grader", "roller", "concrete_mixer", "telehandler", "piling_machine", "crane_manipulator", "mobile_crane", "tower_crane",
)
ALIASES = {
    "excavator": ["excavator"],
    "dump_truck": ["dump truck", "dumptruck", "dumb truck", "dumbtruck"],
    "truck": ["truck"],
    "loader": ["loader", "bucket loader", "bucket loader big", "bucket loader standard", "bucket loader standart", "wheel loader", "front loader", "backhoe loader"],
    "bulldozer": ["bulldozer", "bull dozer"],
    "motor_grader": ["motor grader", "grader"],
    "roller": ["roller", "compactor"],
    "concrete_mixer": ["mixer", "concrete mixer", "concretemixer", "concrete mixer truck", "concrete transport mixer", "mixed"],
    "telehandler": ["forklift giraffe", "telehandler", "telescopic handler"],
    "piling_machine": ["pile driving", "piledriving", "pile driver", "piling machine", "pilingmachine", "drill rig"],
    "crane_manipulator": ["crane manipulator"],
    "mobile_crane": ["autocran", "autocrane", "mobile crane", "vehicle crane", "truck crane", "crawler crane", "rough terrain crane"],
    "tower_crane": ["staticcrane", "static crane", "tower crane"],
}
DROPPED = ["gazelle", "tanker", "trailer", "tractor", "forklift standard", "forklift standart", "cleaning equipment", "forklift", "lifting equipment", "concrete pump", "pumptruck", "pump truck"]
AMBIGUOUS = ["crane"]
D1_NAMES = (
    "dump truck", "excavator", "bucket loader big", "roller", "crane manipulator", "gazelle", "forklift standard", "backhoe loader", "concrete mixer", "tanker", "cleaning equipment", "bucket loader standard", "trailer", "truck", "forklift giraffe", "loader", "autocran",
)
#: Fixed value: names a detector gives to what is no object.
BACKGROUND = ("background", "__background__", "no_object", "no-object", "no object", "void")


def normalize_label(c: Column) -> Column:
    """Lower case; dashes, hyphens and underscores become single spaces; white space collapsed and trimmed."""
    s = F.translate(F.lower(c), "–—_", "---")
    return F.trim(F.regexp_replace(s, r"[-\s\p{Z}]+", " "))


def alias_rows() -> list[tuple[str, str | None, str]]:
    """``(alias, class, action)`` with action MAP, DROP or AMBIGUOUS."""
    rows = [(a, c, "MAP") for c, names in ALIASES.items() for a in names]
    return rows + [(a, None, "DROP") for a in DROPPED] + [(a, None, "AMBIGUOUS") for a in AMBIGUOUS]


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alias_rows(), "alias string, class string, action string")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASSES)), "class_id int, class string")


def sql_values(rows: list[tuple], names: str) -> str:
    """The rows as an inline SQL table."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


SQL_NORMALIZE = "trim(regexp_replace(translate(lower({c}), '–—_', '---'), '[-\\s\\p{{Z}}]+', ' ', 'g'))"
