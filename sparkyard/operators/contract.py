"""A closed contract for nested JSON requests: every breach comes out as a row of path and code.

The contract is declared as a tree of :class:`Rule`; one walk over a payload holds it against the tree. It needs what flat columns lose: whether a key
is there at all, and whether a value was written as text or as a number. Runs on Arrow batches within each partition, a record at a time; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkyard.functions.taxonomy import CLASSES
from sparkyard.operators.shred import _Number, read_json

_ABSENT = object()
_TIME = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?")


@dataclass
class Rule:
    """What a value must be: ``kind`` object, list, text, time, number, integer, box or flags; ``code`` names the breach if it is something else.

    ``need``: an absent value is a breach; ``null``: null stands for absent. ``holds`` checks a value of the right kind, else ``range_code``. Objects are
    closed: other keys than ``fields`` are breaches. A list that must have items is ``full``.
    """

    kind: str
    code: str
    need: bool = True
    null: bool = False
    fields: dict[str, Rule] = field(default_factory=dict)
    item: Rule | None = None
    full: bool = False
    holds: Callable | None = None
    range_code: str = ""


def number_of(x) -> float | None:
    """The finite number that a JSON number or a text stands for."""
    try:
        n = float(x) if isinstance(x, str) else None
    except ValueError:
        return None
    return n if n is not None and abs(n) < float("inf") else None


def is_text(x) -> bool:
    return isinstance(x, str) and not isinstance(x, _Number) and bool(x.strip())


def instant_of(x: str) -> datetime | None:
    """The instant of an ISO 8601 text, without a zone as it was written; null if it is none."""
    try:
        return datetime.fromisoformat(x) if _TIME.fullmatch(x) else None
    except ValueError:
        return None


Found = Callable[[str, str], None]


def check(rule: Rule, x, path: str, found: Found) -> None:
    """All breaches of the rule by the value, its parts included."""
    if (x is _ABSENT and not rule.need) or (x is None and rule.null):
        return
    x = None if x is _ABSENT else x
    _KINDS[rule.kind](rule, x, path, found)


def _object(rule: Rule, x, path: str, found: Found) -> None:
    if not isinstance(x, dict):
        found(path, rule.code)
        x = {} if rule.code == "invalid_context" else None  # the parts of a context are asked for all the same
    else:
        for key in sorted(x.keys() - rule.fields.keys()):
            found(f"{path}.{key}", "unknown_field")
    for key, part in rule.fields.items() if x is not None else ():
        check(part, x.get(key, _ABSENT), f"{path}.{key}", found)


def _list(rule: Rule, x, path: str, found: Found) -> None:
    if not isinstance(x, list) or (rule.full and not x):
        found(path, rule.code)
        return
    for i, item in enumerate(x):
        check(rule.item, item, f"{path}[{i}]", found)


def _text(rule: Rule, x, path: str, found: Found) -> None:
    if not is_text(x):
        found(path, rule.code)
    elif rule.holds and not rule.holds(x):
        found(path, rule.range_code)


def _time(rule: Rule, x, path: str, found: Found) -> None:
    if not is_text(x):
        found(path, "invalid_string")
    elif (at := instant_of(x)) is None:
        found(path, rule.code)
    elif at.tzinfo is None:
        found(path, "timezone_required")


def _number(rule: Rule, x, path: str, found: Found) -> None:
    n = number_of(x)
    if n is None:
        found(path, rule.code)
    elif rule.holds and not rule.holds(n):
        found(path, rule.range_code)


def _integer(rule: Rule, x, path: str, found: Found) -> None:
    if not (isinstance(x, _Number) and re.fullmatch(r"-?\d+", x) and rule.holds(int(x))):
        found(path, rule.code)


def _box(rule: Rule, x, path: str, found: Found) -> None:
    if not isinstance(x, list) or len(x) != 4:
        found(path, rule.code)
        return
    n = [number_of(v) for v in x]
    for i, v in enumerate(n):
        if v is None:
            found(f"{path}[{i}]", "invalid_number")
    if None not in n and not (n[0] >= 0 and n[1] >= 0 and n[2] > n[0] and n[3] > n[1]):
        found(path, rule.code)


def _flags(rule: Rule, x, path: str, found: Found) -> None:
    if not isinstance(x, dict):
        found(path, rule.code)
        return
    for name, state in x.items():
        if not name:
            found(path, "invalid_condition_name")
        elif not isinstance(state, bool):
            found(f"{path}.{name}", "invalid_condition_state")


_KINDS = {"object": _object, "list": _list, "text": _text, "time": _time, "number": _number, "integer": _integer, "box": _box, "flags": _flags}

_ZONE = Rule("text", "invalid_string", need=False)
_CONTEXT = Rule("object", "invalid_context", fields={
    "planned_work": Rule("text", "invalid_string"),
    "active_conditions": Rule("flags", "invalid_active_conditions", need=False),
    "timestamp": Rule("time", "invalid_timestamp"),
    "camera_id": Rule("text", "invalid_string"),
    "zone_id": _ZONE,
})
_DETECTION = Rule("object", "invalid_detection", fields={
    "class": Rule("text", "invalid_string", holds=lambda c: c in CLASSES, range_code="unknown_detection_class"),
    "confidence": Rule("number", "invalid_number", holds=lambda n: 0 <= n <= 1, range_code="invalid_confidence"),
    "bbox": Rule("box", "invalid_bbox"),
    "zone_id": _ZONE,
})
#: A request about one frame, and one about a series of them.
FRAME = Rule("object", "invalid_request", fields={"context": _CONTEXT, "detections": Rule("list", "invalid_detections", item=_DETECTION)})
SERIES = Rule("object", "invalid_request", fields={
    "observations": Rule("list", "invalid_observations", item=FRAME, full=True),
    "temporal_config": Rule("object", "invalid_temporal_config", need=False, fields={
        "window_seconds": Rule("number", "invalid_number", need=False, null=True, holds=lambda n: n > 0, range_code="invalid_window_seconds"),
        "min_observations": Rule("integer", "invalid_min_observations", need=False, holds=lambda n: n >= 1),
        "persistence_ratio": Rule("number", "invalid_number", need=False, holds=lambda n: 0 < n <= 1, range_code="invalid_persistence_ratio"),
    }),
})


def normal_work(name: str) -> str:
    return " ".join(name.lower().split())


def _work_issues(frame, path: str, works: dict[str, list[str]], found: Found) -> None:
    """Works that the catalogue doesn't have, and conditions that a known work doesn't have."""
    context = frame.get("context") if isinstance(frame, dict) else None
    work = context.get("planned_work") if isinstance(context, dict) else None
    if not is_text(work):
        return
    if normal_work(work) not in works:
        found(f"{path}.context.planned_work", "unknown_planned_work")
        return
    states = context.get("active_conditions")
    for name, state in states.items() if isinstance(states, dict) else ():
        if name and isinstance(state, bool) and name not in works[normal_work(work)]:
            found(f"{path}.context.active_conditions.{name}", "unknown_active_condition")


def request_issues(payload: str | None, works: dict[str, list[str]] | None = None) -> list[tuple[str, str]] | None:
    """``(path, code)`` of all breaches of an envelope's request, each once, in order; null for a payload that is no JSON.

    ``works`` is the catalogue: conditions by normalised work; without one works aren't looked up. Of a series, the observations
    without a breach must share work, camera, zone and conditions, and differ in their instants.
    """
    x = read_json(payload)
    if x is None:
        return None
    out: dict[tuple[str, str], None] = {}
    found = lambda path, code: out.setdefault((path, code))
    request = x.get("request", _ABSENT) if isinstance(x, dict) else _ABSENT
    series = isinstance(x, dict) and x.get("mode") == "temporal"
    check(SERIES if series else FRAME, request, "request", found)
    frames = [("request", request)]
    if series:
        items = request.get("observations") if isinstance(request, dict) else None
        frames = [(f"request.observations[{i}]", f) for i, f in enumerate(items)] if isinstance(items, list) else []
    if works is not None:
        for path, frame in frames:
            _work_issues(frame, path, works, found)
    if series:
        clean = [f["context"] for path, f in frames if not any(p == path or p.startswith((f"{path}.", f"{path}[")) for p, _ in out)]
        keys = {(normal_work(c["planned_work"]), c["camera_id"], c.get("zone_id"), tuple(sorted((c.get("active_conditions") or {}).items()))) for c in clean}
        instants = [instant_of(c["timestamp"]).astimezone(timezone.utc) for c in clean]
        if len(keys) > 1:
            found("request.observations", "mixed_temporal_context")
        if len(set(instants)) < len(instants):
            found("request.observations", "duplicate_timestamps")
    return list(out)


def issues(df: DataFrame, payload: str, keep: list[str], works: dict[str, list[str]] | None = None) -> DataFrame:
    """The columns ``keep`` with ``path`` and ``code`` of every breach; unreadable payloads give no row. ``works`` is a catalogue, small by contract."""
    src = df.select(*keep, payload)
    schema = T.StructType([*(src.schema[k] for k in keep), T.StructField("path", T.StringType(), False), T.StructField("code", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, paths, codes = [], [], []
            for i, text in enumerate(b.column(len(keep)).to_pylist()):
                for path, code in request_issues(text, works) or ():
                    owner.append(i)
                    paths.append(path.encode("utf-8", "replace").decode())
                    codes.append(code)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keep))), pa.array(paths, pa.string()), pa.array(codes, pa.string())], schema.names)

    return src.mapInArrow(run, schema)


def verdicts(found: DataFrame, requests: DataFrame, key: list[str]) -> DataFrame:
    """Per readable request the number of breaches, their distinct codes, and the status an answer would have: 422 with any, 200 with none."""
    n = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("code")), ";").alias("codes"))  # the codes are a closed list
    readable = issues_readable(requests, "payload", key)
    x = readable.join(n, key, "left")
    return x.select(*key, F.coalesce("n", F.lit(0)).alias("n_issues"), F.coalesce("codes", F.lit("")).alias("codes"), F.when(F.col("n") > 0, 422).otherwise(200).alias("status"))


def issues_readable(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of the rows whose payload can be read."""
    src = df.select(*keep, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([read_json(x) is not None for x in b.column(len(keep)).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in range(len(keep))], keep)

    return src.mapInArrow(run, T.StructType([src.schema[k] for k in keep]))
