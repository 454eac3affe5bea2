"""Problem 3: nested JSON records as related flat tables.

Method: columnar shredding. :func:`shred` gives each record, for every leaf path of a declared tree, the
sequences of repetition levels, definition levels and values; :func:`assemble` rebuilds, for one repeated
ancestor, a flat table from these sequences alone, with the positions that tie each row to its parents.

Levels: an array adds 1 to the repetition level. Definition levels count what is there along the path: an
object or scalar that is not null adds 1; an array that is not null adds 1, each of its slots 1 more, and a
slot that isn't null another 1. Both steps work on Arrow batches, whole records at a time.

Defined results for what the tree doesn't foresee: a value where an array or object is declared counts as
absent, the same inside an array keeps its slot with its ``$kind`` and ``$raw`` text; an object or array where
a scalar is declared gives its JSON text; undeclared keys of an object are kept as JSON text in ``$extra``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Number(str):
    """A JSON number in the digits in which it was written."""


@dataclass
class Node:
    """A node of the declared tree: an object with ``fields``, an array of ``item``, or a scalar."""

    fields: dict[str, Node] | None = None
    item: Node | None = None
    extra: bool = False


SCALAR = Node()


def obj(extra: bool = False, **fields: Node) -> Node:
    return Node(fields=fields, extra=extra)


def arr(item: Node) -> Node:
    return Node(item=item)


def leaves(tree: Node, path: str = "", rep: int = 0) -> list[tuple[str, int]]:
    """Leaf paths, steps parted by ``/``, with the repetition level of each; ``[]`` marks an array."""
    if tree.item is not None:
        p = f"{path}[]"
        return [(f"{p}/$kind", rep + 1), (f"{p}/$raw", rep + 1), *(leaves(tree.item, p, rep + 1) if tree.item is not SCALAR else [])]
    if tree.fields is not None:
        own = [(f"{path}/$extra".lstrip("/"), rep)] if tree.extra else []
        return own + [x for k, n in tree.fields.items() for x in leaves(n, f"{path}/{k}".lstrip("/"), rep)]
    return [(path, rep)]


def read_json(text: str | None):
    """The decoded payload, ``None`` if it is unreadable; JSON text that is itself encoded as a JSON string is decoded again."""
    try:
        while isinstance(text, str) and not isinstance(text, _Number):
            text = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return text


def _refuse(name: str):
    raise ValueError(name)


def _kind(x) -> str | None:
    if x is None:
        return None
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, _Number):
        return "number"
    return {str: "string", dict: "object", list: "array"}[type(x)]


def _text(x) -> str | None:
    if x is None:
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        return x.encode("utf-8", "replace").decode()
    return _dump(x).encode("utf-8", "replace").decode()


def _dump(x) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_dump, x)) + "]"
    return str(x) if isinstance(x, _Number) else json.dumps(x, ensure_ascii=False)


class _Writer:
    """Collects (repetition, definition, value) per leaf path."""

    def __init__(self, paths: list[str]):
        self.paths = paths
        self.below: dict[str, list[str]] = {}
        self.start()

    def start(self) -> None:
        self.out: dict[str, tuple[list, list, list]] = {p: ([], [], []) for p in self.paths}

    def put(self, path: str, r: int, d: int, v: str | None) -> None:
        a, b, c = self.out[path]
        a.append(r)
        b.append(d)
        c.append(v)

    def wanted(self, node: Node, path: str) -> list[str]:
        """The leaves below ``node`` that are asked for."""
        if path not in self.below:
            self.below[path] = [p for p, _ in leaves(node, path) if p in self.out]
        return self.below[path]

    def absent(self, node: Node, path: str, r: int, d: int) -> None:
        """One entry in each leaf below ``node``, which isn't there; ``d`` is the level of the last thing that is."""
        for p in self.wanted(node, path):
            self.put(p, r, d, None)

    def walk(self, node: Node, x, path: str, r: int, d: int, rep: int) -> None:
        if not self.wanted(node, path):
            return
        if node.item is not None:
            if not isinstance(x, list) or not x:
                self.absent(node, path, r, d + isinstance(x, list))
                return
            p = f"{path}[]"
            kind, raw = f"{p}/$kind" in self.out, f"{p}/$raw" in self.out
            for i, e in enumerate(x):
                ri, di = (r if i == 0 else rep + 1), d + 2 + (e is not None)
                if kind:
                    self.put(f"{p}/$kind", ri, di, _kind(e))
                if raw:
                    self.put(f"{p}/$raw", ri, di, _text(e))
                if node.item is not SCALAR:
                    self.walk(node.item, e, p, ri, di - (e is not None), rep + 1)
        elif node.fields is not None:
            if not isinstance(x, dict):
                self.absent(node, path, r, d)
                return
            if node.extra and f"{path}/$extra".lstrip("/") in self.out:
                rest = {k: v for k, v in x.items() if k not in node.fields}
                self.put(f"{path}/$extra".lstrip("/"), r, d + 1, _text(rest) if rest else None)
            for k, n in node.fields.items():
                self.walk(n, x.get(k), f"{path}/{k}".lstrip("/"), r, d + 1, rep)
        else:
            self.put(path, r, d + (x is not None), _text(x))


_LEVELS = pa.list_(pa.int32())
_VALUES = pa.list_(pa.string())


def shred(df: DataFrame, payload: str, tree: Node, keep: list[str], only: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and, per leaf path, a struct ``(r, d, v)`` of equally long arrays; unreadable payloads give no row.

    ``only`` names the leaf paths to shred, by default all. Runs within each partition; nothing is shuffled.
    """
    paths = [p for p, _ in leaves(tree) if only is None or p in only]
    src = df.select(*keep, F.col(payload).alias("$payload"))
    kept = T.StructType([src.schema[k] for k in keep])
    levels = T.StructType([T.StructField("r", T.ArrayType(T.IntegerType())), T.StructField("d", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.StringType()))])
    schema = T.StructType([*kept.fields, *(T.StructField(p, levels) for p in paths)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Writer(paths)
        for b in batches:
            rows, cols = [], {p: ([], [], []) for p in paths}
            for i, text in enumerate(b.column("$payload").to_pylist()):
                x = read_json(text)
                if x is None:
                    continue
                w.start()
                w.walk(tree, x, "", 0, 0, 0)
                rows.append(i)
                for p in paths:
                    for have, more in zip(cols[p], w.out[p]):
                        have.append(more)
            b = b.take(pa.array(rows, pa.int64()))
            out = [b.column(k) for k in keep]
            out += [pa.StructArray.from_arrays([pa.array(r, _LEVELS), pa.array(d, _LEVELS), pa.array(v, _VALUES)], ["r", "d", "v"]) for r, d, v in cols.values()]
            yield pa.RecordBatch.from_arrays(out, [*keep, *paths])

    return src.mapInArrow(run, schema)


def _positions(r: np.ndarray, level: int) -> np.ndarray:
    """For each entry the position, from 0, of its slot in the array of that level."""
    at = np.arange(len(r))
    start = np.maximum.accumulate(np.where(r < level, at, 0)) if len(r) else at
    count = np.cumsum(r == level)
    return count - count[start] if len(r) else count


@dataclass
class Part:
    """A repeated ancestor to rebuild: its path, ending in ``[]``; the level of a null slot where all above is there; a tag for its rows."""

    path: str
    slot: int
    tag: str = ""


def _below(path: str, leaf: str) -> str:
    """The path of a leaf below an ancestor; a leaf of an array in an array begins with ``[]``."""
    return f"{path}{'' if leaf.startswith('[]') else '/'}{leaf}"


def assemble(levels: DataFrame, parts: list[Part], columns: dict[str, str], positions: list[str], keep: list[str], tag: str | None = None, unique: bool = False) -> DataFrame:
    """The flat table of the repeated ancestors ``parts``, one row per slot of theirs that isn't null.

    ``columns`` names the leaves to take, as result name to path below the ancestor; those of a deeper array come as an
    array of text (null: no array). ``positions`` names the position columns, outermost first; an ancestor with fewer
    arrays has 0 in the outer ones. All leaves of an ancestor have the same slots in the same order, so their sequences
    are laid side by side: no join and no shuffle. ``unique`` leaves out rows that another part of the same record already gave.
    """
    need = list(dict.fromkeys(_below(x.path, p) for x in parts for p in ["$kind", *columns.values()]))
    deep = {n: p.count("[]") > 0 for n, p in columns.items()}
    src = levels.select(*keep, *need)
    head = [T.StructField(tag, T.StringType(), False)] if tag else []
    schema = T.StructType([*(src.schema[k] for k in keep), *head, *(T.StructField(p, T.IntegerType()) for p in positions), *(T.StructField(n, T.ArrayType(T.StringType()) if deep[n] else T.StringType()) for n in columns)])

    def rebuild(b: pa.RecordBatch, part: Part) -> pa.RecordBatch:
        leaf = lambda p, k: b.column(_below(part.path, p)).field(k)
        ints = lambda p, k: leaf(p, k).flatten().to_numpy(zero_copy_only=False)
        rep, (r, d) = part.path.count("[]"), (ints("$kind", k) for k in "rd")
        mine = np.flatnonzero(d > part.slot)
        owner = np.repeat(np.arange(b.num_rows), np.diff(leaf("$kind", "r").offsets.to_numpy()))[mine]
        out = [b.column(k).take(pa.array(owner)) for k in keep]
        out += [pa.array([part.tag] * len(mine), pa.string())] if tag else []
        at = [_positions(r, k + 1)[mine].astype(np.int32) for k in range(rep)]
        out += [pa.array(x) for x in [np.zeros(len(mine), np.int32)] * (len(positions) - rep) + at]
        for n, p in columns.items():
            v = leaf(p, "v").flatten()
            if not deep[n]:
                out.append(v.take(pa.array(mine)))
                continue
            rr, dd, text = ints(p, "r"), ints(p, "d"), v.to_pylist()
            first = np.flatnonzero(rr <= rep)  # the first entry of each slot of the ancestor
            ends = np.append(first, len(rr))[1:]
            # one level above the slot of the ancestor: no array; two: an empty one; three: its slots; each one less where the slot is the array
            empty = part.slot + (1 if p.startswith("[]") else 2)
            out.append(pa.array([text[first[i] : ends[i]] if dd[first[i]] > empty else [] if dd[first[i]] == empty else None for i in mine], _VALUES))
        return pa.RecordBatch.from_arrays(out, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [rebuild(b, part) for part in parts]  # whole records, so equal rows of one are in the same batch
            yield from pa.Table.from_batches(rows).group_by(schema.names).aggregate([]).to_batches() if unique else rows

    return src.mapInArrow(run, schema)


_CONTEXT = obj(planned_work=SCALAR, timestamp=SCALAR, camera_id=SCALAR, zone_id=SCALAR, active_conditions=SCALAR, extra=True)
_DETECTION = obj(**{"class": SCALAR, "class_name": SCALAR, "confidence": SCALAR, "zone_id": SCALAR}, bbox=arr(SCALAR), track=obj(id=SCALAR, trail=arr(arr(SCALAR)), extra=True), extra=True)
_NEED = obj(id=SCALAR, condition=SCALAR, reason=SCALAR, extra=True)

#: The declared tree of a request envelope.
ENVELOPE = obj(
    fixture_id=SCALAR,
    mode=SCALAR,
    request=obj(
        context=_CONTEXT,
        detections=arr(_DETECTION),
        observations=arr(obj(context=_CONTEXT, detections=arr(_DETECTION), extra=True)),
        temporal_config=obj(window_seconds=SCALAR, min_observations=SCALAR, persistence_ratio=SCALAR, extra=True),
        extra=True,
    ),
    expected=obj(
        status=SCALAR,
        observability=obj(score=SCALAR, level=SCALAR, extra=True),
        match=obj(score=SCALAR, coverage=SCALAR, missing=arr(_NEED), extra=True),
        temporal=obj(persistent_missing=arr(_NEED), persistent_uncertain=arr(_NEED), extra=True),
        extra=True,
    ),
    extra=True,
)
_KEEP = ["record_id", "camera_id", "received_at"]


def valid_requests(raw: DataFrame) -> DataFrame:
    """The row of each ``record_id`` with the latest ``received_at`` (null comes first); of rows that tie, the greatest payload and camera."""
    best = F.max(F.struct("received_at", "payload", "camera_id")).alias("row")
    return raw.groupBy("record_id").agg(best).select("record_id", "row.camera_id", "row.payload", "row.received_at")


def request_levels(raw: DataFrame, only: list[str] | None = None) -> DataFrame:
    return shred(valid_requests(raw), "payload", ENVELOPE, _KEEP, only)


# Leaves of the flat tables, by column.
RECORD_LEAVES = {
    "fixture_id": "fixture_id", "mode": "mode", "planned_work": "request/context/planned_work", "observed_at": "request/context/timestamp", "zone_id": "request/context/zone_id",
    "active_conditions": "request/context/active_conditions", "window_seconds": "request/temporal_config/window_seconds", "min_observations": "request/temporal_config/min_observations",
    "persistence_ratio": "request/temporal_config/persistence_ratio", "status": "expected/status", "observability": "expected/observability/score", "score": "expected/match/score", "coverage": "expected/match/coverage", "extra": "$extra",
    "context_camera_id": "request/context/camera_id", "level": "expected/observability/level", "request_extra": "request/$extra", "context_extra": "request/context/$extra", "temporal_config_extra": "request/temporal_config/$extra",
    "expected_extra": "expected/$extra", "observability_extra": "expected/observability/$extra", "match_extra": "expected/match/$extra", "temporal_extra": "expected/temporal/$extra",
}
OBSERVATION_LEAVES = {"kind": "$kind", "planned_work": "context/planned_work", "observed_at": "context/timestamp", "zone_id": "context/zone_id", "active_conditions": "context/active_conditions", "context_camera_id": "context/camera_id", "context_extra": "context/$extra", "raw": "$raw", "extra": "$extra"}
DETECTION_LEAVES = {"kind": "$kind", "raw": "$raw", "class": "class", "class_name": "class_name", "confidence": "confidence", "zone_id": "zone_id", "bbox": "bbox[]/$raw", "extra": "$extra", "track_id": "track/id", "track_extra": "track/$extra"}
TRAIL_LEAVES = {"kind": "$kind", "raw": "$raw", "at": "[]/$raw"}
REQUIREMENT_LEAVES = {"kind": "$kind", "raw": "$raw", "id": "id", "condition": "condition", "reason": "reason", "extra": "$extra"}
OBSERVATIONS = [Part("request/observations[]", 4)]
DETECTIONS = [Part("request/detections[]", 4, "detection"), Part("request/observations[]/detections[]", 7, "detection")]
TRAILS = [Part("request/detections[]/track/trail[]", 8), Part("request/observations[]/detections[]/track/trail[]", 11)]
MISSING = [Part("expected/match/missing[]", 5, "missing"), Part("expected/temporal/persistent_missing[]", 5, "persistent_missing")]
UNCERTAIN = [Part("expected/temporal/persistent_uncertain[]", 5, "persistent_uncertain")]


TABLES = {"records": [], "observations": OBSERVATIONS, "detections": DETECTIONS, "requirements": MISSING + UNCERTAIN, "trails": TRAILS}
_LEAVES = {"observations": OBSERVATION_LEAVES, "detections": DETECTION_LEAVES, "requirements": REQUIREMENT_LEAVES, "trails": TRAIL_LEAVES}


def levels_for(raw: DataFrame, *tables: str) -> DataFrame:
    """The levels of valid requests, of the leaves that the named flat tables take, by default all five."""
    names = tables or tuple(TABLES)
    only = [_below(p.path, leaf) for t in names for p in TABLES[t] for leaf in ["$kind", *_LEAVES[t].values()]]
    return request_levels(raw, only + [x for t in names if t in ("records", "observations") for x in RECORD_LEAVES.values()])


def records(levels: DataFrame) -> DataFrame:
    """One row per readable payload, with the leaves that no array repeats."""
    return levels.select(*_KEEP, *(F.col(f"`{p}`")["v"][0].alias(n) for n, p in RECORD_LEAVES.items()))


def observations(levels: DataFrame) -> DataFrame:
    """One row per observation that isn't null: ``(record_id, obs_no)`` is its key. A request that isn't temporal is its own observation 0."""
    many = assemble(levels, OBSERVATIONS, OBSERVATION_LEAVES, ["obs_no"], ["record_id"])
    one = records(levels).where("mode IS NULL OR mode <> 'temporal'").select("record_id", F.lit(0).alias("obs_no"), F.lit("object").alias("kind"), "planned_work", "observed_at", "zone_id", "active_conditions", "context_camera_id", "context_extra", *(F.lit(None).cast("string").alias(c) for c in ("raw", "extra")))
    return many.unionByName(one)


def detections(levels: DataFrame) -> DataFrame:
    """One row per detection that isn't null, whatever its kind: ``(record_id, obs_no, item_no)``; its parent is ``(record_id, obs_no)``."""
    return assemble(levels, DETECTIONS, DETECTION_LEAVES, ["obs_no", "item_no"], ["record_id"])


def trails(levels: DataFrame) -> DataFrame:
    """One row per point of a detection's track that isn't null: ``(record_id, obs_no, item_no, point_no)``; ``at`` is null where it is no array."""
    return assemble(levels, TRAILS, TRAIL_LEAVES, ["obs_no", "item_no", "point_no"], ["record_id"])


def requirements(levels: DataFrame) -> DataFrame:
    """One row per listed requirement that isn't null: ``(record_id, child, item_no)``."""
    return assemble(levels, MISSING + UNCERTAIN, REQUIREMENT_LEAVES, ["item_no"], ["record_id"], tag="child")


def children(raw: DataFrame) -> DataFrame:
    """``(record_id, child, obs_no, item_no)`` of every detection and missing requirement; only the leaves that tell elements from nulls are shredded."""
    parts = DETECTIONS + MISSING
    levels = request_levels(raw, [f"{p.path}/$kind" for p in parts])
    return assemble(levels, parts, {}, ["obs_no", "item_no"], ["record_id"], tag="child", unique=True)
