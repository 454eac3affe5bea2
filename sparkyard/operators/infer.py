"""The plug-in boundary: a detector that turns image bytes into detections."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkyard.operators.detections import MIN_CONFIDENCE
from sparkyard.sources.files import MAX_IMAGE_BYTES, check_body, image_size

_DETECTION = pa.list_(pa.struct([("class", pa.string()), ("confidence", pa.float64()), ("bbox", pa.list_(pa.float64()))]))
_SPARK = T.ArrayType(T.StructType([T.StructField("class", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))]))


class Provider(Protocol):
    name: str

    def infer(self, image: bytes, filename: str) -> list[dict]: ...


class ConstantProvider:
    """Gives the same detections for every image; for tests and dry runs."""

    name = "constant"

    def __init__(self, detections: list[dict] | None = None):
        self.detections = detections or []

    def infer(self, image: bytes, filename: str) -> list[dict]:
        return self.detections


def load_factory(spec: str) -> Callable[[], Provider]:
    """The factory named by ``module:function``."""
    module, _, name = spec.partition(":")
    if not module or not name:
        raise ValueError("a factory is named module:function")
    return getattr(importlib.import_module(module), name)


#: Status of an answer by the beginning of the problem, first that fits: what the sender did wrong, else the detector's failure.
STATUS = [("ValueError: empty image", 400), ("ValueError: image too large", 413), ("ValueError: unknown image format", 415), ("ValueError: invalid image", 422)]


def status_of(problem: Column) -> Column:
    """200 without a problem, 400 for no image, 413 for too large a one, 415 and 422 for one that can't be read, 503 where the detector failed."""
    out = F.when(problem.isNull(), 200)
    for start, code in STATUS:
        out = out.when(F.startswith(problem, F.lit(start)), code)
    return out.otherwise(503)


def infer(images: DataFrame, factory: Callable[[], Provider], keep: list[str], path: str = "path", least: float = MIN_CONFIDENCE, verify: bool = False) -> DataFrame:
    """``keep`` with ``detections`` and ``problem`` of each image (``content``); the detector is made once per task and an image that fails stops no other.

    Detections below ``least`` are left out. With ``verify`` an image whose header or length is wrong doesn't reach the detector.
    """
    schema = T.StructType([*(images.schema[k] for k in keep), T.StructField("detections", _SPARK), T.StructField("problem", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            found, problems = [], []
            for data, name in zip(b.column("content").to_pylist(), b.column("$path").to_pylist()):
                try:
                    if not data:
                        raise ValueError("empty image")
                    if len(data) > MAX_IMAGE_BYTES:
                        raise ValueError("image too large")
                    if verify:
                        image_size(data)
                        check_body(data)
                    found.append([d for d in provider.infer(data, name) if d.get("confidence") is None or d["confidence"] >= least])
                    problems.append(None)
                except Exception as e:  # noqa: BLE001
                    found.append(None)
                    problems.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(found, _DETECTION), pa.array(problems, pa.string())], schema.names)

    return images.withColumn("$path", images[path]).select(*keep, "content", "$path").mapInArrow(run, schema)
