"""Fingerprints of decoded images: perceptual hashes, a small grey image and a colour histogram, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkyard.functions.vectors import perceptual_hashes

GREY, BINS = 64, 16


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of an image of height x width x 3."""
    return rgb.astype(float) @ np.array([0.299, 0.587, 0.114])


def scaled(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grey image scaled by the mean over each target pixel's area; edges count by the share that lies inside."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        low, high = edge[:-1, None], edge[1:, None]
        at = np.arange(n)[None, :]
        part = np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None)
        return part / part.sum(axis=1, keepdims=True)

    return np.round(weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T, 9)  # an even image stays even


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of 16 steps of each colour, one after the other, as a vector of length 1."""
    h = np.concatenate([np.bincount(rgb[..., c].reshape(-1) // (256 // BINS), minlength=BINS) for c in range(3)]).astype(float)
    return h / np.linalg.norm(h)


def fingerprints(images: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``phash``, ``dhash``, ``grey`` (64 x 64, row by row, 0 to 1), ``histogram`` (48) and ``problem`` of decoded images ``width, height, rgb`` (bytes, row by row).

    Decoding is the caller's. Scaling is by area, so hashes agree with those of other scalers only nearly. An image of no pixels, or of another length than its size says, has only a problem.
    """
    floats = T.ArrayType(T.FloatType(), False)
    schema = T.StructType([*(images.schema[k] for k in keep), T.StructField("phash", T.LongType()), T.StructField("dhash", T.LongType()), T.StructField("grey", floats), T.StructField("histogram", floats), T.StructField("problem", T.StringType())])
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.string())

    def one(w: int | None, h: int | None, data: bytes | None) -> tuple:
        if not w or not h or not data or len(data) != w * h * 3:
            return None, None, None, None, "wrong_size"
        rgb = np.frombuffer(data, np.uint8).reshape(h, w, 3)
        g = grey(rgb)
        p, d = perceptual_hashes(scaled(g, 32, 32), scaled(g, 8, 9))
        return p, d, (scaled(g, GREY, GREY) / 255).reshape(-1).astype(np.float32), histogram(rgb).astype(np.float32), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(*x) for x in zip(*(b.column(c).to_pylist() for c in ("$w", "$h", "$rgb")))]
            columns = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(c, t) for c, t in zip(columns, kinds))], schema.names)

    return images.select(*keep, images["width"].alias("$w"), images["height"].alias("$h"), images["rgb"].alias("$rgb")).mapInArrow(run, schema)
