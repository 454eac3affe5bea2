"""Vectors and bit strings as array expressions that stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    den = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(den > 0, dot(a, b) / den).otherwise(0.0)


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def ncc(a: Column, b: Column) -> Column:
    """Cosine of the mean-centred vectors."""
    centre = lambda v: F.transform(v, lambda x: x - mean(v))
    return cosine(centre(a), centre(b))


def mae(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def pack_bits(bits: Column) -> Column:
    """Up to 64 booleans as a bigint, the first the most significant."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(F.when(b, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def sign_bits(v: Column) -> Column:
    return F.transform(v, lambda x: x > 0)


def rise_bits(v: Column) -> Column:
    """Whether each value but the first is greater than the one before."""
    return F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda x, y: x > y)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dct_matrix(n: int = 32) -> list[list[float]]:
    """The orthonormal DCT-II matrix."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


def perceptual_hashes(gray32: list[list[float]], gray9x8: list[list[float]]) -> tuple[int, int]:
    """pHash of a 32 x 32 and dHash of an 8 x 9 grey image, as signed 64-bit numbers; decoding and scaling is the caller's.

    pHash: the low 8 x 8 block of the DCT, each value against the median of the 63 besides the first, whose bit is 0.
    """
    import numpy as np

    d = np.array(dct_matrix(32))
    low = np.round((d @ np.asarray(gray32, float) @ d.T)[:8, :8].reshape(-1), 9)
    bits = low > np.median(low[1:])
    bits[0] = False
    g = np.asarray(gray9x8, float)
    signed = lambda b: int.from_bytes(np.packbits(b).tobytes(), "big", signed=True)
    return signed(bits), signed((g[:, 1:] > g[:, :-1]).reshape(-1))
