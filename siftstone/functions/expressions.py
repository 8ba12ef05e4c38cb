"""Column expressions: vectors, clipping and numbers drawn by hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(key: Column, stream: int | str) -> Column:
    """A number in [0, 1) that depends on the key and the stream alone: md5's first 32 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(stream)))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_normal(key: Column, stream: str) -> Column:
    """Standard normal by Box-Muller over two hashed uniforms."""
    u, v = F.greatest(hash_uniform(key, f"{stream}a"), F.lit(1e-12)), hash_uniform(key, f"{stream}b")
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * 3.141592653589793) * v)


def hash_laplace(key: Column, stream: str) -> Column:
    """Standard Laplace by the inverse of its distribution function."""
    u = hash_uniform(key, stream) - 0.5
    return -F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-12)))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, low), high))


def vector(features: list[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
