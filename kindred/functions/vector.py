"""Column expressions on dense vectors; all stay in the JVM."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus and multipliers of the fixture generator of hyperplanes (fixed values).
_M, _A, _B = 2147483647, 48271, 16807


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: str | Column, b: str | Column, na: str | Column, nb: str | Column) -> Column:
    """Cosine similarity from cached norms; null where either norm is zero or null."""
    return F.try_divide(dot(a, b), _c(na) * _c(nb))


def angle(cos: str | Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _c(cos))))


def upper_bound(theta: str | Column, theta_b: str | Column) -> Column:
    """No seed within theta_b of the centroid can be nearer than theta - theta_b."""
    t, b = _c(theta), _c(theta_b)
    return F.when(t > b, F.cos(t - b)).otherwise(F.lit(1.0))


def ring_bound(theta: str | Column, theta_a: str | Column, theta_b: str | Column) -> Column:
    """No seed whose angle to the centroid lies in theta_a to theta_b can be nearer than theta lies to that range."""
    t = _c(theta)
    return F.cos(F.greatest(F.lit(0.0), t - _c(theta_b), _c(theta_a) - t))


def fixture_planes(n_bits: int, dims: int, sample: int = 0) -> list[list[float]]:
    """Planes that any SQL engine can make as well: linear in plane and dimension, for tests only."""
    rows = range(sample * n_bits, (sample + 1) * n_bits)
    return [[((p * 7919 + j * 104729 + 12345) * _A % _M * _B % _M) / float(_M) * 2.0 - 1.0 for j in range(1, dims + 1)] for p in rows]


def random_planes(n_bits: int, dims: int, seed: int = 0, normal: bool = False) -> list[list[float]]:
    """Independent components, uniform in [-1, 1) or of the standard normal distribution."""
    rng = random.Random(seed)
    draw = (lambda: rng.gauss(0.0, 1.0)) if normal else (lambda: rng.uniform(-1.0, 1.0))
    return [[draw() for _ in range(dims)] for _ in range(n_bits)]


def planes_column(planes: list[list[float]]) -> Column:
    """Planes as a constant that Catalyst folds."""
    if not planes:
        return F.array().cast("array<array<double>>")
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in planes])


def signature(v: str | Column, planes: Column) -> Column:
    """Bucket number: a bit per plane, the first plane the most significant; dot >= 0 sets the bit."""
    bit = lambda w: F.when(dot(v, w) >= 0.0, F.lit(1)).otherwise(F.lit(0))
    return F.aggregate(planes, F.lit(0), lambda acc, w: acc * F.lit(2) + bit(w))
