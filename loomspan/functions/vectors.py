"""Vector algebra on array columns, in double precision and inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit vector; the zero vector stays near zero."""
    n = norm(a) + 1e-10
    return F.transform(a, lambda x: x / n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def analogy(a: Column, b: Column, c: Column) -> Column:
    """c + (b - a)."""
    return add(c, subtract(b, a))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Great-circle interpolation of directions; nearly parallel vectors, and those beside a zero vector, go straight."""
    cos = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(1.0))
    omega = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))

    def move(o: Column) -> Column:
        wa, wb = F.sin((1 - t) * o) / F.sin(o), F.sin(t * o) / F.sin(o)
        return F.when(o < 1e-8, lerp(a, b, t)).otherwise(F.zip_with(a, b, lambda x, y: x * wa + y * wb))

    return F.transform(F.array(omega), move)[0]


def rounded(v: Column, digits: int = 6) -> Column:
    """Halves go away from zero, what rounds to zero keeps its sign; numbers beyond 1e300 stay as they are."""
    m = 10.0**digits
    return F.transform(v, lambda x: F.when(F.abs(x) < 1e300, F.signum(x) * F.round(F.abs(x) * m) / m).otherwise(x))


#: Scores by metric: (expression of query and vector, whether greater is better).
METRICS = {
    "cosine": (lambda q, v: dot(q, v) / (norm(q) * norm(v) + 1e-10), True),
    "euclidean": (squared_distance, False),
    "dotproduct": (dot, True),
}
