"""Vector kernels as column expressions in double precision: the JVM runs them, no Python worker is started.

Rules of the expressions: null if a vector is missing or the lengths differ; cosine with a zero vector is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")


def _sum(of: Column) -> Column:
    return F.aggregate(of, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(F.size(a) == F.size(b), F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(length != 0, length)))


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Larger is nearer: cosine and dot as they are, Euclidean distance d as 1 / (1 + d)."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        return F.lit(1.0) / (F.lit(1.0) + euclidean(a, b))
    raise ValueError(f"metric {metric!r} is none of {', '.join(METRICS)}")


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    unit = lambda n: F.when(n == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / n))
    return F.get(F.transform(F.array(norm(v)), unit), 0)  # within a lambda the norm would be computed for each component


def is_valid(v: Column) -> Column:
    """Not null or empty, and all components finite."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    return F.coalesce((F.size(v) > 0) & F.forall(_double(v), finite), F.lit(False))
