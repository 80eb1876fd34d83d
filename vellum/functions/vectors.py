"""Vector Column functions on ``array<float|double>`` (F12, F13), JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products in double, in array order."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def l2_normalize(a: str | Column) -> Column:
    """unit-length copy in double; a zero vector is returned unchanged."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(
        F.transform(_c(a), lambda x: x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """cosine similarity; 0.0 when either side has zero length."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def relevance(cos: Column, mode: str = "cosine") -> Column:
    """Scale a cosine to the relevance used by the threshold: ``cosine`` as is, ``unit`` =
    (1 + cos) / 2 in [0, 1]."""
    if mode == "cosine":
        return cos
    if mode == "unit":
        return (F.lit(1.0) + cos) / 2.0
    raise ValueError(f"unknown relevance mode: {mode}")
