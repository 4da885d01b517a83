"""Vector expressions on array columns. Sums run from left to right in double precision, so results are repeatable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column | str, b: Column | str) -> Column:
    """Null if a vector is null; a missing element makes the product null."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def normalize(a: Column | str) -> Column:
    """Length one, as array<double>; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(_col(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """0 if one of them is a zero vector."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).when(both == 0, F.lit(0.0))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine similarity: smaller is closer; exactly 1 to a zero vector."""
    return F.lit(1.0) - cosine_similarity(a, b)
