"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Inner product of two arrays in double precision."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(v) -> Column:
    """Unit vector; a zero vector stays zero."""
    # the length is bound once as the argument of an outer lambda; inlined it would be computed per element
    return F.transform(
        F.array(norm(v)), lambda n: F.transform(_col(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    )[0]


def knn_score(cosine: Column) -> Column:
    """Search score of a cosine: (1 + cos) / 2."""
    return (1.0 + cosine) / 2.0
