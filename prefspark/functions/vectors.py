"""Dense-vector expressions over ARRAY<DOUBLE> (higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    """Sum of element-wise products, left to right."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    """Squared Euclidean norm."""
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)
