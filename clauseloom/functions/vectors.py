"""Dense vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(vector: Column | str) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.cast("array<double>")


def inner_product(left: Column | str, right: Column | str) -> Column:
    """Sum of element-wise products: the cosine when both sides have unit length."""
    products = F.zip_with(_doubles(left), _doubles(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(_doubles(vector), F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(vector: Column | str, norm: Column | None = None) -> Column:
    """Scale to unit length; a zero vector stays zero. Pass ``norm`` if it is already a column."""
    v = _doubles(vector)
    length = l2_norm(v) if norm is None else norm
    return F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length))
