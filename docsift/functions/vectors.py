"""Vector columns: distances, similarities and sanity facts of ``array`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

LOW_POWER = 1e-4


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(value)) for value in values])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return _sum(F.zip_with(_doubles(left), _doubles(right), lambda x, y: x * y))


def l2_squared(left: Column, right: Column) -> Column:
    return _sum(F.zip_with(_doubles(left), _doubles(right), lambda x, y: (x - y) * (x - y)))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 where a vector is all zero."""
    length = norm(left) * norm(right)
    return F.when(length == 0, 0.0).otherwise(dot(left, right) / F.when(length != 0, length))


def sanity_columns(vector: Column) -> dict[str, Column]:
    """Dimension, all-zero flag, mean square, and whether that is suspiciously low."""
    power = dot(vector, vector) / F.greatest(F.lit(1), F.size(vector))
    return {
        "dimension": F.size(vector).cast("bigint"),
        "all_zero": F.forall(vector, lambda value: value == 0),
        "mean_square": power,
        "low_power": power < LOW_POWER,
    }
