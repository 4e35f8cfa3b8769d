"""Column expressions over ``ARRAY<FLOAT|DOUBLE>`` vectors, always in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papersheaf.functions.binding import bind


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_norm(vector: Column) -> Column:
    return F.aggregate(doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return bind(
        F.sqrt(squared_norm(vector)),
        lambda norm: F.when(norm == 0, doubles(vector)).otherwise(F.transform(doubles(vector), lambda x: x / norm)),
    )


def centered(vector: Column) -> Column:
    """Subtract the vector's own mean."""
    return bind(
        F.try_divide(total(doubles(vector)), F.size(vector)),
        lambda mean: F.transform(doubles(vector), lambda x: x - mean),
    )
