"""Column expressions over ``ARRAY<FLOAT>`` vectors (readable form, JVM only).

Large inputs go through the block kernels in ``operators.similarity``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 9  # scores are compared and ranked after rounding to this many places


def _doubles(vector: Column | str) -> Column:
    return F.col(vector).cast("array<double>") if isinstance(vector, str) else vector.cast("array<double>")


def dimension(vector: Column | str) -> Column:
    return F.size(vector)


def norm(vector: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vector: Column | str, length: Column) -> Column:
    """``vector / length`` stored as float; a zero vector stays all zeros.

    ``length`` is passed in so callers compute the norm once per row.
    """
    return F.transform(
        _doubles(vector), lambda x: F.when(length != 0, x / length).otherwise(F.lit(0.0)).cast("float")
    )


def dot(left: Column | str, right: Column | str) -> Column:
    products = F.zip_with(_doubles(left), _doubles(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def score_of_distance(distance: Column) -> Column:
    return F.lit(1.0) - distance


def distance_of_score(score: Column) -> Column:
    return F.lit(1.0) - score
