"""Vector and numeric expressions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Dot product, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays (X11)."""
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(F.when(norm(v) == 0, 1.0).otherwise(norm(v)), F.size(v)).alias("n")), lambda p: p["x"] / p["n"])


def mean_vector(vectors: Column) -> Column:
    """Mean of an array of vectors with non-finite entries as 0."""
    finite = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), 0.0).otherwise(x)
    zero = F.array_repeat(F.lit(0.0), F.size(F.get(vectors, F.lit(0))))
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + finite(b.cast("double"))))
    return F.transform(total, lambda x: x / F.size(vectors))


def paired_cosine(v: Column) -> Column:
    """Cosine of the first two quarters of a vector, mapped to 0..1; a width that 4 doesn't divide is an error."""
    quarter = (F.size(v) / 4).cast("int")
    a, b = F.slice(v, F.lit(1), quarter), F.slice(v, quarter + 1, quarter)
    score = 0.5 * (dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8)) + 1)
    return F.when(F.size(v) % 4 == 0, score).otherwise(F.raise_error(F.lit("the vector's width is no multiple of 4")).cast("double"))


def concatenated(*vectors: Column) -> Column:
    return F.concat(*(doubles(v) for v in vectors))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def score_class(score: Column) -> Column:
    """low, medium or high by thirds of the clipped score."""
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.when(s >= 0.66, "high").when(s >= 0.33, "medium").otherwise("low")
