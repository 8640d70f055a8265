"""Arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """Rounded to so many decimals, half to even on the binary value."""
    scale = float(10**digits)
    return F.rint(x.cast("double") * scale) / scale


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, not once for each element that looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalised(v: Column) -> Column:
    """Divided by its L2 norm; a zero vector stays zero."""
    return once(norm(v), lambda length: F.transform(doubles(v), lambda x: F.when(length > 0, x / length).otherwise(0.0)))


def cosine(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(0.0)


def finite(v: Column) -> Column:
    """Whether no element is null, NaN or infinite."""
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_float(x: Column, default: float = 0.0) -> Column:
    """As a double; unparsable, NaN and infinite values give the default."""
    value = x.try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), default).otherwise(value)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = once(top, lambda t: F.transform(scores, lambda s: F.exp(s - t)))
    return once(total(powers), lambda whole: F.transform(powers, lambda p: p / whole))


def mean_vector(vectors: Column) -> Column:
    """The element-wise mean of an array of vectors of one length."""
    n = F.size(vectors)
    return F.transform(F.sequence(F.lit(0), F.size(vectors[0]) - 1), lambda i: total(F.transform(vectors, lambda v: F.get(v, i).cast("double"))) / n)


def gate(experts: Column, weights: list[list[float]]) -> Column:
    """Weights of the experts: softmax of a linear map of their mean."""
    query = mean_vector(experts)
    return softmax(F.array(*[dot(query, F.array(*map(F.lit, row))) for row in weights]))


def fuse(experts: Column, weights: Column) -> Column:
    """The sum of the experts, each times its weight."""
    scaled = F.zip_with(experts, weights, lambda v, w: F.transform(v, lambda x: x.cast("double") * w))
    return F.transform(F.sequence(F.lit(0), F.size(experts[0]) - 1), lambda i: total(F.transform(scaled, lambda v: F.get(v, i))))
