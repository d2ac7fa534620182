"""Vector arithmetic on array<double> columns, as JVM-side expressions.

Higher-order functions are evaluated per element, so these suit wide tables with short vectors; model training uses
the Arrow kernels in ``weft.operators.fcm`` instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Squared distances up to this count as an exact match with a center.
EXACT = 1e-12


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Column | str) -> Column:
    """Any numeric array as array<double>."""
    return col(x).cast("array<double>")


def total(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column | str, factor: Column | float) -> Column:
    return F.transform(col(a), lambda x: x * factor)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(a: Column | str, zero: str = "raise") -> Column:
    """The vector at length 1. Zero vectors raise an error, stay as they are (``keep``) or become null (``null``)."""

    def scaled(v: Column) -> Column:
        other = {"raise": F.raise_error(F.lit("a vector has length zero")).cast("array<double>"), "keep": v, "null": F.lit(None).cast("array<double>")}[zero]
        return let(norm(v), lambda length: F.when(length > EXACT, F.transform(v, lambda x: x / length)).otherwise(other))

    return let(col(a), scaled)


def squared_chord(a: Column | str, b: Column | str) -> Column:
    """Squared distance of unit vectors, from their cosine."""
    return F.greatest(2 - 2 * dot(a, b), F.lit(0.0))


def squared_euclid(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine of unit vectors, the cosine clipped to [-1, 1]."""
    return 1 - F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))


def _shares(weights: Column) -> Column:
    return let(weights, lambda w: let(total(w), lambda t: F.transform(w, lambda x: x / t)))


def memberships(d2: Column | str, m: float) -> Column:
    """Fuzzy memberships from squared distances; centers that are matched exactly share everything equally."""

    def of(d: Column) -> Column:
        hits = F.transform(d, lambda x: F.when(x <= EXACT, 1.0).otherwise(0.0))
        return let(F.array_min(d), lambda least: F.when(least <= EXACT, _shares(hits)).otherwise(_shares(F.transform(d, lambda x: F.pow(x / least, F.lit(-1.0 / (m - 1)))))))

    return let(col(d2), of)


def softmax_negative(d: Column | str) -> Column:
    """Softmax of negative distances, shifted by the smallest."""
    return let(col(d), lambda v: let(F.array_min(v), lambda least: _shares(F.transform(v, lambda x: F.exp(least - x)))))


def argmax(u: Column | str) -> Column:
    """Index from 0 of the largest entry, the first one on ties."""
    return (F.array_position(col(u), F.array_max(col(u))) - 1).cast("long")


def top(u: Column | str, k: int) -> Column:
    """The k-th largest entry, from 1; null if there are fewer."""
    return F.get(F.sort_array(col(u), False), F.lit(k - 1))


def gap(u: Column | str) -> Column:
    """Largest minus second largest entry; 1 if there is one entry."""
    return F.when(F.size(col(u)) < 2, F.lit(1.0)).otherwise(top(u, 1) - top(u, 2))


def normalized_rows(u: Column | str) -> Column:
    """A row of nonnegative weights that sums to 1; negative entries count as 0."""
    clipped = F.transform(col(u), lambda x: F.greatest(x, F.lit(0.0)))
    return let(clipped, lambda c: let(total(c), lambda t: F.when(t > 0, F.transform(c, lambda x: x / t)).otherwise(c)))


def finite(x: Column | str) -> Column:
    """A double, or null where it is not finite."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def greatest_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.greatest(a, b), columns)
