"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column | str) -> Column:
    """NULL for NaN: missing values are NULL everywhere in this library."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c, F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's r of pairs without NULL; NULL, not an error, where one side is constant."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def supported(agg: Column, counted: Column | str, least: int) -> Column:
    """An aggregate where at least ``least`` values are not NULL, else NULL."""
    return F.when(F.count(counted) >= least, agg)


def first_max(value: Column | str, position: Column | str) -> Column:
    """Position of the largest value; the first wins a tie.  (An aggregate.)"""
    value, position = (F.col(x) if isinstance(x, str) else x for x in (value, position))
    return -F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-position).alias("p"))))["p"]


def first_min(value: Column | str, position: Column | str) -> Column:
    """Position of the smallest value; the first wins a tie.  (An aggregate.)"""
    value, position = (F.col(x) if isinstance(x, str) else x for x in (value, position))
    return F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), position.alias("p"))))["p"]


def grid_bin(x: Column | str, start: float = 20.0, stop: float = 100.0, step: float = 0.2) -> Column:
    """Number of the half-open bin [edge i, edge i+1) that holds x; NULL outside, and on the last edge.

    The quotient's floor is put right against the edges themselves (start + i * step as doubles add up), so values
    on an edge fall as a search in the table of edges would have them.
    """
    x = F.col(x) if isinstance(x, str) else x
    width, n = (start + step) - start, round((stop - start) / step)
    edge = lambda i: F.lit(start) + i * F.lit(width)
    guess = F.floor((x - start) / width)
    right = F.when(x < edge(guess), guess - 1).when(x >= edge(guess + 1), guess + 1).otherwise(guess)
    return F.when((right >= 0) & (right < n), right.cast("int"))


def rearranged(q: Column | str) -> Column:
    """Quantiles put in rising order."""
    return F.array_sort(q)


def recentred(q: Column | str, point: Column | str, middle: int = 2) -> Column:
    """Quantiles moved so that the middle one is the point forecast."""
    q, point = (F.col(x) if isinstance(x, str) else x for x in (q, point))
    return F.transform(q, lambda x: x + (point - F.get(q, F.lit(middle))))


def widened(q: Column | str, point: Column | str, scale: Column | float) -> Column:
    """Quantiles pushed away from the point forecast by a factor."""
    q, point = (F.col(x) if isinstance(x, str) else x for x in (q, point))
    return F.transform(q, lambda x: point + (x - point) * scale)


def pinball(y: Column, p: Column, q: Column | float) -> Column:
    """Pinball loss of one forecast quantile."""
    d = y - p
    return F.greatest(q * d, (q - 1) * d)


def quality_weight(valid: Column | str, spread: Column | str, floor: float = 0.05, half: float = 30.0) -> Column:
    """max(valid, floor) / (1 + spread / half); an unknown spread counts as ``half``, an unknown validity as NULL."""
    valid, spread = (F.col(x) if isinstance(x, str) else x for x in (valid, spread))
    return F.when(valid.isNotNull(), F.greatest(valid, F.lit(floor)) / (1 + F.coalesce(spread, F.lit(half)) / half))


def bin_code(x: Column | str, edges: Column | str) -> Column:
    """How many edges are at or below x; 0 for NULL."""
    x, edges = (F.col(c) if isinstance(c, str) else c for c in (x, edges))
    return F.when(x.isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e <= x)))
