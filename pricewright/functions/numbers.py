"""Rounding, defaults, and statistics of sorted arrays, as column expressions.

Rounding is half up (``floor(x + 0.5)``), also for negative numbers.  A default
replaces 0 as well as null.  Ranks in an array are computed in doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def or_default(x: Column, default: Column) -> Column:
    """The default where ``x`` is null or 0."""
    return F.coalesce(F.nullif(x, F.lit(0)), default)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def digits(text: Column) -> Column:
    """The number that the digits of a text make up; null without digits or beyond a long."""
    return F.regexp_replace(text, r"[^0-9]", "").try_cast("long")


def tier(x: Column, tiers: Sequence[tuple], pick: int) -> Column:
    """Entry ``pick`` of the first tier whose upper bound is not exceeded."""
    chain = None
    for row in tiers[:-1]:
        chain = F.when(x <= row[0], row[pick]) if chain is None else chain.when(x <= row[0], row[pick])
    return chain.otherwise(tiers[-1][pick])


def at_rank(values: Column, share: float) -> Column:
    """``values[floor(n * share)]`` of a sorted array; null if it is empty."""
    return F.get(values, F.floor(F.size(values) * F.lit(float(share))).cast("int"))


def interpolated(values: Column, percent: float) -> Column:
    """Percentile between neighbours, rounded where it lies between two; 0 for none."""
    place = F.lit(percent / 100.0) * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    weight = place - low
    between = half_up(F.get(values, low) * (1 - weight) + F.get(values, F.ceil(place).cast("int")) * weight)
    return F.when(F.size(values) == 0, F.lit(0.0)).when(weight == 0, F.get(values, low).cast("double")).otherwise(between.cast("double"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def trimmed_mean(values: Column, percent: int = 10) -> Column:
    """Rounded mean without the lowest and highest ``percent`` of a sorted array.

    Up to four values are averaged as they are; of more, one at least goes at each
    end.  Null for no values.
    """
    n = F.size(values)
    cut = F.greatest(F.lit(1), F.floor(n * F.lit(percent / 100.0)).cast("int"))
    middle = F.slice(values, cut + 1, F.greatest(n - 2 * cut, F.lit(0)))
    used = F.when(n <= 4, values).otherwise(F.when(F.size(middle) == 0, values).otherwise(middle))
    return half_up(total(used) / F.nullif(F.size(used), F.lit(0)))


def without_outliers(values: Column, low: int = 50_000, high: int = 150_000_000) -> Column:
    """Sorted values inside ``low``..``high`` and within 1.5 quartile ranges of the quartiles.

    Fewer than four values stay as they are.
    """
    valid = F.filter(values, lambda x: (x >= low) & (x <= high))
    q1, q3 = at_rank(valid, 0.25), at_rank(valid, 0.75)
    floor, ceiling = F.greatest(F.lit(low).cast("double"), q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)
    return F.when(F.size(valid) < 4, valid).otherwise(F.filter(valid, lambda x: (x >= floor) & (x <= ceiling)))


def spread(values: Column) -> Column:
    """Population standard deviation over the mean, from exact sums of whole numbers."""
    n = F.size(values).cast("double")
    sums = F.aggregate(values, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    s, q = sums["s"].cast("double"), sums["q"].cast("double")
    return F.sqrt(F.greatest(F.lit(0.0), (n * q - s * s) / F.nullif(n * n, F.lit(0.0)))) / F.nullif(s / F.nullif(n, F.lit(0.0)), F.lit(0.0))


def slope(y: str, x: str) -> Column:
    """Least-squares slope of whole-number columns, an aggregate over the rows where both are given.

    The sums are exact, so the order of the rows does not matter; null for fewer
    than two rows or a constant x.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("long")), F.when(both, F.col(y).cast("long"))
    n, sx, sy = F.count(a).cast("double"), F.sum(a).cast("double"), F.sum(b).cast("double")
    sxx, sxy = F.sum(a * a).cast("double"), F.sum(a * b).cast("double")
    return (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))
