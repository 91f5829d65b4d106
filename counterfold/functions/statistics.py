"""Aggregates that stay defined on degenerate input."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL, not an error, when a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def two_sided_p(t: Column, df: Column) -> Column:
    """Chance of a Student t of ``df`` (whole, at least 1) degrees beyond ``t`` on either side.

    The finite series for whole degrees of freedom; NULL without any.
    """
    angle = F.atan(t / F.sqrt(df))
    square = F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    first = F.when(odd, F.cos(angle)).otherwise(1.0)
    terms = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    steps = F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def add(s: Column, k: Column) -> Column:
        ratio = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = s["term"] * ratio * square
        return F.struct((s["sum"] + term).alias("sum"), term.alias("term"))

    series = F.aggregate(steps, F.struct(first.alias("sum"), first.alias("term")), add, lambda s: s["sum"])
    inside = F.when(df == 1, 2 * angle / F.lit(math.pi)).when(
        odd, F.lit(2 / math.pi) * (angle + F.sin(angle) * series)).otherwise(F.sin(angle) * series)
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - F.abs(inside)))
