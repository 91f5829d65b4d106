"""Attaching the single row of a global aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> DataFrame:
    """Mark a one-row table (a global aggregate) to be sent to all tasks.

    ``big.join(one_row(total), F.lit(True))`` adds its columns to every row of
    ``big``; the broadcast side is a single row by construction.
    """
    return F.broadcast(df)
