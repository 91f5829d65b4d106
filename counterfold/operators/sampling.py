"""Seeded samples that come out the same on every cluster layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterfold.functions.hashing import hash32
from counterfold.operators.ordering import extent, key_before, order_boundaries

#: Default rows per chunk of the proportional sampler.
CHUNK_ROWS = 500_000


def sample_exact(df: DataFrame, n_rows: int, seed: int, key: str) -> DataFrame:
    """Exactly ``n_rows`` rows, uniform without replacement, keyed by ``key``.

    The sample is the ``n_rows`` smallest of a hash order.  Its end is found as an
    exact order statistic, so the sample is a plain filter: no sort, no shuffle,
    and any sample size.
    """
    hashed = df.withColumn("__h", hash32(seed, key))
    span = extent(hashed, "__h")
    if n_rows >= span[2]:
        return df
    (end,) = order_boundaries(hashed, ["__h", key], [n_rows])
    return hashed.filter(key_before(["__h", key], end)).drop("__h")


def sample_by_chunk(
    df: DataFrame, n_target: int, seed: int, row_seq: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Proportional share of every chunk of consecutive rows.

    ``row_seq`` numbers the rows in file order; a chunk holds at most
    ``chunk_rows`` of them, so its ranking window is bounded.  Shares are rounded
    half to even per chunk, so the size is close to ``n_target``, not equal.
    """
    total = df.count()
    if n_target >= total:
        return df
    fraction = n_target / total
    chunked = df.withColumn("__chunk", F.floor(F.col(row_seq) / F.lit(chunk_rows)))
    in_chunk = Window.partitionBy("__chunk")
    return (
        chunked.withColumn("__rn", F.row_number().over(
            in_chunk.orderBy(hash32(seed, row_seq), F.col(row_seq))))
        .withColumn("__take", F.bround(F.count("*").over(in_chunk) * F.lit(fraction), 0))
        .filter(F.col("__rn") <= F.col("__take"))
        .drop("__chunk", "__rn", "__take")
    )
