"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows below which a plain join is already cheap whatever the key distribution.
PLAIN_JOIN_ROWS = 5_000_000
#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there can be
#: at most HOT_SHARE hot keys: the broadcast list has a proven bound.
HOT_SHARE = 1_000


#: Planned size below which rows need not be counted before choosing the join.
PLAIN_JOIN_BYTES = 16 * 1024 * 1024


def _planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; it only ever saves the count, never a row."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Rows of a task in shuffles whose number of tasks follows the rows.
ROWS_PER_TASK = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for so many rows: what the session says, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))


_PARTITIONS, _COALESCE = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"


@contextlib.contextmanager
def tasks_by_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside is shuffled to :func:`tasks_for` partitions, so that a task's part doesn't grow with the input.

    Small partitions are put together again only while there is less than one full task for each core.
    """
    before = {key: spark.conf.get(key) for key in (_PARTITIONS, _COALESCE)}
    spark.conf.set(_PARTITIONS, str(tasks_for(spark, rows)))
    if rows > ROWS_PER_TASK * spark.sparkContext.defaultParallelism:
        spark.conf.set(_COALESCE, "false")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _holds_arrays(df: DataFrame) -> bool:
    """The optimizer counts an array as one value, so such a table may be far larger than it thinks."""
    return any(isinstance(f.dataType, T.ArrayType) for f in df.schema.fields)


def spread_join(
    big: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    salt_by: list[str] | None = None,
    plain_rows: int = PLAIN_JOIN_ROWS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Join many rows to one row per key, splitting hot keys over many tasks.

    Every row of ``big`` meets its ``dim`` row exactly once: the rows of a hot
    key are dealt over ``k`` salts by a hash of ``salt_by`` and that key's
    ``dim`` row is repeated ``k`` times.  ``k`` is the key's share of the data in
    units of 1/``hot_share``, so at most ``2 * hot_share`` extra ``dim`` rows
    arise.  ``how`` may be ``left`` or ``inner``; cold keys have one salt.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"spread_join supports left and inner joins, not {how!r}")
    hint = (lambda d: d.hint("merge")) if _holds_arrays(dim) else (lambda d: d)
    if _planned_bytes(big) <= PLAIN_JOIN_BYTES and plain_rows == PLAIN_JOIN_ROWS:
        return big.join(hint(dim), on, how)
    total = big.count()
    if total <= plain_rows:
        return big.join(hint(dim), on, how)
    threshold = max(1, total // hot_share)
    hot = (
        big.groupBy(*on).count()
        .filter(F.col("count") > threshold)
        .select(*on, F.ceil(F.col("count") / F.lit(threshold)).cast("int").alias("__salts"))
    )
    hot = F.broadcast(hot)
    keys = salt_by or [c for c in big.columns if c not in on]
    salted_big = big.join(hot, on, "left").withColumn(
        "__salt",
        F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.coalesce("__salts", F.lit(1))).cast("int"),
    ).drop("__salts")
    salted_dim = dim.join(hot, on, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    ).drop("__salts")
    return salted_big.join(hint(salted_dim), [*on, "__salt"], how).drop("__salt")


#: Bytes up to which a lookup table is broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024


def _bytes_of(col: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, but for what rows cost anyway."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(col)
    elif isinstance(kind, T.ArrayType):
        flat = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
        size = 8 * F.size(col) if flat else F.length(F.to_json(col))
    elif isinstance(kind, (T.MapType, T.StructType)):
        size = F.length(F.to_json(col))
    else:
        size = F.lit(0)
    return F.coalesce(size.cast("long"), F.lit(0)) + 8


def fits_broadcast(dim: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of ``dim`` together stay within ``most`` bytes; reads ``dim`` once."""
    row = F.lit(16)
    for f in dim.schema.fields:
        row = row + _bytes_of(F.col(f.name), f.dataType)
    return (dim.agg(F.sum(row)).first()[0] or 0) <= most


def lookup_join(
    big: DataFrame, dim: DataFrame, on: list[str], how: str = "left", salt_by: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a lookup table that is cheap to read, such as one already written.

    Shuffling rows by a key with few values would put them into few tasks.  A
    table measured to be small is broadcast instead; a larger one has many keys
    and goes through :func:`spread_join`.
    """
    if fits_broadcast(dim, broadcast_bytes):
        return big.join(F.broadcast(dim), on, how)
    return spread_join(big, dim, on, how, salt_by)
