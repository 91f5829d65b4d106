"""Dense codes for categories and identifiers, kept as dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfold.errors import refuse_if
from counterfold.functions.skew import lookup_join
from counterfold.operators.ordering import dense_index
from counterfold.session import durable

#: Code of a value the vocabulary does not hold.
UNKNOWN = -1


def as_category(col: str | Column) -> Column:
    """Everything is compared as text; a missing value is the text ``nan``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit("nan"))


def fit_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """``(column_name, value, code)`` with codes 0..k-1 in sorted value order."""
    distinct = df.select(as_category(column).alias("value")).distinct()
    coded = dense_index(distinct, ["value"], "code")
    return durable(coded.select(F.lit(column).alias("column_name"), "value", "code"))


def extend_vocabulary(vocab: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Append unseen values after the largest code; existing codes never change."""
    return vocab.unionByName(new_values(vocab, df, column))


def new_values(vocab: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that ``vocab`` lacks, with the codes after its largest one."""
    known = vocab.filter(F.col("column_name") == column)
    start = known.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("m")).first()["m"] + 1
    fresh = (
        df.select(as_category(column).alias("value")).distinct()
        .join(known.select("value"), "value", "left_anti")
    )
    return dense_index(fresh, ["value"], "code").select(
        F.lit(column).alias("column_name"), "value", (F.col("code") + F.lit(start)).alias("code")
    )


def encode_categories(df: DataFrame, vocab: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by its code; a value outside the vocabulary is -1."""
    out = df
    for column in columns:
        dim = vocab.filter(F.col("column_name") == column).select(
            F.col("value").alias("__value"), F.col("code").alias("__code")
        )
        out = (
            lookup_join(out.withColumn("__value", as_category(column)), dim, ["__value"])
            .withColumn(column, F.coalesce("__code", F.lit(UNKNOWN)).cast("long"))
            .drop("__value", "__code")
        )
    return out


def unknown_rate(df: DataFrame, vocab: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows whose value the vocabulary lacks, and its size, per column."""
    coded = encode_categories(df.select(*columns), vocab, columns)
    rates = coded.agg(*[F.avg((F.col(c) < 0).cast("double")).alias(c) for c in columns])
    long = rates.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns])
    )).alias("column_name", "unknown_rate"))
    sizes = vocab.groupBy("column_name").agg(F.count("*").alias("cardinality"))
    return long.join(sizes, "column_name", "left").select(
        "column_name", "unknown_rate", F.coalesce("cardinality", F.lit(0)).alias("cardinality")
    )


def fit_index(
    frames: list[DataFrame], column: str
) -> DataFrame:
    """``(raw_id, idx)`` over the sorted distinct ids of all ``frames``.

    One index across the log and the evaluation block, so that the same id is
    the same row everywhere.
    """
    ids = None
    for frame in frames:
        part = frame.select(F.col(column).alias("raw_id")).filter(F.col("raw_id").isNotNull()).distinct()
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.distinct() if len(frames) > 1 else ids
    return durable(dense_index(ids, ["raw_id"], "idx"))


def refuse_unseen(df: DataFrame, index: DataFrame, column: str) -> None:
    """Refuse ids the index was not fitted on, with their count and ten examples."""
    unseen = df.select(column).distinct().join(index.select(F.col("raw_id").alias(column)), column, "left_anti")
    examples = [r[0] for r in unseen.limit(10).collect()]
    if examples:
        refuse_if(True, "unseen_identifier", f"{column} holds ids the index was not fitted on",
                  count=unseen.count(), examples=examples)


def apply_index(
    df: DataFrame, index: DataFrame, column: str, name: str, strict: bool = True,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """Add ``name`` = dense index of ``column``.

    ``strict`` refuses unseen ids with their count and ten examples; otherwise
    they become -1.
    """
    dim = index.select(F.col("raw_id").alias(column), F.col("idx").alias(name))
    if strict:
        refuse_unseen(df, index, column)
    joined = lookup_join(df, dim, [column], "left", salt_by)
    return joined.withColumn(name, F.coalesce(name, F.lit(UNKNOWN)).cast("long"))


def invert_index(df: DataFrame, index: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name`` = raw id for the dense index in ``column``."""
    return df.join(index.select(F.col("idx").alias(column), F.col("raw_id").alias(name)), column, "left")


def first_appearance(df: DataFrame, key: str, round_id: str) -> DataFrame:
    """Groups numbered by first appearance, each with its representative round."""
    groups = df.groupBy(key).agg(F.min(round_id).alias("representative"), F.count("*").alias("n_rounds"))
    return dense_index(groups, ["representative"], "group_no")
