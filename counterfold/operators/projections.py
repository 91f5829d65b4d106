"""Columns: persona keys, feature selection, context vectors, reward shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterfold.errors import refuse_if
from counterfold.functions.skew import fits_broadcast, lookup_join
from counterfold.operators.encoding import as_category

#: Largest finite double: what an infinite feature becomes.
MAX_FINITE = 1.7976931348623157e308


def require_columns(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    refuse_if(bool(missing), "missing_column", f"{what} lacks required columns", missing=missing)
    return df


def persona_key(columns: list[str]) -> Column:
    """Joined text of the feature tuple; no columns gives one constant persona."""
    if not columns:
        return F.lit("0")
    return F.concat_ws("|", *[as_category(c) for c in columns])


def numeric_features(df: DataFrame, names: list[str] = (), patterns: list[str] = ()) -> list[str]:
    """Explicit names, then columns matching a pattern; only numeric ones remain."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = [c for c in names if c in types]
    wanted += [c for c in df.columns if any(p in c for p in patterns) and c not in wanted]
    numeric = [c for c in wanted if isinstance(types[c], (T.NumericType, T.BooleanType))]
    refuse_if(not numeric, "no_numeric_features", "no usable feature column", asked=wanted)
    return numeric


def finite(col: str | Column) -> Column:
    """NaN and NULL become 0, infinities the largest finite values."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    clean = F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(clean, F.lit(MAX_FINITE)), F.lit(-MAX_FINITE))


def context_vector(columns: list[str]) -> Column:
    return F.array(*[finite(c) for c in columns])


def attach_state(
    rounds: DataFrame, embeddings: DataFrame, on: str = "user_idx", salt_by: list[str] | None = None
) -> DataFrame:
    """Add the user's embedding as ``context``; a user without one is refused."""
    dim = embeddings.select(on, F.col("embedding").alias("context"))
    missing = rounds.select(on).distinct().join(dim.select(on), on, "left_anti").count()
    refuse_if(missing > 0, "embedding_missing", "users have no embedding", users=missing)
    return lookup_join(rounds.drop("context"), dim, [on], "inner", salt_by)


def binarise_treatment(column: str, reference) -> Column:
    """1 for any value other than the reference."""
    return (F.col(column) != F.lit(reference)).cast("int")


def shape_rewards(
    rounds: DataFrame, cate: DataFrame | None, weight: float, key: str = "round_id"
) -> DataFrame:
    """``reward + weight * cate``; weight 0 leaves rewards alone."""
    if weight == 0:
        return rounds
    refuse_if(cate is None, "shaping_without_effects", "a weight is set but no effects are given")
    lost = rounds.select(key).join(cate.select(key), key, "left_anti").count()
    refuse_if(lost > 0, "effects_incomplete", "rounds have no effect estimate", rounds=lost)
    return (
        rounds.join(cate.select(key, "cate"), key)
        .withColumn("reward", F.col("reward") + F.lit(float(weight)) * F.col("cate"))
        .drop("cate")
    )


def keep_actions(rounds: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows whose ``action`` is in the universe; the log itself keeps all its rows."""
    actions = universe.select("action").distinct()
    return rounds.join(F.broadcast(actions) if fits_broadcast(actions) else actions, "action", "left_semi")


def part_arrays(prepared: DataFrame, part: str) -> DataFrame:
    """The numeric columns of one partition, ready for fitting."""
    keep = ["round_id", "user_idx", "action", "reward", "propensity"]
    return prepared.filter(F.col("part") == part).select(*[c for c in keep if c in prepared.columns])
