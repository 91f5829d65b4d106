"""Splits and folds decided by exact ranks, without sorting the data."""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterfold.errors import refuse_if
from counterfold.functions.hashing import hash32
from counterfold.operators.ordering import cut_by_rank, extent, hashed_index, prefix_sums
from counterfold.params import SplitParams

PARTS = ("train", "validation", "test")


def split_points(n_rows: int, params: SplitParams) -> tuple[int, int]:
    """Ends of train and validation, clamped so that no part is empty."""
    refuse_if(n_rows < 3, "too_few_rows", "three non-empty parts need three rows", rows=n_rows)
    wanted, end = [], 0
    for share in (params.train_ratio, params.val_ratio):
        end += int(n_rows * share)
        wanted.append(end)
    # each cut leaves a row for every part before it and after it
    cuts: list[int] = []
    for i, cut in enumerate(wanted):
        least = (cuts[-1] if cuts else 0) + 1
        most = n_rows - (len(wanted) - i)
        cuts.append(sorted((least, cut, most))[1])
    return cuts[0], cuts[1]


def split_rows(
    df: DataFrame, params: SplitParams, seed: int = 42, row_key: str = "round_id", check: bool = True
) -> DataFrame:
    """Add ``part``; temporal by ``(timestamp, row_key)`` or random by a hash order.

    The boundaries are found as order statistics, so the result is the input
    with one more expression: nothing is sorted or shuffled.
    """
    if params.strategy == "temporal":
        ts = params.timestamp_column
        refuse_if(ts not in df.columns, "missing_timestamp", f"no column {ts!r}", columns=df.columns[:20])
        span = extent(df, ts)
        out = cut_by_rank(df, [ts, row_key], split_points(span[2], params), PARTS, "part", span)
        if check:
            assert_ordered(out, ts)
        return out
    hashed = df.withColumn("__h", hash32(seed, row_key))
    span = extent(hashed, "__h")
    return cut_by_rank(hashed, ["__h", row_key], split_points(span[2], params), PARTS, "part", span).drop("__h")


def split_training_log(df: DataFrame, params: SplitParams, seed: int = 42, row_key: str = "round_id") -> DataFrame:
    """Train and validation only, for when a block is the test part.

    The held-out share is cut as two equal parts that are then joined, which
    keeps the rounding of the three-way cut.
    """
    total = params.train_ratio + params.val_ratio
    held = params.val_ratio / total
    inner = dc.replace(
        params, train_ratio=params.train_ratio / total, val_ratio=held / 2, test_ratio=held / 2
    )
    out = split_rows(df, inner, seed, row_key)
    return out.withColumn("part", F.when(F.col("part") == "test", "validation").otherwise(F.col("part")))


def part_ranges(df: DataFrame, ts: str) -> DataFrame:
    """Rows and time range of every part, with its order against the part before."""
    order = F.when(F.col("part") == "train", 0).when(F.col("part") == "validation", 1).otherwise(2)
    stats = df.groupBy("part").agg(
        F.count("*").alias("n_rows"), F.min(ts).alias("t_min"), F.max(ts).alias("t_max")
    ).withColumn("part_no", order)
    before = F.lag("t_max").over(Window.orderBy("part_no"))  # three rows
    return stats.withColumn("leaks", F.coalesce(before > F.col("t_min"), F.lit(False))).withColumn(
        "boundary_tied", F.coalesce(before == F.col("t_min"), F.lit(False))
    )


def assert_ordered(df: DataFrame, ts: str) -> None:
    leaks = [r["part"] for r in part_ranges(df, ts).filter("leaks").collect()]
    refuse_if(bool(leaks), "temporal_leakage", "a part starts before the one before it ends", parts=leaks)


def split_edges(edges: DataFrame, val_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``is_val`` to ``max(1, int(E * fraction))`` edges drawn uniformly."""
    refuse_if(not 0 < val_fraction < 1, "bad_fraction", "val_fraction must be in (0, 1)")
    hashed = edges.withColumn("__h", hash32(seed, "src", "dst"))
    span = extent(hashed, "__h")
    n_val = max(1, int(span[2] * val_fraction))
    return cut_by_rank(hashed, ["__h", "src", "dst"], [n_val], [True, False], "is_val", span).drop("__h")


def _fold_ends(n: int, k: int) -> list[int]:
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    return [sum(sizes[: i + 1]) for i in range(k - 1)]


def context_folds(contexts: DataFrame, n_folds: int, seed: int = 42, key: str = "context_id") -> DataFrame:
    """Add ``fold`` to each distinct context; fold sizes differ by at most one."""
    refuse_if(n_folds < 2, "too_few_folds", "one fold would score its own training rows", folds=n_folds)
    hashed = contexts.withColumn("__h", hash32(seed, key))
    span = extent(hashed, "__h")
    n = span[2]
    refuse_if(n < n_folds, "too_few_contexts", "fewer contexts than folds", contexts=n, folds=n_folds)
    return cut_by_rank(hashed, ["__h", key], _fold_ends(n, n_folds), list(range(n_folds)), "fold", span).drop("__h")


def stratified_folds(
    contexts: DataFrame, n_folds: int, seed: int = 42, stratum: str = "supported",
    key: str = "context_id", group: tuple[str, ...] = (),
) -> DataFrame:
    """Balanced folds inside each (group, stratum).

    Used with ``stratum`` = "the context has any round of positive weight", so
    that no training fold can lose all its weight.
    """
    groups = [*group, stratum]
    ranked = hashed_index(contexts.withColumn("__h", hash32(seed, key)), "__h", key, "__i", groups)
    sizes = ranked.groupBy(*groups).agg((F.max("__i") + 1).alias("__n"))
    base, rest = F.floor(F.col("__n") / n_folds), F.col("__n") % n_folds
    wide = rest * (base + 1)
    fold = F.when(F.col("__i") < wide, F.floor(F.col("__i") / (base + 1))).otherwise(
        rest + F.floor((F.col("__i") - wide) / F.greatest(base, F.lit(1)))
    )
    return ranked.join(sizes, groups).withColumn("fold", fold.cast("int")).drop("__h", "__i", "__n")


def deal_rounds(
    rows: DataFrame, n_folds: int, seed: int = 42, key: str = "round_id", mult: str = "n", group: tuple[str, ...] = (),
) -> DataFrame:
    """Folds of rounds, given rows that each stand for ``mult`` alike rounds.

    The rounds of a ``group`` are laid out in the order of a hash of their row's ``key`` and dealt to the
    folds in turn, so that folds differ by at most one round, in all and within each row.
    Which of its alike rounds a fold gets makes no difference, so a row
    is never written out: one row comes back for each fold that has any, with their number.
    """
    hashed = rows.select(*group, key, F.col(mult).cast("long").alias(mult), hash32(seed, key).alias("__h"))
    placed = prefix_sums(hashed, ["__h", key], {"__end": mult}, "__i", group)
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold")
    below = lambda end: F.floor((end - F.col("fold") + n_folds - 1) / n_folds)
    return placed.select(*group, key, mult, "__end", fold).select(
        *group, key, "fold", (below(F.col("__end")) - below(F.col("__end") - F.col(mult))).alias(mult)).where(F.col(mult) > 0)


def fold_leaks(rounds: DataFrame, folds: DataFrame) -> DataFrame:
    """Contexts that sit in more than one fold (must be none)."""
    return (
        rounds.select("context_id").distinct().join(folds, "context_id")
        .groupBy("context_id").agg(F.count_distinct("fold").alias("n_folds")).filter("n_folds > 1")
    )
