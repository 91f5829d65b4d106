"""Where the logging policy's propensities come from, always with a label."""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.errors import refuse_if
from counterfold.functions.rows import one_row
from counterfold.functions.skew import lookup_join, spread_join
from counterfold.params import NEEDS_PROPENSITY, EvaluationParams

#: Rounds per cell above which a block is a log rather than an enumeration.
ENUMERATED_ROUNDS_PER_CELL = 1.5


@dc.dataclass(frozen=True)
class BehaviourPolicy:
    """Counts of the training rows: per (user, action), per user, per action."""

    pairs: DataFrame
    totals: DataFrame
    marginal: DataFrame
    n_actions: int
    shrinkage: float

    @property
    def label(self) -> str:
        return f"estimated:user_conditional_shrinkage(alpha={self.shrinkage:g})"


def fit_behaviour_policy(train: DataFrame, n_actions: int, shrinkage: float = 10.0) -> BehaviourPolicy:
    """Per-user action shares shrunk towards the Laplace-smoothed marginal.

    The log is scanned once into (user, action) counts; totals and marginal are
    sums of those.
    """
    refuse_if(train.isEmpty(), "no_rounds", "a behaviour policy needs logged rounds")
    pairs = train.groupBy("user_idx", "action").agg(F.count("*").alias("n_pair"))
    totals = pairs.groupBy("user_idx").agg(F.sum("n_pair").alias("n_user"))
    counts = pairs.groupBy("action").agg(F.sum("n_pair").alias("n_action"))
    grand = counts.agg(F.sum("n_action").alias("n_all"))
    actions = train.sparkSession.range(n_actions).select(F.col("id").alias("action"))
    marginal = actions.join(counts, "action", "left").join(one_row(grand), F.lit(True)).select(
        "action",
        ((F.coalesce("n_action", F.lit(0)) + 1.0) / (F.col("n_all") + float(n_actions))).alias("marginal"),
    )
    return BehaviourPolicy(pairs, totals, marginal, n_actions, float(shrinkage))


def score_cells(policy: BehaviourPolicy, cells: DataFrame) -> DataFrame:
    """Add ``propensity`` to distinct (user_idx, action) cells.

    A pair the training log never saw keeps the shrinkage term, so overlap
    never breaks.
    """
    a = F.lit(policy.shrinkage)
    return (
        lookup_join(cells, policy.marginal, ["action"], "inner")
        .join(policy.pairs, ["user_idx", "action"], "left")
        .join(policy.totals, "user_idx", "left")
        .withColumn("propensity", (F.coalesce("n_pair", F.lit(0)) + a * F.col("marginal"))
                    / (F.coalesce("n_user", F.lit(0)) + a))
        .withColumn("unseen_user", F.col("n_user").isNull())
        .drop("marginal", "n_pair", "n_user")
    )


def score_rounds(policy: BehaviourPolicy, rounds: DataFrame, salt_by: list[str] | None = None) -> DataFrame:
    """Add ``propensity`` to rounds: one score per cell, then one join back."""
    cells = rounds.select("user_idx", "action").distinct()
    scored = score_cells(policy, cells).drop("unseen_user")
    return spread_join(rounds, scored, ["user_idx", "action"], "inner", salt_by)


def behaviour_diagnostics(policy: BehaviourPolicy, rounds: DataFrame) -> DataFrame:
    """Fit of the estimated policy on rounds against the uniform one.

    Rounds are counted per cell first, so the averages are weighted sums.
    """
    cells = score_cells(policy, rounds.groupBy("user_idx", "action").agg(F.count("*").alias("n")))
    n = F.sum("n")
    return cells.agg(
        (F.sum(F.col("n") * F.log("propensity")) / n).alias("mean_log_likelihood"),
        F.lit(1.0 / policy.n_actions).alias("u"),
        F.min("propensity").alias("propensity_min"), F.max("propensity").alias("propensity_max"),
        (F.sum(F.when(F.col("unseen_user"), F.col("n")).otherwise(0)) / n).alias("unseen_user_fraction"),
    ).withColumn("uniform_log_likelihood", F.log("u")).drop("u").withColumn(
        "beats_uniform", F.col("mean_log_likelihood") > F.col("uniform_log_likelihood")
    )


def enumerated_cells(block: DataFrame) -> DataFrame:
    """``n(u,a) / n(u)`` per cell of a block, read off its design."""
    cells = block.groupBy("user_idx", "action").agg(F.count("*").alias("n_cell"))
    users = cells.groupBy("user_idx").agg(F.sum("n_cell").alias("n_user"))
    return cells.join(users, "user_idx").withColumn("propensity", F.col("n_cell") / F.col("n_user"))


def enumerated_propensities(block: DataFrame, salt_by: list[str] | None = None) -> DataFrame:
    """Block rows with their enumerated propensity."""
    cells = enumerated_cells(block).select("user_idx", "action", "propensity")
    return spread_join(block, cells, ["user_idx", "action"], "inner", salt_by)


def enumeration_diagnostics(block: DataFrame) -> DataFrame:
    return enumerated_cells(block).agg(
        F.sum("n_cell").alias("block_rows"), F.count("*").alias("block_distinct_cells"),
        (F.sum("n_cell") / F.count("*")).alias("block_rows_per_cell"),
        F.min("propensity").alias("block_propensity_min"), F.max("propensity").alias("block_propensity_max"),
    ).withColumn("is_enumeration", F.col("block_rows_per_cell") <= ENUMERATED_ROUNDS_PER_CELL)


def assign_propensities(
    rounds: DataFrame, n_actions: int, params: EvaluationParams, propensity_column: str | None = None,
    block_part: str | None = None,
) -> tuple[DataFrame, str]:
    """Add ``propensity`` and ``propensity_source`` to a rounds table with ``part``.

    In order: a block's own enumeration for its part, logged values, a fitted
    policy; a weighted estimator without any of these is refused, and otherwise
    a constant is written that is labelled as one.
    """
    log = rounds if block_part is None else rounds.filter(F.col("part") != block_part)
    if propensity_column and propensity_column in rounds.columns:
        source = "logged"
        log = log.withColumn("propensity", F.col(propensity_column).cast("double"))
    elif params.behaviour_policy == "estimated":
        policy = fit_behaviour_policy(rounds.filter(F.col("part") == "train"), n_actions, params.shrinkage)
        source = policy.label
        log = score_rounds(policy, log)
    else:
        needed = sorted(set(params.estimators) & NEEDS_PROPENSITY)
        covered = block_part is not None and not rounds.filter(F.col("part") == block_part).isEmpty()
        refuse_if(bool(needed) and not covered, "no_propensity",
                  "weighted estimators need logged, enumerated or estimated propensities", estimators=needed)
        source = f"constant:uniform(1/{n_actions})"
        log = log.withColumn("propensity", F.lit(1.0 / n_actions))
    if block_part is not None:
        block = enumerated_propensities(rounds.filter(F.col("part") == block_part))
        log = log.select(*[c for c in log.columns if c in block.columns])
        out = log.unionByName(block.select(*log.columns))
        source = f"eval_block:enumerated_empirical | log:{source}"
    else:
        out = log
    return out.withColumn("propensity_source", F.lit(source)), source
