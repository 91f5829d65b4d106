"""Invariants as aggregates: one pass counts every violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.errors import refuse_if

def round_violations(rounds: DataFrame, n_actions: int) -> DataFrame:
    """Counts of rows breaking each rule of a rounds table."""
    bad_p = F.col("propensity").isNull() | ~((F.col("propensity") > 0) & (F.col("propensity") <= 1))
    bad_a = F.col("action").isNull() | (F.col("action") < 0) | (F.col("action") >= n_actions)
    return rounds.agg(
        F.count("*").alias("n_rounds"),
        F.count_if(bad_a).alias("action_out_of_range"),
        F.count_if(bad_p).alias("propensity_out_of_range"),
        F.count_if(F.col("reward").isNull() | F.isnan("reward")).alias("reward_missing"),
    )


def validate_rounds(rounds: DataFrame, n_actions: int) -> DataFrame:
    row = round_violations(rounds, n_actions).first().asDict()
    refuse_if(row["n_rounds"] == 0, "no_rounds", "there is nothing to evaluate")
    bad = {k: v for k, v in row.items() if k != "n_rounds" and v}
    refuse_if(bool(bad), "invalid_rounds", "rows break the rounds contract", **bad)
    return rounds


def policy_violations(policy: DataFrame, n_actions: int, tolerance: float = 1e-4) -> DataFrame:
    """Contexts whose probabilities do not sum to one, and actions outside the range."""
    per_context = policy.groupBy("context_id").agg(
        F.sum("prob").alias("total"),
        F.count_if((F.col("action") < 0) | (F.col("action") >= n_actions)).alias("bad_actions"),
    )
    return per_context.agg(
        F.count("*").alias("n_contexts"),
        F.count_if(F.abs(F.col("total") - 1) > tolerance).alias("not_normalised"),
        F.coalesce(F.sum("bad_actions"), F.lit(0)).alias("action_out_of_range"),
    )


def validate_policy(policy: DataFrame, n_actions: int) -> DataFrame:
    row = policy_violations(policy, n_actions).first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_contexts" and v}
    refuse_if(bool(bad), "invalid_policy", "not a distribution over the actions", **bad)
    return policy


def constant_propensity(rounds: DataFrame) -> DataFrame:
    """Whether all propensities agree (relative 1e-5, absolute 1e-8)."""
    return rounds.agg(
        F.min("propensity").alias("propensity_min"), F.max("propensity").alias("propensity_max")
    ).withColumn(
        "propensity_is_constant",
        F.col("propensity_max") - F.col("propensity_min")
        <= F.lit(1e-8) + F.lit(1e-5) * F.abs("propensity_min"),
    )


def reward_reproduction(rounds: DataFrame, block: DataFrame) -> DataFrame:
    """How many rounds the ground truth fails to reproduce.

    Mismatches are possible only through duplicate cells, whose last row wins.
    """
    joined = rounds.join(
        block.select("user_idx", "action", F.col("reward").alias("__truth")), ["user_idx", "action"], "left"
    )
    return joined.agg(
        F.count("*").alias("n_rounds"),
        F.count_if(F.col("__truth").isNull()).alias("not_found"),
        F.count_if(F.col("__truth") != F.col("reward")).alias("mismatched"),
    )


def assert_reproduces(rounds: DataFrame, block: DataFrame, duplicates: int) -> None:
    row = reward_reproduction(rounds, block).first()
    refuse_if(row["not_found"] > 0, "round_not_in_block", "rounds lack a ground-truth cell",
              rounds=row["not_found"])
    refuse_if(row["mismatched"] > duplicates, "reward_not_reproduced",
              "the ground truth contradicts the logged rewards",
              mismatched=row["mismatched"], duplicates=duplicates)


def inconsistent_contexts(rounds: DataFrame) -> DataFrame:
    """Context ids that carry more than one distinct context vector.

    Minimum and maximum of the vector combine map-side, so a context holding
    most of the rows needs no shuffle of them.
    """
    return (
        rounds.groupBy("context_id")
        .agg(F.min("context").alias("lo"), F.max("context").alias("hi"))
        .filter(F.col("lo") != F.col("hi"))
        .select("context_id")
    )


def planned_cells(contexts: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: how many rows a table of all contexts with all actions would have."""
    return contexts.distinct().agg(F.count("*").alias("__c")).crossJoin(
        actions.distinct().agg(F.count("*").alias("__a"))).select((F.col("__c") * F.col("__a")).alias("cells"))
