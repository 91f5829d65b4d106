"""Reference policies on an observed block, and what explains a policy's value.

``block`` is long: (user_idx, action, reward); a missing row is an unobserved
cell and never a zero.  ``weights`` has (context_id, n_rounds).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfold.functions.rows import one_row
from counterfold.functions.skew import lookup_join
from counterfold.functions.statistics import correlation, two_sided_p
from counterfold.operators.ordering import average_rank, dense_index, median_row, prefix_sums
from counterfold.session import durable

N_PERMUTATIONS = 200
TIE_TOLERANCE = 1e-12


def context_weights(rounds: DataFrame) -> DataFrame:
    """One representative round per context and the number of its rounds."""
    return rounds.groupBy("context_id").agg(
        F.min("round_id").alias("representative"), F.count("*").alias("n_rounds"))


def weighted_masked_mean(df: DataFrame, value: str, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over non-NULL values with the scored and masked weight; NULL if none."""
    seen = F.col(value).isNotNull()
    return df.groupBy(*by).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(seen, F.col(weight)))).alias("value"),
        F.coalesce(F.sum(F.when(seen, F.col(weight))), F.lit(0)).alias("rounds_scored"),
        F.coalesce(F.sum(F.when(~seen, F.col(weight))), F.lit(0)).alias("rounds_masked"),
    )


def _truth(block: DataFrame) -> DataFrame:
    return block.select(F.col("user_idx").alias("context_id"), "action", "reward")


def oracle_value(block: DataFrame, weights: DataFrame) -> DataFrame:
    """The best observed action per context: the ceiling on this block."""
    best = _truth(block).groupBy("context_id").agg(F.max("reward").alias("best"))
    return weighted_masked_mean(weights.join(best, "context_id", "left"), "best", "n_rounds")


def constant_values(block: DataFrame, weights: DataFrame) -> DataFrame:
    """Value of playing one action everywhere, over the contexts that observe it."""
    return _truth(block).join(weights, "context_id").groupBy("action").agg(
        (F.sum(F.col("reward") * F.col("n_rounds")) / F.sum("n_rounds")).alias("value"),
        F.sum("n_rounds").alias("rounds_observed"),
    )


def best_constants(values: DataFrame, k: int = 5) -> DataFrame:
    return values.orderBy(F.desc("value"), "action").limit(k)


def constant_ranks(values: DataFrame) -> DataFrame:
    """Rank of each action among the constants: 1 + the count of strictly better ones."""
    counts = values.withColumn("__neg", -F.col("value")).groupBy("__neg").agg(F.count("*").alias("__n"))
    better = prefix_sums(counts, ["__neg"], {"__cum": "__n"}, "__i").select(
        "__neg", (F.col("__cum") - F.col("__n") + 1).cast("long").alias("constant_rank"))
    return values.withColumn("__neg", -F.col("value")).join(better, "__neg").drop("__neg")


def item_feature(train: DataFrame, feature: str = "feature") -> DataFrame:
    """Each action's feature averaged over the log rows that used it."""
    return train.groupBy("action").agg(F.avg(feature).alias("item_feature"))


def feature_confound(features: DataFrame, values: DataFrame) -> DataFrame:
    """Spearman correlation of an item's feature with its value as a constant."""
    both = features.join(values, "action").filter(
        F.col("item_feature").isNotNull() & F.col("value").isNotNull()
    ).select("action", "item_feature", "value")
    ranked = average_rank(average_rank(both, "item_feature", "rx", ["action"]), "value", "ry", ["action"])
    return ranked.agg(
        F.count("*").alias("n_items"), correlation(F.col("rx"), F.col("ry")).alias("spearman_rho"),
    ).join(one_row(median_row(both, "item_feature", "median_feature")), F.lit(True)).withColumn(
        "t_statistic",
        F.col("spearman_rho") * F.sqrt((F.col("n_items") - 2)
                                       / F.nullif(1 - F.col("spearman_rho") ** 2, F.lit(0.0))),
    ).withColumn("p_value", F.when(F.col("spearman_rho") ** 2 < 1, two_sided_p(F.col("t_statistic"), F.col("n_items") - 2)).otherwise(
        F.when((F.col("spearman_rho") ** 2 >= 1) & (F.col("n_items") > 2), F.lit(0.0))))


def top_constants_against_median(features: DataFrame, values: DataFrame, k: int = 5) -> DataFrame:
    both = features.join(values, "action")
    median = median_row(both, "item_feature", "median_feature")
    return best_constants(both, k).join(one_row(median), F.lit(True)).withColumn(
        "feature_vs_median", F.col("item_feature") / F.nullif("median_feature", F.lit(0.0)))


def feature_baseline(features: DataFrame, values: DataFrame) -> DataFrame:
    """What an item is worth given only its feature: an antitonic fit.

    Items without the feature are read off at the median.
    """
    both = values.join(features, "action", "left")
    usable = both.filter(F.col("item_feature").isNotNull() & F.col("value").isNotNull())
    median = median_row(usable, "item_feature", "__m")
    filled = both.join(one_row(median), F.lit(True)).withColumn(
        "x", F.coalesce("item_feature", "__m")).drop("__m")
    assembler = VectorAssembler(inputCols=["x"], outputCol="features")
    model = IsotonicRegression(isotonic=False, labelCol="value", predictionCol="baseline").fit(
        assembler.transform(usable.withColumn("x", F.col("item_feature"))))
    return model.transform(assembler.transform(filled)).select("action", "baseline")


def policy_cells(policy: DataFrame, block: DataFrame, weights: DataFrame) -> DataFrame:
    """A deterministic policy's chosen cells with their observed reward, if any."""
    chosen = policy.select("context_id", "action").join(weights, "context_id")
    return chosen.join(_truth(block), ["context_id", "action"], "left")


def feature_adjusted_value(
    policy: DataFrame, block: DataFrame, weights: DataFrame, baseline: DataFrame
) -> DataFrame:
    """A policy's value, the part its items' feature predicts, and the residual."""
    cells = lookup_join(policy_cells(policy, block, weights), durable(baseline), ["action"])
    seen = F.col("reward").isNotNull()
    w = F.sum(F.when(seen, F.col("n_rounds")))
    return cells.agg(
        (F.sum(F.col("reward") * F.col("n_rounds")) / w).alias("exact_value"),
        (F.sum(F.when(seen, F.col("baseline") * F.col("n_rounds"))) / w).alias("feature_predicted"),
        F.coalesce(w, F.lit(0)).alias("rounds_scored"),
        F.coalesce(F.sum(F.when(~seen, F.col("n_rounds"))), F.lit(0)).alias("rounds_masked"),
    ).withColumn("feature_adjusted_residual", F.col("exact_value") - F.col("feature_predicted"))


#: A prime; squares of numbers below it fit a long.
_PRIME = 2**31 - 1
#: Rounds of a keyed bijection.
_ROUNDS = 6


def bijection_keys(seed: int, rep: int) -> list[int]:
    """One key per round."""
    return [int(hashlib.md5(f"{seed}|{rep}|{k}".encode()).hexdigest()[:7], 16) for k in range(_ROUNDS)]


def permuted(index: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Where each ``index`` of 0..n-1 goes under the bijection of 0..n-1 that its row of ``keys`` names.

    A Feistel network permutes the numbers below the next power of two: its halves take on
    a keyed function of each other in turn.  A number that lands beyond n is sent on until it lands below.
    """
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    low_mask, high_mask = (1 << low) - 1, (1 << (bits - low)) - 1
    out = np.empty(len(index), np.int64)
    at, x = np.arange(len(index)), index.astype(np.int64)
    while len(at):
        halves, k = [x & low_mask, x >> low], keys[at]
        for turn in range(_ROUNDS):
            other, mask = (0, high_mask) if turn % 2 == 0 else (1, low_mask)
            y = (halves[other] + k[:, turn]) % _PRIME
            y = (y * y + k[:, turn]) % _PRIME
            y = ((y * y + k[:, turn]) % _PRIME) >> 5  # the last bits of squares are too regular
            halves[1 - other] ^= y & mask
        x = (halves[1] << low) + halves[0]
        landed = x < n
        out[at[landed]] = x[landed]
        at, x = at[~landed], x[~landed]
    return out


def keyed_bijection(index: Column, rep: Column, n: int, keys: list[list[int]]) -> Column:
    """:func:`permuted` as a column; ``keys`` holds the round keys of each ``rep``."""
    table = np.asarray(keys, np.int64)

    @F.pandas_udf("long")
    def to(i: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(permuted(i.to_numpy(np.int64), table[r.to_numpy(np.int64)], n))

    return to(index.cast("long"), rep.cast("long"))


def personalisation_test(
    policy: DataFrame, block: DataFrame, weights: DataFrame, n_permutations: int = N_PERMUTATIONS,
    seed: int = 42,
) -> DataFrame:
    """Does it matter WHO gets which item?  A permutation test on the assignment.

    In every replicate a keyed bijection of the contexts' numbers says which
    context receives a context's action.  The multiset of actions is kept
    exactly; replicates are neither sorted nor indexed, and meet the
    block, which carries the numbers, in one join.
    """
    cells = policy_cells(policy, block, weights)
    realised = weighted_masked_mean(cells, "reward", "n_rounds").select(F.col("value").alias("realised"))
    chosen = policy.select("context_id", "action").join(weights.select("context_id", "n_rounds"), "context_id")
    indexed = durable(dense_index(chosen, ["context_id", "action"], "i"))
    n = indexed.count()
    keys = [bijection_keys(seed, rep) for rep in range(n_permutations)]
    drawn = indexed.select("i", "action", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("rep")).select(
        "rep", "action", keyed_bijection(F.col("i"), F.col("rep"), n, keys).alias("i"))
    observed = indexed.select("context_id", "n_rounds", "i").join(_truth(block), "context_id").select("i", "action", "n_rounds", "reward")
    null = weighted_masked_mean(drawn.join(observed, ["i", "action"]), "reward", "n_rounds", ("rep",)).filter(F.col("value").isNotNull())
    return null.join(one_row(realised), F.lit(True)).agg(
        F.first("realised").alias("realised"), F.avg("value").alias("shuffled_mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("shuffled_std"),
        F.count_if(F.col("value") >= F.col("realised") - F.lit(TIE_TOLERANCE)).alias("exceed"),
        F.count("*").alias("n_permutations"),
    ).select(
        "realised", "shuffled_mean", "shuffled_std",
        (F.col("realised") - F.col("shuffled_mean")).alias("gain_from_matching"),
        F.when(F.col("shuffled_std") > 0, (F.col("realised") - F.col("shuffled_mean")) / F.col("shuffled_std"))
        .alias("z_score"),
        ((F.col("exceed") + 1.0) / (F.col("n_permutations") + 1.0)).alias("p_value"),
        "n_permutations",
        (F.col("realised").isNotNull() & (F.col("n_permutations") > 0)).alias("usable"),
    )


def concentration(policy: DataFrame, weights: DataFrame, n_actions: int) -> DataFrame:
    """Distinct actions of a policy, its top action's share and its entropy in nats."""
    used = policy.join(weights, "context_id").groupBy("action").agg(
        F.sum("n_rounds").alias("w"), F.count("*").alias("contexts")).filter("w > 0")
    total = used.agg(F.sum("w").alias("total"), F.sum("contexts").alias("n_contexts"))
    share = F.col("w") / F.col("total")
    return used.join(one_row(total), F.lit(True)).agg(
        F.count("*").alias("n_distinct_actions"), F.first("n_contexts").alias("n_contexts"),
        F.max_by("action", F.struct(F.col("w"), -F.col("action"))).alias("top_action"),
        F.max(share).alias("top_action_share"), (-F.sum(share * F.log(share))).alias("entropy_nats"),
    ).withColumn("max_entropy_nats", F.log(F.lit(float(n_actions)))).withColumn(
        "collapsed", F.col("n_distinct_actions") == 1)


def reference_report(
    policies: dict[str, DataFrame], block: DataFrame, weights: DataFrame, train: DataFrame, n_actions: int,
    feature: str | None = "feature", n_permutations: int = N_PERMUTATIONS, seed: int = 42,
) -> DataFrame:
    """One row per agent: value, concentration, matching test and feature residual."""
    constants = constant_values(block, weights)
    ranks = constant_ranks(constants).select(F.col("action").alias("top_action"), "constant_rank")
    baseline = None
    if feature is not None:
        baseline = feature_baseline(item_feature(train, feature), constants)
    out = None
    for agent, policy in policies.items():
        value = weighted_masked_mean(policy_cells(policy, block, weights), "reward", "n_rounds")
        row = value.join(one_row(concentration(policy, weights, n_actions)), F.lit(True))
        row = row.join(ranks, "top_action", "left")
        test = personalisation_test(policy, block, weights, n_permutations, seed)
        row = row.join(one_row(test.select("shuffled_mean", "gain_from_matching", "z_score", "p_value")), F.lit(True))
        if baseline is not None:
            adjusted = feature_adjusted_value(policy, block, weights, baseline)
            row = row.join(one_row(adjusted.select("feature_predicted", "feature_adjusted_residual")), F.lit(True))
        row = row.withColumn("agent", F.lit(agent))
        out = row if out is None else out.unionByName(row)
    return out
