"""Policies fitted on counts and moments, and how they decide.

A policy is a table ``(context_id, action, prob)``; a deterministic one has a
single row of probability 1 per context.  The names say what is fitted: these
are not the neural learners whose targets some of them share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from counterfold.errors import refuse_if
from counterfold.functions.rows import one_row
from counterfold.operators.moments import moment_sums
from counterfold.operators.propensity import BehaviourPolicy, score_cells
from counterfold.params import PolicyParams
from counterfold.session import durable

#: Bytes of arm parameters sent to executors at once; more arms go in shards.
ARM_BROADCAST_BYTES = 128 * 1024 * 1024


def action_values(rounds: DataFrame) -> DataFrame:
    """``(context_id, action, n, q)``: mean reward per logged cell."""
    return rounds.groupBy("context_id", "action").agg(
        F.count("*").alias("n"), F.avg("reward").alias("q")
    )


def best_action(values: DataFrame, score: str) -> DataFrame:
    """The best action per context; ties go to the lowest action."""
    return values.groupBy("context_id").agg(
        F.max_by("action", F.struct(F.col(score), -F.col("action"))).alias("action")
    ).withColumn("prob", F.lit(1.0))


def greedy_mean(rounds: DataFrame) -> DataFrame:
    """Greedy on the mean logged reward: what a terminal-only value learner targets."""
    return best_action(action_values(rounds), "q")


def supported_actions(rounds: DataFrame, behaviour: BehaviourPolicy, flexibility: float = 0.3) -> DataFrame:
    """Logged cells whose behaviour probability is at least ``flexibility`` of the highest.

    The highest is over ALL actions.  A logged action always scores above its
    own shrinkage term, so the maximum over actions a user never took is
    reached by the largest marginal: one number, no grid.
    """
    values = action_values(rounds).withColumn("user_idx", F.col("context_id"))
    scored = score_cells(behaviour, values).join(behaviour.totals, "user_idx", "left")
    top = behaviour.marginal.agg(F.max("marginal").alias("top_marginal"))
    floor = F.lit(behaviour.shrinkage) * F.col("top_marginal") / (
        F.coalesce("n_user", F.lit(0)) + F.lit(behaviour.shrinkage))
    peak = F.greatest(F.max("propensity").over(Window.partitionBy("context_id")), floor)
    return scored.join(one_row(top), F.lit(True)).withColumn("support", F.col("propensity") / peak).filter(
        F.col("support") >= flexibility
    ).select("context_id", "action", "n", "q", "propensity", "support")


def greedy_supported(rounds: DataFrame, behaviour: BehaviourPolicy, flexibility: float = 0.3) -> DataFrame:
    """Greedy among the sufficiently supported actions.

    A context none of whose logged actions is supported keeps the plain greedy
    choice, so every context has an action.
    """
    chosen = best_action(supported_actions(rounds, behaviour, flexibility), "q")
    rest = greedy_mean(rounds).join(chosen.select("context_id"), "context_id", "left_anti")
    return chosen.unionByName(rest)


def advantage_weighted(rounds: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Expectile state value and advantage-weighted action shares.

    ``v`` is the expectile of a context's action values.  Between two neighbouring
    values its equation is linear, so prefix sums in their order give one
    root per stretch, and the first root that lies in its stretch is the exact
    answer.  All windows share one partitioning.  ``pi`` is proportional to
    ``n * min(exp(beta * (q - v)), clip)``.
    """
    ctx = Window.partitionBy("context_id")
    upto = ctx.orderBy("q").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    low, high = F.lit(1 - params.expectile), F.lit(params.expectile)
    nq = F.col("n") * F.col("q")
    below, below_q = F.sum("n").over(upto), F.sum(nq).over(upto)
    root = (low * below_q + high * (F.sum(nq).over(ctx) - below_q)) / (low * below + high * (F.sum("n").over(ctx) - below))
    out = action_values(rounds).withColumn("__root", root).withColumn(
        "__next", F.lead("q").over(ctx.orderBy("q")))
    # equal values give equal roots, and a root beyond an equal next value is that of the next stretch
    holds = F.when(F.col("__next").isNull() | (F.col("__root") <= F.col("__next")), F.greatest("__root", "q"))
    out = out.withColumn("v", F.min(holds).over(ctx))
    weight = F.col("n") * F.least(
        F.exp(F.lit(params.beta) * (F.col("q") - F.col("v"))), F.lit(params.max_advantage_weight))
    return out.withColumn("__a", weight).withColumn(
        "prob", F.col("__a") / F.sum("__a").over(ctx)
    ).select("context_id", "action", "prob", "q", "v")


def softmax_policy(scores: DataFrame, score: str = "score") -> DataFrame:
    """Max-shifted softmax of action scores per context."""
    ctx = Window.partitionBy("context_id")
    e = F.exp(F.col(score) - F.max(score).over(ctx))
    return scores.withColumn("__e", e).withColumn("prob", F.col("__e") / F.sum("__e").over(ctx)).select(
        "context_id", "action", "prob")


def policy_actions(policy: DataFrame) -> DataFrame:
    """One action per context: the most probable, ties to the lowest action.

    A uniform policy has no table and therefore no per-context action.
    """
    return best_action(policy, "prob").select("context_id", "action")


def popularity_constants(train: DataFrame, min_count: int = 100) -> DataFrame:
    """Constant policies chosen from the training log alone, one row per rule."""
    stats = train.groupBy("action").agg(F.count("*").alias("n"), F.avg("reward").alias("rate"))
    any_popular = stats.agg((F.max("n") >= min_count).alias("__popular"))
    eligible = F.when(~F.col("__popular") | (F.col("n") >= min_count), F.col("rate"))
    picks = stats.join(one_row(any_popular), F.lit(True)).agg(
        F.max_by(F.struct("action", "n", "rate"), F.struct(F.col("n"), -F.col("action"))).alias("most"),
        F.max_by(F.struct("action", "n", "rate"), F.struct(eligible, -F.col("action"))).alias("best"),
    )
    return picks.select(F.explode(F.array(
        F.struct(F.lit("most_interactions").alias("rule"), F.col("most.*")),
        F.struct(F.lit("highest_logged_reward_rate").alias("rule"), F.col("best.*")),
    )).alias("p")).select("p.rule", "p.action", F.col("p.n").alias("log_interactions"),
                          F.col("p.rate").alias("log_reward_rate"))


# ------------------------------------------------------------------ LinUCB


def linucb_statistics(rounds: DataFrame, dim: int) -> DataFrame:
    """Per-arm ``X'X``, ``X'r`` and counts: ``(action, xx, xr, n)``, by :func:`moment_sums`."""
    rows = rounds.select("action", "context", F.lit(1.0).alias("w"), F.col("reward").alias("s"))
    return moment_sums(rows, ["action"], dim).select("action", "xx", F.col("xs").alias("xr"), "n")


def merge_linucb(parts: DataFrame) -> DataFrame:
    """Add up partial statistics; chunked fitting equals fitting at once."""
    return parts.groupBy("action").agg(
        vector_to_array(Summarizer.sum(array_to_vector("xx"))).alias("xx"),
        vector_to_array(Summarizer.sum(array_to_vector("xr"))).alias("xr"),
        F.sum("n").alias("n"),
    )


def linucb_arms(statistics: DataFrame, n_actions: int, dim: int, ridge: float = 1.0) -> DataFrame:
    """``(action, theta, inverse)`` for every arm; an unseen arm keeps its prior."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prior = ridge * np.eye(dim)
        for batch in batches:
            rows = []
            for action, xx, xr in zip(batch["action"], batch["xx"], batch["xr"], strict=True):
                seen = xx is not None
                gram = prior + (np.asarray(xx).reshape(dim, dim) if seen else 0.0)
                inverse = np.linalg.inv(gram)
                theta = inverse @ (np.asarray(xr) if seen else np.zeros(dim))
                rows.append((int(action), theta.tolist(), inverse.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["action", "theta", "inverse"])

    arms = statistics.sparkSession.range(n_actions).select(F.col("id").alias("action"))
    return arms.join(statistics, "action", "left").select("action", "xx", "xr").mapInPandas(
        solve, "action long, theta array<double>, inverse array<double>"
    )


def linucb_decide(
    contexts: DataFrame, arms: DataFrame, n_actions: int, dim: int, alpha: float = 1.0,
    broadcast_bytes: int = ARM_BROADCAST_BYTES,
) -> DataFrame:
    """Arm with the highest upper confidence bound per DISTINCT context.

    Arm parameters travel to the tasks in shards of at most ``broadcast_bytes``;
    each shard keeps its best arm per context and the shards are reduced by a
    maximum, so the catalogue size is not bounded by memory.
    """
    spark = contexts.sparkSession
    per_shard = max(1, broadcast_bytes // (8 * (dim * dim + dim)))
    best = None
    arms = durable(arms)  # fitted once, whatever the number of shards
    for first in range(0, n_actions, per_shard):
        shard = arms.filter(F.col("action").between(first, first + per_shard - 1)).orderBy("action").toPandas()
        payload = spark.sparkContext.broadcast((
            shard["action"].to_numpy(np.int64),
            np.asarray(shard["theta"].tolist(), dtype=np.float64),
            np.asarray(shard["inverse"].tolist(), dtype=np.float64),
        ))

        def score(batches: Iterator[pd.DataFrame], payload=payload) -> Iterator[pd.DataFrame]:
            actions, theta, inverse = payload.value
            for batch in batches:
                for start in range(0, len(batch), 2048):
                    piece = batch.iloc[start : start + 2048]
                    x = np.asarray(piece["context"].tolist(), dtype=np.float64)
                    outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                    ucb = x @ theta.T + alpha * np.sqrt(np.maximum(outer @ inverse.T, 0.0))
                    top = ucb.argmax(axis=1)
                    yield pd.DataFrame({
                        "context_id": piece["context_id"].to_numpy(), "action": actions[top],
                        "score": ucb[np.arange(len(x)), top],
                    })

        key_type = contexts.schema["context_id"].dataType.simpleString()
        part = contexts.select("context_id", "context").mapInPandas(
            score, f"context_id {key_type}, action long, score double"
        )
        best = part if best is None else best.unionByName(part)
    refuse_if(best is None, "no_actions", "there are no arms to choose from")
    if n_actions <= per_shard:
        return best.withColumn("prob", F.lit(1.0))
    return best.groupBy("context_id").agg(
        F.max_by(F.struct("action", "score"), F.struct(F.col("score"), -F.col("action"))).alias("p")
    ).select("context_id", "p.action", "p.score", F.lit(1.0).alias("prob"))
