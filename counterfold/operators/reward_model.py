"""Cross-fitted reward models ``q(x, a)`` held once per model input, never per round.

Squared loss over the rounds of a cell equals squared loss on the cell's mean
with the cell's weight, plus a constant.  Models are therefore fitted on
(context, fold, action) cells: the fit does not grow with repeated rounds.
"""

from __future__ import annotations

import dataclasses as dc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfold.functions.rows import one_row
from counterfold.functions.skew import lookup_join, spread_join
from counterfold.operators.moments import lists_of, moment_sums
from counterfold.session import durable

#: Pseudo-observations that pull a thin (bucket, action) mean to the action's mean.
PRIOR_WEIGHT = 10.0
#: What is added to the diagonal of a linear model's moments.
RIDGE = 1.0


@dc.dataclass(frozen=True)
class RewardModel:
    """``keys``: (context_id, fold, model_key); ``table``: (model_key, action, q)."""

    keys: DataFrame
    table: DataFrame
    label: str
    group: tuple[str, ...] = ()

    def written(self) -> RewardModel:
        return dc.replace(self, table=durable(self.table))

    def folds(self) -> DataFrame:
        """(context_id, fold) pairs that are scored, per group."""
        return self.keys.select(*self.group, "context_id", "fold")

    def q_at(self, rows: DataFrame, name: str = "q") -> DataFrame:
        """Add q to rows that carry (context_id, fold, action)."""
        on = [*self.group, "context_id", "fold"]
        return lookup_join(
            rows.join(self.keys, on), self.table.withColumnRenamed("q", name), [*self.group, "model_key", "action"]
        ).drop("model_key")

    def uniform_q(self, name: str = "eq") -> DataFrame:
        """Mean q over ALL actions per (context_id, fold)."""
        per_key = self.table.groupBy(*self.group, "model_key").agg(F.avg("q").alias(name))
        return lookup_join(self.keys, per_key, [*self.group, "model_key"], "inner").drop("model_key")


def tabular_reward_model(
    cells: DataFrame, buckets: DataFrame, n_actions: int, n_folds: int, prior: float = PRIOR_WEIGHT,
    weight: str = "n", weighted_reward: str = "r", group: tuple[str, ...] = (), in_sample: bool = False,
    pairs: DataFrame | None = None,
) -> RewardModel:
    """Shrunk mean reward by (context bucket, action), fitted outside the scored fold.

    ``cells`` has (context_id, fold, action) with a weight and a weighted reward
    sum; ``buckets`` maps context_id to a coarse ``bucket``.  The sums of the other
    folds are the totals less the fold's own, so all folds are fitted in one pass.
    """
    g = list(group)
    with_bucket = cells.join(buckets, "context_id")
    sums = with_bucket.groupBy(*g, "fold", "bucket", "action").agg(
        F.sum(weight).alias("w"), F.sum(weighted_reward).alias("s")
    )
    own = (lambda c: F.lit(0.0)) if in_sample else (lambda c: F.coalesce(F.col(c), F.lit(0.0)))

    def outside(level: list[str], prefix: str) -> DataFrame:
        """Per (fold, level): the sums over all the other folds."""
        per_fold = sums.groupBy(*g, "fold", *level).agg(
            F.sum("w").alias("ow"), F.sum("s").alias("os"))
        total = per_fold.groupBy(*g, *level).agg(F.sum("ow").alias("tw"), F.sum("os").alias("ts"))
        dense = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
        return dense.join(per_fold, [*g, "fold", *level], "left").select(
            *g, "fold", *level, (F.col("tw") - own("ow")).alias(f"{prefix}w"),
            (F.col("ts") - own("os")).alias(f"{prefix}s"),
        )

    if pairs is None:
        pairs = cells.select(*g, "context_id", "fold").distinct()
    keyed = pairs.join(buckets, "context_id").select(
        *g, "context_id", "fold", F.concat_ws("|", "fold", "bucket").alias("model_key"), "bucket"
    )
    inputs = keyed.select(*g, "fold", "bucket", "model_key").distinct()
    grid = inputs.withColumn("action", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_actions - 1).cast("long"))))
    p = F.lit(float(prior))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    overall = F.when(F.col("gw") > 0, F.col("gs") / F.col("gw")).otherwise(F.lit(0.0))
    by_action = (zero("as") + p * overall) / (zero("aw") + p)
    table = (
        grid.join(outside([], "g"), [*g, "fold"], "left")
        .join(outside(["action"], "a"), [*g, "fold", "action"], "left")
        .join(outside(["bucket", "action"], "b"), [*g, "fold", "bucket", "action"], "left")
        .select(*g, "model_key", "action",
                ((zero("bs") + p * by_action) / (zero("bw") + p)).alias("q"))
    )
    label = "in_sample_tabular" if in_sample else f"cross_fitted_tabular(k={n_folds})"
    return RewardModel(keyed.drop("bucket"), table, label, tuple(g))


def boosted_reward_model(
    cells: DataFrame, features: DataFrame, n_actions: int, n_folds: int, seed: int = 42,
    iterations: int = 100, depth: int = 5, weight: str = "n", weighted_reward: str = "r", group: tuple[str, ...] = (),
    in_sample: bool = False, pairs: DataFrame | None = None,
) -> RewardModel:
    """Boosted trees on [context, one-hot action], one fit per fold, and per group if any.

    The one-hot part is sparse.  Each context is scored once with all actions, by
    the model that never saw it.  A fold whose other folds hold no weight is scored 0.
    """
    spark = cells.sparkSession
    g = list(group)
    data = durable(cells.join(features, "context_id").select(
        *g, "context_id", "fold", F.col("action").cast("double").alias("action"),
        array_to_vector("context").alias("x"), F.col(weight).cast("double").alias("w"),
        (F.col(weighted_reward) / F.col(weight)).alias("label"),
    ).filter(F.col("w") > 0))
    encoder = OneHotEncoder(inputCol="action", outputCol="a", dropLast=False)
    # the category size comes from the declared action count, not from a fold
    encoder_model = encoder.fit(spark.range(n_actions).select(F.col("id").cast("double").alias("action")))
    assembler = VectorAssembler(inputCols=["x", "a"], outputCol="features")
    ready = assembler.transform(encoder_model.transform(data))
    if pairs is None:
        pairs = cells.select(*g, "context_id", "fold").distinct()
    groups = [tuple(r) for r in pairs.select(*g).distinct().collect()] if g else [()]  # one fit each
    scored = None
    for values in groups:
        of_group = F.lit(True)
        for name, value in zip(g, values, strict=True):
            of_group = of_group & (F.col(name) == value)
        for fold in ([0] if in_sample else range(n_folds)):
            fit_rows = ready.filter(of_group) if in_sample else ready.filter(of_group & (F.col("fold") != fold))
            mine = pairs.filter(of_group) if in_sample else pairs.filter(of_group & (F.col("fold") == fold))
            probe = mine.join(features, "context_id").select(
                *g, F.concat_ws("|", "fold", "context_id").alias("model_key"), array_to_vector("context").alias("x"),
                F.explode(F.sequence(F.lit(0), F.lit(n_actions - 1))).alias("action"),
            ).withColumn("action", F.col("action").cast("double"))
            ready_probe = assembler.transform(encoder_model.transform(probe))
            if fit_rows.isEmpty():
                part = ready_probe.withColumn("q", F.lit(0.0))
            else:
                part = GBTRegressor(
                    featuresCol="features", labelCol="label", weightCol="w", maxIter=iterations,
                    maxDepth=depth, seed=seed + fold + 1, predictionCol="q",
                ).fit(fit_rows).transform(ready_probe)
            part = part.select(*g, "model_key", F.col("action").cast("long").alias("action"), "q")
            scored = part if scored is None else scored.unionByName(part)
    keys = pairs.withColumn("model_key", F.concat_ws("|", "fold", "context_id"))
    name = "in_sample" if in_sample else f"cross_fitted(k={n_folds})"
    return RewardModel(keys, scored, f"{name}_boosted(iterations={iterations}, depth={depth})", tuple(group))


def _dot(vector: str, context: str = "context") -> Column:
    return F.aggregate(F.zip_with(vector, context, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


@dc.dataclass(frozen=True)
class LinearRewardModel:
    """One ridge regression per arm on the whole context, fitted outside each fold.

    ``q(x, a)`` = the fold's mean reward + ``theta[fold, a]`` x.  ``arms``: (fold, action,
    theta) of the arms that were logged outside the fold, others keep the mean;
    ``means``: (fold, mean, theta) with the mean parameters over ALL arms, so
    that a uniform policy needs one product per context and no table of contexts and arms.
    """

    contexts: DataFrame
    pairs: DataFrame
    arms: DataFrame
    means: DataFrame
    label: str
    group: tuple[str, ...] = ()

    def written(self) -> LinearRewardModel:
        return dc.replace(self, contexts=durable(self.contexts), arms=durable(self.arms), means=durable(self.means))

    def folds(self) -> DataFrame:
        return self.pairs

    def q_at(self, rows: DataFrame, name: str = "q") -> DataFrame:
        """Add q to rows that carry (context_id, fold, action); none where the context has no vector."""
        on = [*self.group, "fold"]
        with_x = spread_join(rows, self.contexts, ["context_id"], "inner")
        with_arm = lookup_join(with_x, self.arms, [*on, "action"])
        return lookup_join(with_arm, self.means.select(*on, "mean"), on, "inner").withColumn(
            name, F.col("mean") + F.coalesce(_dot("theta"), F.lit(0.0))).drop("context", "theta", "mean")

    def uniform_q(self, name: str = "eq") -> DataFrame:
        """Mean q over ALL actions per (context_id, fold)."""
        on = [*self.group, "fold"]
        with_x = spread_join(self.pairs, self.contexts, ["context_id"], "inner")
        return lookup_join(with_x, self.means, on, "inner").withColumn(name, F.col("mean") + _dot("theta")).drop("context", "theta", "mean")


def linear_reward_model(
    cells: DataFrame, contexts: DataFrame, n_actions: int, n_folds: int, dim: int, ridge: float = RIDGE, weight: str = "n",
    weighted_reward: str = "r", group: tuple[str, ...] = (), in_sample: bool = False, pairs: DataFrame | None = None,
) -> LinearRewardModel:
    """Ridge regression per arm on [1, context], cross-fitted by subtraction.

    ``cells`` has (context_id, fold, action) with a weight and a weighted reward sum,
    ``contexts`` (context_id, context of ``dim`` numbers).  Moments are summed once
    per (fold, arm); those outside a fold are the totals less its own, so all folds are fitted in one
    pass over the cells.  Rewards are centred on the mean of what is fitted.  Each
    arm is solved by itself, for all folds at once.
    """
    g, size = list(group), dim + 1
    one = F.array(F.lit(1.0))
    lifted = durable(contexts.select(
        "context_id", F.concat(one, F.transform("context", lambda x: x.cast("double"))).alias("context")))
    rows = spread_join(cells.select(*g, "context_id", "fold", "action", weight, weighted_reward), lifted, ["context_id"], "inner")
    sums = durable(moment_sums(rows, [*g, "fold", "action"], size, weight, weighted_reward))
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold")

    per_fold = sums.groupBy(*g, "fold").agg(F.sum("w").alias("ow"), F.sum(F.col("xs")[0]).alias("os"))
    total = per_fold.groupBy(*g).agg(F.sum("ow").alias("tw"), F.sum("os").alias("ts"))
    every = total.select("*", folds)
    own = lambda c: F.lit(0.0) if in_sample else F.coalesce(F.col(c), F.lit(0.0))
    left = F.col("tw") - own("ow")
    centre = durable(every.join(per_fold, [*g, "fold"], "left").select(
        *g, "fold", F.when(left > 0, (F.col("ts") - own("os")) / left).otherwise(0.0).alias("mean")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            thetas, kept = [], []
            columns = [batch.column(c).to_pylist() for c in ("folds", "xx", "xs", "means")]
            for row, (mine, xx, xs, means) in enumerate(zip(*columns, strict=True)):
                xx, xs = np.asarray(xx).reshape(len(mine), size, size), np.asarray(xs).reshape(len(mine), size)
                whole_xx, whole_xs = xx.sum(0), xs.sum(0)
                for m in means:
                    at = [] if in_sample else [i for i, f in enumerate(mine) if f == m["fold"]]
                    a, b = whole_xx - xx[at].sum(0), whole_xs - xs[at].sum(0)
                    if len(at) < len(mine):  # it was logged outside this fold
                        thetas.append(np.linalg.solve(a + ridge * np.eye(size), b - m["mean"] * a[0]))
                        kept.append((row, m["fold"]))
            if kept:
                at = pa.array([r for r, _ in kept])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in [*g, "action"]), pa.array([f for _, f in kept], pa.int32()), lists_of(np.stack(thetas))],
                    names=[*g, "action", "fold", "theta"])

    # an arm has at most one row per fold
    by_arm = sums.groupBy(*g, "action").agg(F.collect_list(F.struct("fold", "xx", "xs")).alias("m")).select(
        *g, "action", F.col("m.fold").alias("folds"), F.flatten("m.xx").alias("xx"), F.flatten("m.xs").alias("xs"))
    fold_means = centre.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("fold", "mean"))).alias("means"))
    by_arm = lookup_join(by_arm, fold_means, g, "inner") if g else by_arm.join(one_row(fold_means), F.lit(True))
    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    arms = durable(by_arm.mapInArrow(solve, ", ".join([*(f"`{k}` {types[k]}" for k in [*g, "action"]), "fold int, theta array<double>"])))
    summed = arms.groupBy(*g, "fold").agg(vector_to_array(Summarizer.sum(array_to_vector("theta"))).alias("theta"))
    of_all = summed.withColumn("theta", F.transform("theta", lambda t: t / n_actions))
    zero = F.array_repeat(F.lit(0.0), size)
    means = centre.withColumn("fold", F.col("fold").cast("int")).join(of_all, [*g, "fold"], "left").select(
        *g, "fold", "mean", F.coalesce("theta", zero).alias("theta"))
    if pairs is None:
        pairs = cells.select(*g, "context_id", "fold").distinct()
    name = "in_sample_linear" if in_sample else f"cross_fitted_linear(k={n_folds})"
    return LinearRewardModel(lifted, pairs, arms, means, f"{name}_ridge({ridge:g})", tuple(g))
