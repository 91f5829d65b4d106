"""Estimator identities, statuses, folds, intervals, exact values, policies."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from counterfold.errors import AnalysisRefused
from counterfold.operators import bootstrap, ope, policies, propensity, reference, reward_model, splits
from counterfold.params import EvaluationParams

TRUE_VALUES = np.array([0.1, 0.9, 0.3, 0.5])


def refused(reason):
    return pytest.raises(AnalysisRefused, match=f"^{reason}")


def make_rounds(spark, n=8000, values=TRUE_VALUES, contexts=40, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, len(values), n)
    return spark.createDataFrame(pd.DataFrame({
        "round_id": np.arange(n), "context_id": rng.integers(0, contexts, n), "action": a,
        "reward": (rng.random(n) < values[a]).astype(float), "propensity": np.full(n, 1 / len(values)),
    })).repartition(4)


def constant(spark, contexts, action, agent="a"):
    return spark.range(contexts).select(F.lit(agent).alias("agent"), F.col("id").alias("context_id"),
                                        F.lit(action).cast("long").alias("action"), F.lit(1.0).alias("prob"))


def buckets(rounds):
    return rounds.select("context_id").distinct().withColumn("bucket", F.col("context_id") % 3)


def values(df):
    return {(r["agent"], r["estimator"]): r for r in df.collect()}


@pytest.fixture(scope="module")
def rounds(spark):
    return make_rounds(spark).cache()


def test_all_estimators_find_the_known_value(spark, rounds):
    params = EvaluationParams(estimators=("ipw", "snipw", "dm", "dr", "mrdr"), n_bootstrap=20)
    out = values(ope.evaluate_policies(rounds, constant(spark, 40, 1), 4, params, ("random",), buckets(rounds)))
    for name in params.estimators:
        row = out[("a", name)]
        assert abs(row["value"] - 0.9) < 0.04, name
        assert row["ci_lower"] <= row["value"] <= row["ci_upper"] or name == "dm"
        assert row["resampling_unit"] == "round" and row["n_independent_units"] == 8000
    assert abs(out[("random", "snipw")]["value"] - TRUE_VALUES.mean()) < 0.03
    # on-policy, every weight is one: IPW is the mean reward and ESS the sample size
    mean = rounds.agg(F.avg("reward")).first()[0]
    assert out[("random", "ipw")]["value"] == pytest.approx(mean)
    assert out[("random", "ipw")]["effective_sample_size"] == pytest.approx(8000)


def test_point_estimates_equal_the_row_by_row_formula(spark, rounds):
    rng = np.random.default_rng(3)
    p = rng.random((40, 4))
    p /= p.sum(1, keepdims=True)
    long = [("mix", c, a, float(p[c, a])) for c in range(40) for a in range(4)]
    policy = spark.createDataFrame(long, "agent string, context_id long, action long, prob double")
    q = rng.random((40, 4))
    model = reward_model.RewardModel(
        spark.range(40).select(F.col("id").alias("context_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"),
                               F.col("id").cast("string").alias("model_key")),
        spark.createDataFrame([(str(c), a, float(q[c, a])) for c in range(40) for a in range(4)], "model_key string, action long, q double"), "given")
    params = EvaluationParams(estimators=("ipw", "snipw", "dm", "dr"), independent_unit="context")
    ev = ope.prepare_evaluation(rounds, policy, 4, params, model=model)
    got = {k[1]: r["value"] for k, r in values(ope.estimate(ev, params)).items()}
    d = rounds.toPandas()
    w = p[d.context_id, d.action] / d.propensity
    eq = (p * q).sum(1)[d.context_id]
    want = {"ipw": (w * d.reward).mean(), "snipw": (w * d.reward).sum() / w.sum(), "dm": eq.mean(),
            "dr": eq.mean() + (w * (d.reward - q[d.context_id, d.action])).mean()}
    assert got == pytest.approx(want)
    assert ev.unit == "context"


def test_zero_model_reduces_dr_to_ipw_and_perfect_model_to_dm(spark, rounds):
    keys = spark.range(40).select(F.col("id").alias("context_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"), F.lit("k").alias("model_key"))
    zero = reward_model.RewardModel(keys, spark.range(4).select(F.lit("k").alias("model_key"), F.col("id").alias("action"), F.lit(0.0).alias("q")), "zero")
    params = EvaluationParams(estimators=("ipw", "dm", "dr"))
    out = values(ope.estimate(ope.prepare_evaluation(rounds, constant(spark, 40, 1), 4, params, model=zero), params))
    assert out[("a", "dr")]["value"] == pytest.approx(out[("a", "ipw")]["value"]) and out[("a", "dm")]["value"] == 0
    exact = rounds.withColumn("reward", F.col("action") / 4)
    perfect = reward_model.RewardModel(keys, spark.range(4).select(F.lit("k").alias("model_key"), F.col("id").alias("action"), (F.col("id") / 4).alias("q")), "perfect")
    out = values(ope.estimate(ope.prepare_evaluation(exact, constant(spark, 40, 2), 4, params, model=perfect), params))
    assert out[("a", "dr")]["value"] == pytest.approx(0.5) == out[("a", "dm")]["value"]


def test_no_overlap_is_a_status_not_a_zero(spark):
    rounds = make_rounds(spark, 50, contexts=10).withColumn("action", F.lit(0).cast("long"))
    params = EvaluationParams(estimators=("ipw", "snipw", "dm", "dr", "mrdr"), n_bootstrap=10)
    out = values(ope.evaluate_policies(rounds, constant(spark, 10, 1), 4, params, (), buckets(rounds)))
    for name in ("ipw", "snipw", "mrdr"):
        row = out[("a", name)]
        assert row["status"] == "not_identifiable" and row["value"] is None and row["ci_lower"] is None
    assert out[("a", "mrdr")]["effective_sample_size"] is None
    assert out[("a", "dm")]["warnings"] == "no_overlap" and out[("a", "dm")]["value"] is not None
    assert out[("a", "dr")]["warnings"] == "no_overlap;dr_reduces_to_dm"
    assert out[("a", "dr")]["value"] == pytest.approx(out[("a", "dm")]["value"])


def test_interval_is_dropped_when_a_replicate_is_undefined(spark):
    rounds = make_rounds(spark, 40, contexts=20).withColumn("action", F.when(F.col("round_id") == 3, 1).otherwise(0).cast("long"))
    params = EvaluationParams(estimators=("snipw",), n_bootstrap=30)
    row = ope.evaluate_policies(rounds, constant(spark, 20, 1), 4, params).first()
    assert row["value"] is not None and row["status"] == "ok"
    assert row["ci_lower"] is None and row["warnings"] == "ci_unavailable" and row["low_ess"] is False


def test_evaluation_refusals(spark, rounds):
    pol = constant(spark, 40, 1)
    with refused("no_ground_truth"):
        ope.prepare_evaluation(rounds, pol, 4, EvaluationParams(estimators=("exact",)))
    with refused("no_reward_model"):
        ope.prepare_evaluation(rounds, pol, 4, EvaluationParams(estimators=("dr",)))
    with refused("invalid_policy"):
        ope.prepare_evaluation(rounds, pol.withColumn("prob", F.lit(0.5)), 4, EvaluationParams(estimators=("ipw",)))
    with refused("invalid_policy"):
        ope.prepare_evaluation(rounds, constant(spark, 40, 9), 4, EvaluationParams(estimators=("ipw",)))
    with refused("invalid_rounds"):
        ope.prepare_evaluation(rounds.withColumn("propensity", F.lit(0.0)), pol, 4, EvaluationParams(estimators=("ipw",)))
    with refused("no_rounds"):
        ope.prepare_evaluation(rounds.limit(0), pol, 4, EvaluationParams(estimators=("ipw",)))
    block = rounds.select(F.col("context_id").alias("user_idx"), "action", "reward").filter("action = 0").dropDuplicates(["user_idx"])
    with refused("nothing_observed"):
        ope.prepare_evaluation(rounds, pol, 4, EvaluationParams(estimators=("exact",)), block=block)


def test_exact_value_masks_and_the_two_rules_differ(spark):
    block = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 1.0)], "user_idx long, action long, reward double")
    weights = spark.createDataFrame([(0, 2), (1, 1), (2, 5)], "context_id long, n_rounds long")
    chosen = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0), (2, 0, 1.0)], "context_id long, action long, prob double")
    row = ope.exact_value(weights, ope.exact_context_values(chosen, block)).first()
    assert (row["exact_value"], row["rounds_scored"], row["rounds_masked"]) == (0.0, 2, 6)
    uniform = {r["context_id"]: r["value"] for r in ope.exact_uniform_values(block).collect()}
    spread = spark.range(3).selectExpr("id AS context_id", "explode(array(0L, 1L)) AS action", "0.5D AS prob")
    long = {r["context_id"]: r["value"] for r in ope.exact_context_values(spread, block).collect()}
    # context 1 observes one of two actions: renormalised 1.0, summed 0.5; context 2 observes none
    assert uniform == {0: 0.5, 1: 1.0} and long == {0: 0.5, 1: 0.5, 2: None}


def test_last_write_wins(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 5), (1, 0, 1.0, 9), (1, 0, 0.5, 7)], "user_idx long, action long, reward double, row_seq long")
    assert ope.last_write(rows.repartition(3)).first()["reward"] == 1.0
    assert ope.duplicate_cells(rows).first()["duplicate_rows"] == 2


def test_unit_rule(spark):
    log = make_rounds(spark, 4000)
    block = log.dropDuplicates(["context_id", "action"])
    assert ope.independent_unit(log).first()["unit"] == "round"
    assert ope.independent_unit(block).first()["unit"] == "context"
    assert ope.independent_unit(block, "round").first()["unit"] == "round"
    assert ope.independent_unit(block.withColumn("context_id", F.col("round_id")), "context").first()["unit"] == "round"
    assert ope.resolve_unit(160, 160, 40) == "context" and ope.resolve_unit(400, 160, 40) == "round"


def test_cluster_interval_is_wider_when_rounds_repeat_a_context(spark):
    rng = np.random.default_rng(5)
    level = rng.normal(size=60)
    rows = spark.createDataFrame(
        [("a", f"{c}|{j}", c, 1.0, float(level[c])) for c in range(60) for j in range(40)],
        "agent string, unit_id string, c long, w double, wr double")
    per_context = rows.groupBy("agent", F.col("c").cast("string").alias("unit_id")).agg(F.sum("w").alias("w"), F.sum("wr").alias("wr"))
    width = []
    for frame in (rows, per_context):
        reps, _, _ = bootstrap.replicate_sums(frame, ["w", "wr"], 100, 1)
        r = bootstrap.percentile_interval(reps, F.col("wr") / F.col("w"), 0.95).first()
        width.append(r["ci_upper"] - r["ci_lower"])
        assert r["ci_lower"] < level.mean() < r["ci_upper"] or frame is rows
    assert 4 < width[1] / width[0] < 9  # about sqrt(40)


def test_poisson_and_drawn_intervals_agree(spark):
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame(pd.DataFrame({
        "agent": "a", "unit_id": [str(i) for i in range(3000)], "w": 1.0, "wr": rng.random(3000)})).repartition(4)
    ends = []
    for method in bootstrap.METHODS:
        reps, method, n = bootstrap.replicate_sums(frame, ["w", "wr"], 300, 2, method=method)
        r = bootstrap.percentile_interval(reps, F.col("wr") / F.col("w"), 0.9).first()
        ends.append((r["ci_lower"], r["ci_upper"]))
        assert n == 3000 and reps.count() == 300
    assert method == "percentile_poisson"
    assert np.allclose(ends[0], ends[1], atol=0.004)
    again, _, _ = bootstrap.replicate_sums(frame.repartition(7), ["w", "wr"], 300, 2, method="percentile_poisson")
    one = bootstrap.replicate_sums(frame, ["w", "wr"], 300, 2, method="percentile_poisson")[0]
    a, b = [x.orderBy("rep").toPandas()["wr"].to_numpy() for x in (again, one)]
    assert np.allclose(a, b)


@pytest.mark.parametrize("method", bootstrap.METHODS)
def test_alike_units_may_share_a_row(spark, method):
    """400 rows of 10 units each resample like 4000 units."""
    rng = np.random.default_rng(11)
    x = rng.random(400)
    rows = spark.createDataFrame(pd.DataFrame({"agent": "a", "unit_id": [str(i) for i in range(400)], "w": 10.0, "wr": 10 * x, "mult": 10}))
    reps, _, n = bootstrap.replicate_sums(rows, ["w", "wr"], 300, 2, method=method)
    got = reps.toPandas()
    assert n == 4000
    if method == "percentile":
        assert (got["w"].round(6) == 4000).all()
    want = np.sqrt((x**2).mean() - x.mean() ** 2) / np.sqrt(4000)
    assert (got.wr / got.w).std() == pytest.approx(want, rel=0.2) and (got.wr / got.w).mean() == pytest.approx(x.mean(), abs=4 * want)


def test_drawn_replicates_have_exactly_n_units(spark):
    frame = spark.range(500).select(F.lit("a").alias("agent"), F.col("id").cast("string").alias("unit_id"), F.lit(1.0).alias("n"))
    reps, _, _ = bootstrap.replicate_sums(frame, ["n"], 25, 4)
    assert {r["n"] for r in reps.collect()} == {500.0}


def test_cross_fitting_by_context_does_not_leak(spark):
    """A context's reward level is unpredictable, so an honest q cannot follow it."""
    rng = np.random.default_rng(7)
    level = rng.uniform(0.05, 0.95, 60)
    rows = [(i, c, int(rng.integers(0, 4)), float(rng.random() < level[c]), 0.25) for i, c in enumerate(np.repeat(np.arange(60), 25).tolist())]
    rounds = spark.createDataFrame(rows, "round_id long, context_id long, action long, reward double, propensity double")
    feats = spark.createDataFrame([(c, rng.normal(size=4).tolist()) for c in range(60)], "context_id long, context array<double>")
    corr = {}
    for unit in ("context", "round"):
        key = "context_id" if unit == "context" else "round_id"
        source = rounds.select("context_id").distinct() if unit == "context" else rounds
        folds = splits.context_folds(source, 3, 1, key)
        folded = rounds.join(folds, "context_id") if unit == "context" else folds
        model = reward_model.boosted_reward_model(ope.logged_cells(folded), feats, 4, 3, iterations=15, depth=5)
        eq = model.uniform_q().groupBy("context_id").agg(F.avg("eq").alias("eq")).orderBy("context_id").toPandas()
        corr[unit] = np.corrcoef(eq["eq"], level)[0, 1]
    assert corr["round"] > 0.5 and abs(corr["context"]) < 0.35


def test_tabular_model_ignores_its_own_fold(spark):
    rounds = make_rounds(spark, 600, contexts=30)
    folds = splits.context_folds(rounds.select("context_id").distinct(), 3, 1)
    folded = rounds.join(folds, "context_id")
    base = reward_model.tabular_reward_model(ope.logged_cells(folded), buckets(rounds), 4, 3)
    spoiled = folded.withColumn("reward", F.when(F.col("fold") == 1, 100.0).otherwise(F.col("reward")))
    other = reward_model.tabular_reward_model(ope.logged_cells(spoiled), buckets(rounds), 4, 3)
    both = base.table.join(other.table.withColumnRenamed("q", "q2"), ["model_key", "action"])
    moved = {r["f"] for r in both.filter(F.abs(F.col("q") - F.col("q2")) > 1e-9).select(F.substring("model_key", 1, 1).alias("f")).distinct().collect()}
    assert moved == {"0", "2"}
    assert base.table.count() == 3 * 3 * 4


# ------------------------------------------------------------------ policies


def test_linucb_finds_the_linear_oracle_and_adds_up(spark):
    rng = np.random.default_rng(8)
    w = rng.normal(size=(4, 6))
    x = rng.normal(size=(1500, 6))
    a = rng.integers(0, 4, 1500)
    r = (x * w[a]).sum(1) + 0.1 * rng.normal(size=1500)
    df = spark.createDataFrame([(i, int(a[i]), float(r[i]), x[i].tolist()) for i in range(1500)], "context_id long, action long, reward double, context array<double>")
    whole = policies.linucb_statistics(df.repartition(4), 6)
    half = policies.merge_linucb(policies.linucb_statistics(df.filter("context_id < 700"), 6).unionByName(policies.linucb_statistics(df.filter("context_id >= 700"), 6)))
    for p, q in zip(whole.orderBy("action").collect(), half.orderBy("action").collect(), strict=True):
        assert p["n"] == q["n"] and np.allclose(p["xx"], q["xx"]) and np.allclose(p["xr"], q["xr"])
    arms = policies.linucb_arms(whole, 5, 6)
    best = policies.linucb_decide(df, arms.filter("action < 4"), 4, 6, alpha=0.1).toPandas().set_index("context_id")["action"]
    assert (best.sort_index().to_numpy() == (x @ w.T).argmax(1)).mean() > 0.95
    # one arm per shard gives the same decisions; arm 4 was never seen and keeps its prior
    one = policies.linucb_decide(df, arms, 5, 6, 1.0).orderBy("context_id").select("action").collect()
    sharded = policies.linucb_decide(df, arms, 5, 6, 1.0, broadcast_bytes=1).orderBy("context_id").select("action").collect()
    assert one == sharded
    with pytest.raises(Exception, match="expected 7"):
        policies.linucb_statistics(df, 7).collect()


def test_policies_are_distributions_with_low_action_ties(spark):
    rounds = make_rounds(spark, 500, contexts=12)
    aw = policies.advantage_weighted(rounds).groupBy("context_id").agg(F.sum("prob").alias("p")).toPandas()
    assert np.allclose(aw["p"], 1.0) and len(aw) == 12
    flat = rounds.withColumn("reward", F.lit(1.0))
    low = flat.groupBy("context_id").agg(F.min("action").alias("a"))
    assert policies.greedy_mean(flat).join(low, "context_id").filter("action <> a").count() == 0
    users = rounds.withColumn("user_idx", F.col("context_id"))
    behaviour = propensity.fit_behaviour_policy(users, 4)
    assert policies.greedy_supported(rounds, behaviour, 2.0).orderBy("context_id").collect() == \
        policies.greedy_mean(rounds).orderBy("context_id").collect()


def test_expectile_solves_its_equation(spark):
    rounds = make_rounds(spark, 3000, contexts=5)
    out = policies.advantage_weighted(rounds).join(policies.action_values(rounds).select("context_id", "action", "n"), ["context_id", "action"]).toPandas()
    for _, g in out.groupby("context_id"):
        d = g["q"] - g["v"]
        assert abs((np.where(d > 0, 0.7, 0.3) * g["n"] * d).sum()) < 1e-6


def test_popularity_falls_back_when_nothing_is_frequent(spark):
    rows = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 1.0)], "action long, reward double")
    got = {r["rule"]: r["action"] for r in policies.popularity_constants(rows).collect()}
    assert got == {"most_interactions": 0, "highest_logged_reward_rate": 1}
    frequent = {r["rule"]: r["action"] for r in policies.popularity_constants(rows, 2).collect()}
    assert frequent["highest_logged_reward_rate"] == 0


# ------------------------------------------------------------------ reference policies


@pytest.fixture(scope="module")
def holed_block(spark):
    rng = np.random.default_rng(9)
    full = rng.random((9, 24))
    seen = rng.random((9, 24)) > 0.25
    seen[8] = False
    rows = [(u, a, float(full[u, a])) for u in range(9) for a in range(24) if seen[u, a]]
    block = spark.createDataFrame(rows, "user_idx long, action long, reward double")
    weights = spark.createDataFrame([(u, int(10 + u)) for u in range(9)], "context_id long, n_rounds long")
    return full, seen, np.arange(10, 19), block, weights


def test_references_equal_masked_numpy(spark, holed_block):
    full, seen, w, block, weights = holed_block
    masked = np.ma.array(full, mask=~seen)
    best = masked.max(axis=1)
    row = reference.oracle_value(block, weights).first()
    assert row["value"] == pytest.approx(np.ma.average(best, weights=w)) and row["rounds_masked"] == 18
    got = reference.constant_values(block, weights).orderBy("action").toPandas()["value"]
    want = [np.average(full[seen[:, a], a], weights=w[seen[:, a]]) for a in range(24)]
    assert np.allclose(got, want)
    ranks = reference.constant_ranks(reference.constant_values(block, weights)).orderBy("action").toPandas()["constant_rank"]
    assert ranks.tolist() == [1 + sum(v > want[a] for v in want) for a in range(24)]


def test_personalisation_test_reads_matching(spark):
    n = 60
    block = spark.range(n).selectExpr("id AS user_idx", "explode(sequence(0L, 3L)) AS action").withColumn(
        "reward", (F.col("user_idx") % 4 == F.col("action")).cast("double"))
    weights = spark.range(n).select(F.col("id").alias("context_id"), F.lit(3).alias("n_rounds"))
    matched = spark.range(n).select(F.col("id").alias("context_id"), (F.col("id") % 4).alias("action"))
    row = reference.personalisation_test(matched, block, weights, 50).first()
    assert row["realised"] == 1.0 and abs(row["shuffled_mean"] - 0.25) < 0.05
    assert row["p_value"] == pytest.approx(1 / 51) and row["z_score"] > 5
    collapsed = matched.withColumn("action", F.lit(1).cast("long"))
    row = reference.personalisation_test(collapsed, block, weights, 20).first()
    assert row["p_value"] == 1.0 and row["shuffled_std"] == 0.0 and row["z_score"] is None


def test_concentration_and_baseline(spark, holed_block):
    *_, block, weights = holed_block
    one = spark.range(9).select(F.col("id").alias("context_id"), F.lit(3).cast("long").alias("action"))
    row = reference.concentration(one, weights, 24).first()
    assert row["collapsed"] and row["entropy_nats"] == pytest.approx(0) and row["max_entropy_nats"] == pytest.approx(np.log(24))
    values = spark.createDataFrame([(0, 0.9), (1, 0.7), (2, 0.8), (3, 0.1), (4, 0.5)], "action long, value double")
    features = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)], "action long, item_feature double")
    base = {r["action"]: r["baseline"] for r in reference.feature_baseline(features, values).collect()}
    assert base[0] == 0.9 and base[1] == base[2] == pytest.approx(0.75) and base[3] == 0.1
    assert base[4] == pytest.approx(0.75)  # no feature: read at the median
    rho = reference.feature_confound(features, values).first()
    assert rho["n_items"] == 4 and rho["spearman_rho"] == pytest.approx(-0.8)
