"""Linear and boosted reward models in the estimators, folds of alike rounds, named units, draws and bijections."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from counterfold.errors import AnalysisRefused
from counterfold.functions.skew import fits_broadcast
from counterfold.functions.statistics import two_sided_p
from counterfold.operators import bootstrap, ope, reference, reward_model, splits
from counterfold.params import EvaluationParams
from counterfold.plans.catalog import all_queries

DIM, ARMS, FOLDS = 6, 4, 5


@pytest.fixture(scope="module")
def linear_log(spark):
    """A log whose rewards are linear in the context, arm 3 never being played."""
    rng = np.random.default_rng(2)
    x, theta = rng.normal(size=(60, DIM)), rng.normal(size=(ARMS, DIM))
    c, a = rng.integers(0, 60, 5000), rng.integers(0, ARMS - 1, 5000)
    r = (x[c] * theta[a]).sum(1) + 0.5 * a + 0.1 * rng.normal(size=5000)
    frame = pd.DataFrame({"round_id": np.arange(5000), "context_id": c, "action": a, "reward": r, "propensity": 1 / 3})
    contexts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "context_id long, context array<double>")
    return x, theta, frame, spark.createDataFrame(frame).repartition(5), contexts


def fit_by_hand(x, frame, fold, ridge, in_sample=False):
    """theta per (fold, arm) and the fold's mean, by normal equations on the rounds outside the fold."""
    out, means = {}, {}
    lifted = np.hstack([np.ones((len(x), 1)), x])
    for f in range(FOLDS):
        fit = np.ones(len(frame), bool) if in_sample else (fold != f)
        means[f] = frame.reward[fit].mean()
        for a in range(ARMS):
            rows = fit & (frame.action == a)
            if rows.any():
                z = lifted[frame.context_id[rows]]
                out[f, a] = np.linalg.solve(z.T @ z + ridge * np.eye(DIM + 1), z.T @ (frame.reward[rows] - means[f]))
    return out, means, lifted


def test_linear_model_equals_normal_equations(spark, linear_log):
    x, _, frame, rounds, contexts = linear_log
    folded = splits.context_folds(rounds, FOLDS, 1, "round_id")
    fold = folded.orderBy("round_id").toPandas()["fold"].to_numpy()
    thetas, means, lifted = fit_by_hand(x, frame, fold, 2.0)
    model = reward_model.linear_reward_model(ope.logged_cells(folded), contexts, ARMS, FOLDS, DIM, ridge=2.0).written()
    got = {(r.fold, r.action): np.array(r.theta) for r in model.arms.collect()}
    assert set(got) == set(thetas) and all(np.allclose(got[k], thetas[k]) for k in got)
    probe = spark.range(
        60 * FOLDS * ARMS).selectExpr("id % 60 AS context_id", f"CAST(id DIV 60 % {FOLDS} AS INT) AS fold", f"id DIV {60 * FOLDS} AS action")
    for r in model.q_at(probe).collect():
        want = means[r.fold] + (lifted[r.context_id] @ thetas[r.fold, r.action] if (r.fold, r.action) in thetas else 0.0)
        assert r.q == pytest.approx(want, abs=1e-9)
    for r in model.uniform_q().collect():
        each = [means[r.fold] + (lifted[r.context_id] @ thetas[r.fold, a] if (r.fold, a) in thetas else 0.0) for a in range(ARMS)]
        assert r.eq == pytest.approx(np.mean(each), abs=1e-9)


def test_linear_model_in_sample_and_without_its_fold(spark, linear_log):
    x, _, frame, rounds, contexts = linear_log
    folded = splits.context_folds(rounds, FOLDS, 1, "round_id")
    one = ope.logged_cells(folded.withColumn("fold", F.lit(0)))
    thetas, _, _ = fit_by_hand(x, frame, None, 1.0, in_sample=True)
    model = reward_model.linear_reward_model(one, contexts, ARMS, 1, DIM, in_sample=True)
    assert all(np.allclose(r.theta, thetas[0, r.action]) for r in model.arms.collect())
    spoiled = folded.withColumn("reward", F.when(F.col("fold") == 1, 100.0).otherwise(F.col("reward")))
    a, b = [{(r.fold, r.action): r.theta for r in reward_model.linear_reward_model(
        ope.logged_cells(d), contexts, ARMS, FOLDS, DIM).arms.collect()} for d in (folded, spoiled)]
    assert {f for (f, _), t in a.items() if np.allclose(t, b[f, _])} == {1}


@pytest.mark.parametrize("unit", ["round", "context"])
def test_estimators_on_the_linear_model_find_the_truth(spark, linear_log, unit):
    x, theta, frame, rounds, contexts = linear_log
    best = spark.range(60).select(F.lit("two").alias("agent"), F.col("id").alias("context_id"), F.lit(2).cast("long").alias("action"), F.lit(1.0).alias("prob"))
    truth = ((x @ theta[2]) + 1.0)[frame.context_id].mean()
    params = EvaluationParams(estimators=("dm", "dr", "mrdr", "ipw"), n_bootstrap=20, independent_unit=unit)
    out = {r.estimator: r for r in ope.evaluate_policies(rounds, best, ARMS, params, contexts=contexts).collect()}
    for name in ("dm", "dr", "mrdr"):
        assert out[name].value == pytest.approx(truth, abs=0.05), name
        assert out[name].ci_lower <= out[name].value <= out[name].ci_upper
        assert out[name].q_model == "cross_fitted_linear(k=5)_ridge(1)" and out[name].resampling_unit == unit


def test_boosted_model_reaches_all_estimators(spark, linear_log):
    x, theta, frame, rounds, contexts = linear_log
    policy = spark.range(60).select(F.lit("two").alias("agent"), F.col("id").alias("context_id"), F.lit(2).cast("long").alias("action"), F.lit(1.0).alias("prob"))
    fit = lambda cells, **kw: reward_model.boosted_reward_model(cells, contexts, ARMS, 2, iterations=100, depth=3, **kw)
    params = EvaluationParams(estimators=("dm", "dr", "mrdr"), n_bootstrap=10, folds=2)
    ev = ope.prepare_evaluation(rounds, policy, ARMS, params, fit=fit)
    truth = ((x @ theta[2]) + 1.0)[frame.context_id].mean()
    for r in ope.estimate(ev, params).collect():
        assert r.value == pytest.approx(truth, abs=0.25), r.estimator
    assert ev.q_label == "cross_fitted(k=2)_boosted(iterations=100, depth=3)"


# ------------------------------------------------------------------ folds of alike rounds


def test_rounds_are_dealt_evenly(spark):
    rows = [("a", f"k{i}", n) for i, n in enumerate([1, 1, 7, 100, 3, 13, 2])] + [("b", "k1", 4), ("b", "k9", 1)]
    out = splits.deal_rounds(spark.createDataFrame(rows, "agent string, round_id string, n long").repartition(3), FOLDS, 3, group=("agent",)).toPandas()
    for agent, total in (("a", 127), ("b", 5)):
        per_fold = out[out.agent == agent].groupby("fold").n.sum()
        assert per_fold.sum() == total and per_fold.max() - per_fold.min() <= 1
    per_row = out.groupby(["agent", "round_id"]).n.agg(["sum", "max", "min", "count"])
    assert {k: v["sum"] for k, v in per_row.iterrows()} == {(a, k): n for a, k, n in rows}
    assert all(v["max"] - (v["min"] if v["count"] == FOLDS else 0) <= 1 for _, v in per_row.iterrows())


def test_alike_rounds_evaluate_like_rounds_kept_apart(spark):
    """All rounds of a cell are alike here, yet every fold gets its share of them."""
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"round_id": np.arange(900), "context_id": rng.integers(0, 3, 900), "action": rng.integers(0, 2, 900)})
    frame["reward"], frame["propensity"] = (frame.action == frame.context_id % 2).astype(float), 0.5
    contexts = spark.createDataFrame([(i, [float(i == k) for k in range(3)]) for i in range(3)], "context_id long, context array<double>")
    policy = spark.range(3).select(F.lit("a").alias("agent"), F.col("id").alias("context_id"), F.lit(1).cast("long").alias("action"), F.lit(1.0).alias("prob"))
    params = EvaluationParams(estimators=("mrdr", "ipw"), independent_unit="round")
    ev = ope.prepare_evaluation(spark.createDataFrame(frame), policy, 2, params, contexts=contexts)
    sizes = ev.unit_stats.filter("m_rounds > 0").groupBy(F.substring_index("unit_id", "|", -1).alias("f")).agg(F.sum("n").alias("n")).toPandas()["n"]
    assert len(sizes) == FOLDS and sizes.max() - sizes.min() <= 1
    assert ev.unit_stats.agg(F.sum("n"), F.sum("mult")).first()[:] == (900.0, 900)
    got = {r.estimator: r.value for r in ope.estimate(ev, params).collect()}
    assert got["ipw"] == pytest.approx((frame.reward * (frame.action == 1) / 0.5).mean())
    assert got["mrdr"] == pytest.approx((frame.context_id == 1).mean(), abs=0.02)


@pytest.mark.parametrize(("supported", "ok"), [(4, False), (5, True)])
def test_mrdr_needs_as_many_supported_rounds_as_folds(spark, supported, ok):
    """One kind of round is enough, if there are enough of them."""
    rows = [(i, i % 7, 1 if i < supported else 0, 1.0, 0.5) for i in range(70)]
    rows = [(i, 0 if a else c, a, r, p) for i, c, a, r, p in rows]
    rounds = spark.createDataFrame(rows, "round_id long, context_id long, action long, reward double, propensity double")
    policy = spark.range(7).select(F.lit("a").alias("agent"), F.col("id").alias("context_id"), F.lit(1).cast("long").alias("action"), F.lit(1.0).alias("prob"))
    contexts = spark.range(7).select(F.col("id").alias("context_id"), F.array(F.col("id").cast("double")).alias("context"))
    for unit, fine in (("round", ok), ("context", False)):  # all of them are of one context
        params = EvaluationParams(estimators=("mrdr",), independent_unit=unit)
        row = ope.estimate(ope.prepare_evaluation(rounds, policy, 2, params, contexts=contexts), params).first()
        assert (row.status == "ok") is fine
        if not fine:
            assert row.detail == (f"only {supported} supported rounds" if unit == "round" else "only 1 supported contexts") + " of this agent for 5 folds"


# ------------------------------------------------------------------ named units


def test_a_named_unit_carries_all_its_rounds(spark):
    rng = np.random.default_rng(5)
    level = rng.random(50)
    frame = pd.DataFrame({"round_id": np.arange(4000), "user": np.arange(4000) % 50, "context_id": rng.integers(0, 30, 4000), "action": 0, "propensity": 1.0})
    frame["reward"] = level[frame.user]
    rounds = spark.createDataFrame(frame)
    width = {}
    for unit in (None, "user"):
        params = EvaluationParams(estimators=("snipw",), n_bootstrap=200)
        row = ope.evaluate_policies(rounds, None, 1, params, uniform=("u",), unit_column=unit).first()
        width[unit] = row.ci_upper - row.ci_lower
        assert row.value == pytest.approx(frame.reward.mean())
        assert (row.resampling_unit, row.n_independent_units) == (("user", 50) if unit else ("round", 4000))
    assert 5 < width["user"] / width[None] < 14  # about sqrt(80)
    contexts = spark.range(30).select(F.col("id").alias("context_id"), F.array(F.col("id").cast("double")).alias("context"))
    params = EvaluationParams(estimators=("dm", "dr", "mrdr"), n_bootstrap=10)
    both = ope.evaluate_policies(rounds.withColumn("propensity", F.lit(0.999)), None, 1, params, uniform=("u",), contexts=contexts, unit_column="user").collect()
    assert all(r.value == pytest.approx(frame.reward.mean(), abs=0.05) and r.n_independent_units == 50 for r in both)
    with pytest.raises(AnalysisRefused, match="^missing_unit"):
        ope.prepare_evaluation(rounds, None, 1, EvaluationParams(estimators=("ipw",)), uniform=("u",), unit_column="nobody")


# ------------------------------------------------------------------ draws


def test_tree_of_draws_is_a_multinomial(spark, monkeypatch):
    """Counts per unit: n in all, mean and variance of a multinomial, and no dependence on the layout."""
    monkeypatch.setattr(bootstrap, "LEAF_ROWS", 7)
    monkeypatch.setattr(bootstrap, "_PIECE", 3)
    mult = np.array([1, 1, 2, 5, 1, 30, 1, 1, 8] * 5)
    rows = [(f"u{i}", int(m), *[float(m) * (i == k) for k in range(6)]) for i, m in enumerate(mult)]
    cols = [f"x{k}" for k in range(6)]
    frame = spark.createDataFrame(rows, "unit_id string, mult long, " + ", ".join(f"{c} double" for c in cols)).withColumns(
        {"agent": F.lit("a"), "n": F.col("mult").cast("double")})
    reps, method, n = bootstrap.replicate_sums(frame, ["n", *cols], 4000, 9)
    got = reps.orderBy("rep").toPandas()
    assert method == "percentile" and n == mult.sum() and np.allclose(got.n, n) and len(got) == 4000
    p = mult[:6] / n
    counts = got[cols].to_numpy()
    assert np.allclose(counts.mean(0), n * p, atol=5 * np.sqrt(n * p / 4000))
    assert np.allclose(counts.var(0), n * p * (1 - p), rtol=0.15)
    assert np.cov(counts[:, 3], counts[:, 5])[0, 1] == pytest.approx(-n * p[3] * p[5], abs=0.5)
    again = bootstrap.replicate_sums(frame.repartition(3), ["n", *cols], 4000, 9)[0].orderBy("rep").toPandas()
    assert np.allclose(again[cols], counts)


def test_groups_draw_their_own_units(spark):
    rows = [("a", f"u{i}", 1.0, float(i)) for i in range(40)] + [("b", f"u{i}", 1.0, float(i)) for i in range(40)] + [("c", "only", 1.0, 5.0)]
    reps = bootstrap.replicate_sums(spark.createDataFrame(rows, "agent string, unit_id string, n double, v double"), ["n", "v"], 20, 1)[0].toPandas()
    assert (reps.groupby("agent").n.agg(["min", "max"]).to_numpy() == [[40, 40], [40, 40], [1, 1]]).all()
    a, b = (reps[reps.agent == g].sort_values("rep").v.to_numpy() for g in "ab")
    assert (a == b).all() and (reps[reps.agent == "c"].v == 5).all()  # same units, same draws


@pytest.mark.parametrize("leaf_rows", [50_000, 7])
def test_sql_repeats_the_draws(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(bootstrap, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(bootstrap, "_PIECE", 50)
    units = [(f"u{i}", m, float(i * m)) for i, m in enumerate([1, 1, 2, 5, 1, 30, 1, 1, 8] * 5)]
    frame = spark.createDataFrame([("a", *u) for u in units], "agent string, unit_id string, mult long, v double")
    got = bootstrap.replicate_sums(frame, ["v"], 20, 9)[0].orderBy("rep").toPandas()["v"]
    values = ", ".join(f"('{u}', {m}, {v / m})" for u, m, v in units)
    want = duckdb.sql(f"""WITH ur AS (SELECT * FROM (VALUES {values}) t(unit, m, v)),
      un AS (SELECT unit, v || '|' || k AS id, v FROM (SELECT *, unnest(range(m)) AS k FROM ur)), {bootstrap.drawn_sql(9, 20)}
      SELECT rep, sum(v) AS v FROM dr JOIN un USING (id) GROUP BY rep ORDER BY rep""").df()["v"]
    assert len(got) == 20 and np.allclose(got, want)


@pytest.mark.parametrize("name", ["bootstrap_over_rounds", "bootstrap_over_contexts"])
def test_intervals_are_results(spark, sf_dir, name):
    """Both sides draw: the SQL has no constant in place of a replicate, and the ends are returned."""
    query = all_queries()[name]
    assert "true AS" not in query.sql and "100::BIGINT AS n_replicates" not in query.sql
    for r in query.run(spark, sf_dir).collect():
        assert r.ci_lower < r.centre < r.ci_upper and r.n_replicates == 100 and r.spread > 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 100, 257])
def test_keyed_bijection(spark, n):
    keys = [reference.bijection_keys(1, r) for r in range(n, n + 2)]
    got = [r[0] for r in spark.range(n).select("id", reference.keyed_bijection(F.col("id"), F.lit(1), n, keys).alias("to")).orderBy("id").select("to").collect()]
    assert sorted(got) == list(range(n))
    assert n < 100 or sum(a == b for a, b in enumerate(got)) < 8


@pytest.mark.parametrize("n", [20, 50, 1500])
def test_bijections_spread_like_permutations(n):
    reps = 400
    at = np.stack([reference.permuted(np.arange(n), np.tile(reference.bijection_keys(7, r), (n, 1)), n) for r in range(reps)])
    if n < 100:
        hits = np.zeros((n, n))
        for row in at:
            hits[np.arange(n), row] += 1
        chi = ((hits - reps / n) ** 2 / (reps / n)).sum()
        assert abs(chi - (n - 1) ** 2) < 6 * np.sqrt(2 * (n - 1) ** 2)
    # the sum over matched pairs has the variance of a random permutation
    v = np.arange(n) - (n - 1) / 2
    assert (v[at] @ v).var() == pytest.approx((v @ v) ** 2 / (n - 1), rel=0.3)


# ------------------------------------------------------------------ small things


def test_two_sided_p(spark):
    # fixed values: two-sided chances of Student's t
    known = [(12.706205, 1, 0.05), (4.302653, 2, 0.05), (3.182446, 3, 0.05), (2.776445, 4, 0.05), (2.228139, 10, 0.05), (1.98118, 113, 0.05), (0.0, 7, 1.0), (-2.228139, 10, 0.05)]
    frame = spark.createDataFrame([(t, n, p) for t, n, p in known] + [(1.0, 0, None)], "t double, df long, p double")
    for r in frame.select("p", two_sided_p(F.col("t"), F.col("df")).alias("got")).collect():
        assert (r.got is None and r.p is None) or r.got == pytest.approx(r.p, abs=1e-6)


def test_lookups_are_broadcast_by_bytes(spark):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 10_000).alias("t"), F.array_repeat(F.lit(1.0), 100).alias("v"))
    assert fits_broadcast(wide, 1_200_000) and not fits_broadcast(wide, 1_000_000) and fits_broadcast(wide.limit(0), 1)
