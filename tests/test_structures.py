"""Graphs, treatment effects, comparison tables and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from counterfold.errors import AnalysisRefused
from counterfold.operators import graph, policies, rollup, uplift
from counterfold.sources import results
from counterfold.streaming.incremental import StoredState, linucb_sink, linucb_state, running_estimates, vocabulary_sink


def refused(reason):
    return pytest.raises(AnalysisRefused, match=f"^{reason}")


# ------------------------------------------------------------------ graph

U, I, D = 12, 20, 5


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    pairs = spark.createDataFrame([(int(u), int(i)) for u, i in zip(rng.integers(0, U, 80), rng.integers(0, I - 1, 80))], "user_idx long, item_idx long")
    edges = graph.bipartite_graph(pairs, U, I).cache()
    h = rng.normal(size=(U + I, D))
    vectors = spark.createDataFrame([(n, h[n].tolist()) for n in range(U + I)], "node_id long, embedding array<double>").cache()
    a = np.zeros((U + I, U + I))
    for s, d in edges.collect():
        a[s, d] = 1
    return edges, vectors, a, h


def dense(df):
    return np.array(df.orderBy("node_id").toPandas()["embedding"].tolist())


def norm(a):
    d = np.maximum(a.sum(1), 1)
    return a / np.sqrt(np.outer(d, d))


def test_graph_is_symmetric_and_without_duplicates(small):
    edges, _, a, _ = small
    assert (a == a.T).all() and a.sum() == edges.count()


def test_propagation_equals_dense_algebra(spark, small):
    edges, vectors, a, h = small
    n = norm(a)
    assert np.allclose(dense(graph.light_propagation(edges, vectors, 3)), (h + n @ h + n @ n @ h + n @ n @ n @ h) / 4)
    deg = np.maximum(a.sum(1, keepdims=True), 1)
    assert np.allclose(dense(graph.neighbour_mean(edges, vectors)), a @ h / deg)
    loops = a + np.eye(U + I)
    assert np.allclose(dense(graph.convolution(edges, graph.nodes(spark, U, I), vectors)), norm(loops) @ h)
    s = n @ h
    y = h + s + s * h
    y = np.where(y < 0, 0.2 * y, y)
    assert np.allclose(dense(graph.interaction_messages(edges, vectors)), y / np.linalg.norm(y, axis=1, keepdims=True))
    weights = [0.5, 0.5, 0.0]
    assert np.allclose(dense(graph.light_propagation(edges, vectors, 2, weights)), (h + n @ h) / 2)
    with refused("layer_weights"):
        graph.light_propagation(edges, vectors, 2, [1.0])


def plan(df):
    return df._jdf.queryExecution().toString()


def test_shared_vectors_equal_rows_of_their_own(spark, small):
    edges, _, a, _ = small
    e = np.random.default_rng(2).normal(size=(7, D))
    table = spark.createDataFrame([(k, e[k].tolist()) for k in range(7)], "v long, embedding array<double>")
    shared = graph.SharedFeatures(graph.nodes(spark, U, I).select("node_id", (F.col("node_id") % 7).alias("v")), table)
    h, deg = e[np.arange(U + I) % 7], a.sum(1, keepdims=True)
    want = {"sum": a @ h, "mean": a @ h / np.maximum(deg, 1), "symmetric": norm(a) @ h}
    for kind, x in want.items():
        for features in (shared, shared.rows()):
            assert np.allclose(dense(graph.aggregate_neighbours(edges, features, kind, isolated=True)), x)
            assert np.allclose(dense(graph.aggregate_neighbours(edges, features, kind)), x[deg[:, 0] > 0])
    assert np.allclose(dense(graph.interaction_messages(edges, shared)), dense(graph.interaction_messages(edges, shared.rows())))


def test_sums_over_slices_batches_and_blocks(spark, small, monkeypatch):
    """A hub's edges span several batches, blocks hold one node or all, and a node without a vector counts as a neighbour."""
    edges, vectors, a, h = small
    hub = spark.range(U, U + I).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    edges = graph.undirected(edges.unionByName(hub))
    a = np.maximum(a, 0)
    a[0, U:], a[U:, 0] = 1, 1
    shared = graph.SharedFeatures(vectors.select("node_id", F.col("node_id").alias("v")), vectors.withColumnRenamed("node_id", "v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert np.allclose(dense(graph.aggregate_neighbours(edges, shared, "symmetric", isolated=True)), norm(a) @ h)
        for size in (1, 8 * D * (U + I)):
            monkeypatch.setattr(graph, "BLOCK_BYTES", size)
            assert np.allclose(dense(graph.light_propagation(edges, vectors, 1, [0.0, 1.0])), norm(a) @ h)
        without = h.copy()
        without[-1] = 0
        some = vectors.where(F.col("node_id") < U + I - 1)
        for features in (some, graph.SharedFeatures(shared.nodes, some.withColumnRenamed("node_id", "v"))):
            assert np.allclose(dense(graph.aggregate_neighbours(edges, features, "symmetric", isolated=True)), (norm(a) @ without)[:-1])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_both_directions_of_pairs_are_not_shuffled(spark):
    pairs = spark.createDataFrame([(0, 5), (0, 5), (1, 5), (None, None), (1, None)], "user_idx long, item_idx long")
    edges = graph.bipartite_graph(pairs, 2, 6)
    assert "Exchange" not in plan(edges)
    assert sorted(edges.collect(), key=str) == sorted(
        [(0, 7), (7, 0), (1, 7), (7, 1), (None, None), (1, None), (None, 1)], key=str)


def test_vectors_are_never_broadcast_by_their_planned_size(spark):
    nodes = graph.nodes(spark, 3000, 3000)
    vectors = graph.seeded_features(nodes, 64, 1)
    triples = spark.range(5000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (F.col("id") + 2).alias("negative"))
    assert "BroadcastHashJoin" not in plan(graph.ranking_loss(triples, vectors))


def test_few_bytes_of_nodes_are_drawn_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "SEEDED_ROWS", 10)
    assert graph.seeded_features(graph.nodes(spark, 20, 21).coalesce(1), 2).rdd.getNumPartitions() == 5


def test_effects_are_made_once_for_all_quartiles(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def effect(x):
        seen.add(1)
        return x * 1.5

    effects = spark.range(500).select(F.lit("a").alias("estimator"), effect.asNondeterministic()(F.col("id").cast("double")).alias("cate"))
    row = uplift.cate_summary(effects).first()
    assert seen.value == 500 and row["n"] == 500 and row["median"] == 249.5 * 1.5


def test_segment_softmax_sums_to_one_for_large_scores(small):
    edges = small[0].withColumn("score", F.col("dst") * 100.0)
    out = graph.segment_softmax(edges)
    assert out.count() == edges.count()
    assert np.allclose(out.groupBy("src").agg(F.sum("attention").alias("s")).toPandas()["s"], 1.0)


def test_message_graph_holds_out_both_directions(small):
    edges = small[0]
    held = edges.filter("src < 3 AND dst >= 12")
    left = graph.message_graph(edges, held)
    assert left.join(graph.undirected(held), ["src", "dst"], "left_semi").count() == 0
    assert left.count() == edges.count() - 2 * held.count()


def test_graph_bounds_and_social(spark):
    pairs = spark.createDataFrame([(0, 5)], "user_idx long, item_idx long")
    with refused("node_out_of_range"):
        graph.bipartite_graph(pairs, 1, 5)
    with refused("node_out_of_range"):
        graph.bipartite_graph(pairs.withColumn("user_idx", F.lit(-1)), 1, 6)
    index = spark.createDataFrame([(100, 0), (200, 1)], "raw_id long, idx long")
    kept, report = graph.social_edges(spark.createDataFrame([(100, 200), (100, 999)], "src long, dst long"), index)
    assert kept.collect() == [(0, 1)] and report.first()["dropped"] == 1
    assert graph.bipartite_graph(pairs, 2, 6, kept).count() == 4


def test_seeded_features_are_normal_and_repeatable(spark):
    nodes = graph.nodes(spark, 500, 500)
    a = dense(graph.seeded_features(nodes.repartition(1), 8, 3))
    b = dense(graph.seeded_features(nodes.repartition(6), 8, 3))
    assert (a == b).all() and abs(a.mean()) < 0.05 and abs(a.std() - 1) < 0.05
    assert not np.allclose(a, dense(graph.seeded_features(nodes, 8, 4)))


def test_ranking_loss_and_trained_factors(spark):
    rng = np.random.default_rng(1)
    rows = {(u, 40 + int(i)) for u in range(40) for i in (rng.integers(0, 15, 8) + 15 * (u % 2))}
    train = spark.createDataFrame(sorted((int(s), int(d)) for s, d in rows), "src long, dst long")
    triples = graph.negative_items(train, 40, 30, 1)
    assert triples.filter("negative < 40 OR negative >= 70").count() == 0
    zero = graph.nodes(spark, 40, 30).select("node_id", F.array(F.lit(0.0), F.lit(0.0)).alias("embedding"))
    als = graph.als_embeddings(train, 40, 4, 5)
    table = graph.compare_encoders({"zero": zero, "als": als}, triples).orderBy("rank").collect()
    assert [r["architecture"] for r in table] == ["als", "zero"]
    assert table[1]["loss"] == pytest.approx(graph.random_loss())


# ------------------------------------------------------------------ treatment effects


@pytest.fixture(scope="module")
def trial(spark):
    rng = np.random.default_rng(2)
    n = 3000
    x0, x1, t = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 2, n)
    y = x1 + t * (1 + 2.0 * (x0 > 0)) + 0.3 * rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"round_id": np.arange(n), "treatment": t, "outcome": y, "x0": x0, "x1": x1})).repartition(3).cache()


@pytest.mark.parametrize("learner", [uplift.s_learner, uplift.x_learner, uplift.residual_learner])
def test_learners_recover_the_effect(trial, learner):
    cate = learner(trial, trial, ["x0", "x1"], trees=15, depth=5).join(trial, "round_id").toPandas()
    high, low = cate.loc[cate.x0 > 0.3, "cate"].mean(), cate.loc[cate.x0 < -0.3, "cate"].mean()
    assert abs(high - 3) < 0.6 and abs(low - 1) < 0.6


def test_qini_prefers_the_true_ranking(trial):
    frames = {"right": F.col("x0"), "wrong": -F.col("x0"), "flat": F.lit(0.0)}
    rows = None
    for name, cate in frames.items():
        part = trial.select("round_id", "treatment", "outcome", F.lit(name).alias("estimator"), cate.alias("cate"))
        rows = part if rows is None else rows.unionByName(part)
    got = {r["estimator"]: r["qini"] for r in uplift.qini(rows, by=("estimator",)).collect()}
    assert got["right"] > 0.1 > got["flat"] > -0.1 > got["wrong"]
    d = trial.toPandas().sort_values(["x0", "round_id"], ascending=[False, True])
    t, y = d.treatment.to_numpy(float), d.outcome.to_numpy()
    nt, nc = t.cumsum(), (1 - t).cumsum()
    u = (y * t).cumsum() - (y * (1 - t)).cumsum() * np.divide(nt, nc, out=np.zeros_like(nt), where=nc > 0)
    want = (u - np.linspace(0, u[-1], len(u))).sum() / (abs(u[-1]) * len(u) / 2)
    assert got["right"] == pytest.approx(want)


def test_setup_refusals(spark, trial):
    with refused("treatment_from_outcome"):
        uplift.validate_setup(trial, ["x0"], lineage={"treatment": ["ratio"], "ratio": ["outcome", "x1"]})
    with refused("single_arm"):
        uplift.validate_setup(trial.withColumn("treatment", F.lit(1)), ["x0"])
    with refused("treatment_is_outcome"):
        uplift.validate_setup(trial.withColumn("outcome", F.col("treatment") * 2.0), ["x0"])
    with refused("covariate_is_treatment"):
        uplift.validate_setup(trial.withColumn("x0", F.col("treatment") + 0.0), ["x0"])
    row = uplift.validate_setup(trial.withColumn("p", F.when(F.col("round_id") < 5, 0.0005).otherwise(0.5)), ["x0"], "p").first()
    assert row["logged_propensity_overlap_violations"] == 5 and not row["severe_imbalance"]


def test_functional_dependence_sees_ratios(spark):
    rng = np.random.default_rng(3)
    n = 3000
    d, p = rng.uniform(5, 60, n), rng.uniform(0, 120, n)
    frame = pd.DataFrame({"round_id": np.arange(n), "treatment": (p / d > 1).astype(int), "outcome": p, "d": d})
    assert uplift.functional_dependence(spark.createDataFrame(frame), ["d"]).first()["dependent"]
    frame["treatment"] = rng.integers(0, 2, n)
    assert not uplift.functional_dependence(spark.createDataFrame(frame), ["d"]).first()["dependent"]


def test_effects_must_be_finite_and_constants_show(spark):
    bad = spark.createDataFrame([(1, "s", float("nan"))], "round_id long, estimator string, cate double")
    with refused("non_finite_effects"):
        uplift.assert_finite(bad)
    with refused("no_effects"):
        uplift.assert_finite(bad.limit(0))
    assert uplift.cate_summary(bad.withColumn("cate", F.lit(0.2))).first()["is_degenerate"]


def test_quartiles_by_rank_search_equal_the_aggregate(trial):
    cate = trial.select("round_id", F.when(F.col("round_id") % 2 == 0, "a").otherwise("b").alias("estimator"), F.col("x0").alias("cate"))
    a = uplift.cate_summary(cate).orderBy("estimator").toPandas()
    b = cate.groupBy("estimator").agg(F.percentile("cate", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).orderBy("estimator").toPandas()
    assert np.allclose(a[["q25", "median", "q75"]].to_numpy(), np.stack(b["q"]))


# ------------------------------------------------------------------ comparison tables


def row(experiment="shop_main", agent="x", estimator="snipw", seed=1, value=0.5, status="ok", state="gnn_embeddings",
        weight=0.0, ess=500.0, rounds=1000, detail=None):
    return (experiment, agent, state, weight, estimator, seed, value, value, value, ess, status, detail, rounds)


def cells(spark, rows, attempted=None):
    frame = spark.createDataFrame(rows, "experiment string, agent string, state_source string, cate_reward_weight double, estimator string, "
                                  "seed long, value double, ci_lower double, ci_upper double, effective_sample_size double, status string, detail string, n_test_rounds long")
    if attempted is not None:
        attempted = spark.createDataFrame(attempted, "experiment string, seed long, run_status string")
    return rollup.aggregate_cells(frame, attempted)


def test_lost_seeds_are_counted_and_never_best(spark):
    out = cells(spark, [row(seed=1, value=0.4), row(seed=2, value=0.6), row(agent="y", seed=1, value=0.9)],
                [("shop_main", s, "ok") for s in (1, 2)])
    got = {r["agent"]: r for r in rollup.flag_best(rollup.with_markers(out)).collect()}
    assert got["x"]["status"] == "ok" and got["x"]["mean"] == pytest.approx(0.5) and got["x"]["is_best"]
    assert got["y"]["status"] == "partial" and got["y"]["marker"] == "1/2" and not got["y"]["is_best"]
    assert got["y"]["failures"] == "run_ok:2"
    claims = {(r["claim"], r["subject"]): r["verdict"] for r in rollup.claims_check(out, [("y", "x")], "x").collect()}
    assert claims[("best", "x")] == "ESTABLISHED"
    assert claims[("outperforms", "y>x")] == claims[("beats_random", "y")] == "NOT ESTABLISHED"


def test_failures_keep_their_status(spark):
    out = {r["agent"]: r for r in cells(spark, [
        row(agent="n", value=None, status="not_identifiable", ess=None, detail="no overlap"),
        row(agent="m", seed=1, value=None, status="not_identifiable", ess=None), row(agent="m", seed=2, value=None, status="crashed", ess=None),
        row(agent="e", ess=None)]).collect()}
    assert out["n"]["status"] == "not_identifiable" and out["n"]["mean"] is None and out["n"]["ess"] is None
    assert out["n"]["details"] == ["no overlap"] and out["m"]["status"] == "mixed_failure"
    assert out["e"]["status"] == "ok" and out["e"]["ess_missing"]


def test_low_ess_is_not_best_and_is_said(spark):
    out = cells(spark, [row(agent="lucky", value=0.9, ess=5.0), row(agent="solid", value=0.5), row(agent="dm", estimator="dm", value=0.7, ess=5.0)])
    got = {r["agent"]: r for r in rollup.flag_best(rollup.with_markers(out)).collect()}
    assert got["lucky"]["low_ess"] and not got["lucky"]["is_best"] and got["solid"]["is_best"] and got["dm"]["is_best"]
    caveats = {(r["subject"], r["verdict"]) for r in rollup.ess_caveats(out).collect()}
    assert caveats == {("lucky", "ESS BELOW 1%")}


def test_never_pool_experiments(spark):
    out = cells(spark, [row("shop_main"), row("other_main")])
    assert out.count() == 2
    with refused("mixed_experiments"):
        rollup.one_group(out)
    with refused("one_configuration"):
        rollup.ablation_table(out, "snipw")
    arms = cells(spark, [row("shop_main"), row("shop_ablation_raw", state="raw_features", value=0.3), row("shop_ablation_cate", weight=0.5, value=0.7)])
    table = rollup.ablation_table(arms, "snipw").first().asDict()
    assert table["raw_features@0.0"] == 0.3 and table["gnn_embeddings@0.5"] == 0.7
    verdicts = {r["claim"]: r["verdict"] for r in rollup.ablation_verdicts(arms).collect()}
    assert verdicts == {"graph_state": "HELPS", "reward_shaping": "HELPS"}
    clash = cells(spark, [row("shop_main"), row("shop_ablation_raw")])
    assert {r["table_group"] for r in rollup.table_groups(clash).collect()} == {"shop_main", "shop_ablation_raw"}
    names = spark.createDataFrame([("_main",), ("a_main",), ("a_b",)], "experiment string")
    assert [r[0] for r in names.select(rollup.experiment_family()).collect()] == ["_main", "a", "a_b"]


def test_validation_uses_complete_cells_only(spark):
    out = cells(spark, [row(estimator="exact", value=0.4), row(value=0.5), row(agent="y", estimator="exact", value=0.2), row(agent="y", value=None, status="not_identifiable"),
                        row(agent="z", value=0.1)])
    got = rollup.validation_table(out).first()
    assert got["mae"] == pytest.approx(0.1) and got["n_agents"] == 1


def test_run_attribution(spark):
    records = spark.createDataFrame([("main", 1, "ok", None), ("main", 2, "failed", "oom"), ("lost", 1, "failed", None), ("lost", 2, "skipped", None)],
                                    "variant string, seed long, status string, error string")
    exps = spark.createDataFrame([("shop_main",), ("main",), ("domain",)], "experiment string")
    matched = results.attribute_runs(records, exps)
    assert {(r["experiment"], r["seed"]) for r in results.attempted_seeds(matched).collect()} == {(e, s) for e in ("shop_main", "main") for s in (1, 2)}
    assert [(r["variant"], r["reason"]) for r in results.unattributed_failures(matched).collect()] == [("lost", "failed")]


# ------------------------------------------------------------------ streams


def test_stored_state_skips_replays_and_ignores_unfinished(spark, tmp_path):
    state = StoredState(spark, str(tmp_path / "s"))
    add = lambda old: spark.range(1)
    assert state.apply(0, add) and not state.apply(0, add) and state.apply(1, add)
    (tmp_path / "s" / "delta-000000000009").mkdir()  # a writer died here
    (tmp_path / "s" / "base-000000000007").mkdir()
    assert state.latest() == 2 and state.read().count() == 2
    assert state.apply(9, add) and state.latest() == 10 and state.read().count() == 3


def test_stored_state_compacts_and_survives_a_crash_between(spark, tmp_path, monkeypatch):
    total = lambda parts: parts.groupBy("k").agg(F.sum("n").alias("n"))
    folder = tmp_path / "s"
    state = StoredState(spark, str(folder), total, compact_every=3)
    add = lambda k: lambda old: spark.createDataFrame([(k, 1)], "k string, n long")
    names = lambda: sorted(p.name for p in folder.iterdir())
    for batch in range(2):
        state.apply(batch, add("a"))
    assert names() == ["delta-000000000000", "delta-000000000001"]  # each holds its batch alone
    assert spark.read.parquet(str(folder / "delta-000000000001")).first()[:] == ("a", 1)
    # the writer dies after the delta and before the base is complete, and the batch comes again
    monkeypatch.setattr(StoredState, "compact", lambda self: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        state.apply(2, add("b"))
    monkeypatch.undo()
    (folder / "base-000000000003").mkdir()
    assert not state.apply(2, add("b")) and state.latest() == 3
    assert {tuple(r) for r in state.read().collect()} == {("a", 2), ("b", 1)}
    assert state.apply(3, add("b")) and names() == ["base-000000000004"]
    # it dies after the base is complete and before its parts are gone: they are neither read nor applied again
    spark.createDataFrame([("a", 1)], "k string, n long").write.parquet(str(folder / "delta-000000000003"))
    assert {tuple(r) for r in state.read().collect()} == {("a", 2), ("b", 2)} and not state.apply(3, add("b"))
    for batch in (4, 5, 6):
        state.apply(batch, add("c"))
    assert names() == ["base-000000000007"] and {tuple(r) for r in state.read().collect()} == {("a", 2), ("b", 2), ("c", 3)}


def test_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 300
    frame = pd.DataFrame({"round_id": np.arange(n), "context_id": rng.integers(0, 5, n), "action": rng.integers(0, 3, n),
                          "reward": rng.random(n), "propensity": rng.uniform(0.2, 0.6, n), "kind": rng.choice(["b", "a", "d", "c"], n),
                          "context": rng.normal(size=(n, 2)).tolist()})
    rounds = spark.createDataFrame(frame)
    source = str(tmp_path / "in")
    for k in range(3):
        rounds.filter(F.col("round_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rounds.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def run(writer, name):
        writer.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()

    policy = spark.createDataFrame([(a, c, k, 1.0) for a, k in (("p", 1), ("q", 2)) for c in range(5)], "agent string, context_id long, action long, prob double")
    run(running_estimates(stream, policy).writeStream.outputMode("complete").format("memory").queryName("live"), "c1")
    live = spark.table("live").orderBy("agent").toPandas()
    batch = running_estimates(rounds, policy).orderBy("agent").toPandas()
    pd.testing.assert_frame_equal(live, batch)
    w = (frame.action == 1) / frame.propensity
    assert live.snipw[0] == pytest.approx((w * frame.reward).sum() / w.sum())

    arms = linucb_state(spark, str(tmp_path / "arms"), compact_every=2)
    run(stream.writeStream.foreachBatch(linucb_sink(arms, 2)), "c2")
    assert arms.latest() == 3
    for p, q in zip(arms.read().orderBy("action").collect(), policies.linucb_statistics(rounds, 2).orderBy("action").collect(), strict=True):
        assert p["n"] == q["n"] and np.allclose(p["xx"], q["xx"])
    linucb_sink(arms, 2)(rounds, 1)  # a replayed batch changes nothing
    assert arms.latest() == 3 and arms.read().agg(F.sum("n")).first()[0] == n

    vocab = StoredState(spark, str(tmp_path / "vocab"))
    vocabulary_sink(vocab, "kind")(rounds.filter("kind IN ('b', 'd')"), 0)
    vocabulary_sink(vocab, "kind")(rounds, 1)
    assert {r["value"]: r["code"] for r in vocab.read().collect()} == {"b": 0, "d": 1, "a": 2, "c": 3}
