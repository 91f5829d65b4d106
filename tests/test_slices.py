"""Vectors taken a few entries at a time, and what is left on the disks."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterfold.errors import AnalysisRefused
from counterfold.operators import graph, slices
from counterfold.session import durable, release

U, I, D = 9, 13, 5


@pytest.fixture
def bits(spark, monkeypatch):
    """A graph with a hub, edges without one end, and every limit so low that it is met."""
    for name, value in (("PASS_BYTES", 1), ("GATHERED", 17), ("PIECE", 2)):
        monkeypatch.setattr(slices, name, value)
    rng = np.random.default_rng(3)
    pairs = {(int(u), U + int(i)) for u, i in zip(rng.integers(0, U - 1, 40), rng.integers(0, I - 1, 40))} | {(0, U + i) for i in range(I - 1)}
    rows = sorted(pairs) + sorted((i, u) for u, i in pairs) + [(1, None), (None, 1)]
    edges = spark.createDataFrame(rows, "src long, dst long").repartition(3)
    h = rng.normal(size=(U + I, D))
    vectors = spark.createDataFrame([(n, h[n].tolist()) for n in range(U + I)], "node_id long, embedding array<double>")
    a, total = np.zeros((U + I, U + I)), np.zeros(U + I)
    for s, d in rows:
        if s is not None:
            total[s] += 1
            if d is not None:
                a[s, d] = 1
    return edges, vectors, a, np.maximum(total, 1), h


def dense(df):
    return np.array(df.orderBy("node_id").toPandas()["embedding"].tolist())


def test_passes_equal_dense_algebra(spark, bits):
    edges, vectors, a, total, h = bits
    cut = slices.cut(vectors, edges.count())
    assert len(cut.lay.cuts) > 2 and cut.lay.blocks > 2
    assert np.allclose(dense(cut.rows()), h)
    known = np.maximum(a.sum(1), 1)
    # a node's vector is scaled by all its edges, a sum by those with both ends
    x = 0.25 * h / np.sqrt(total)[:, None]
    for again in (True, True, False):
        x = (a @ x + 0.25 * np.sqrt(total)[:, None] * h) / (known if again else np.sqrt(known))[:, None]
    assert np.allclose(dense(graph.light_propagation(edges, vectors, 3)), x)
    light = graph.light_propagation(edges, cut, 3)
    found = light.entries().toPandas()
    y = np.full((U + I, D), np.nan)
    y[found["node_id"], found["d"]] = found["x"]
    assert len(found) == y.size and np.allclose(y, x)


def test_two_rows_of_a_node_add_up(spark, bits):
    edges, vectors, *_, h = bits
    assert np.allclose(dense(slices.cut(vectors.unionByName(vectors), 1).rows()), 2 * h)
    edges, vectors, a, total, _ = bits
    n = a * np.where(np.arange(U + I) == 4, 2, 1)  # an edge to such a node counts for each row
    light = dense(graph.light_propagation(edges, vectors.unionByName(vectors.where("node_id = 4")), 1, [0.0, 1.0]))
    assert np.allclose(light, (n @ (h / np.sqrt(total)[:, None])) / np.sqrt(np.maximum(n.sum(1), 1))[:, None])


def test_ranking_loss_of_slices(spark, bits):
    edges, vectors, *_ = bits
    some = vectors.where("node_id <> 3")  # its triples have no margin
    triples = edges.where(f"src < {U}").withColumn("negative", F.lit(U) + F.col("dst") * 7 % I)
    cut = slices.cut(some, 100)
    a, b = graph.ranking_loss(triples, some).first(), graph.ranking_loss(slices.ask(triples, cut.lay), cut).first()
    assert a["n_triples"] == b["n_triples"] > 5 and a["loss"] == pytest.approx(b["loss"])
    both = graph.compare_encoders({"one": cut, "two": cut}, slices.ask(triples, cut.lay)).collect()
    assert [r["n_triples"] for r in both] == [a["n_triples"]] * 2
    with pytest.raises(AnalysisRefused, match="^other_layout"):
        slices.margins(slices.ask(triples, slices.layout(spark, 3, 2, 1)), cut)


def test_few_rows_travel(spark, bits, monkeypatch):
    """A hop has blobs for rows: none for each node or edge."""
    monkeypatch.setattr(slices, "PIECE", 65_536)
    monkeypatch.setattr(slices, "PASS_BYTES", 1 << 28)
    edges, vectors, *_ = bits
    light = graph.light_propagation(edges, slices.cut(vectors, edges.count()), 2)
    assert light.part(0).count() == light.lay.blocks < U


def test_release_gives_shuffles_back(spark):
    tracked = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    release(spark)
    time.sleep(1)
    before = tracked.size()
    for k in range(5):
        durable(spark.range(100).groupBy((F.col("id") % (k + 2)).alias("k")).count())
    release(spark)
    until = time.time() + 10
    while tracked.size() > before and time.time() < until:
        time.sleep(0.2)
    assert tracked.size() <= before


def test_edges_that_run_both_ways_are_counted_where_they_meet(spark, bits):
    edges, vectors, *_ = bits
    shared = graph.SharedFeatures(vectors.select("node_id", (F.col("node_id") % 7).alias("v")), vectors.where("node_id < 7").withColumnRenamed("node_id", "v"))
    plan = lambda df: df._jdf.queryExecution().toString()
    one, two = (graph.aggregate_neighbours(edges, shared, "symmetric", True, both) for both in (False, True))
    assert np.allclose(dense(one), dense(two))
    assert "HashAggregate" in plan(one) and "HashAggregate" not in plan(two)


def test_rows_meet_their_indexes_a_few_at_a_time(spark, monkeypatch):
    from counterfold.params import DatasetParams, EvaluationParams, Params, SplitParams
    from counterfold.plans import prepare

    log = spark.range(60).select(
        (F.col("id") % 7).alias("user_id"), (F.col("id") % 11).alias("item_id"), F.col("id").alias("t"),
        (F.col("id") % 2).cast("double").alias("reward"), F.md5(F.col("id").cast("string")).alias("row_key"))
    params = Params(split=SplitParams(strategy="temporal", timestamp_column="t"), dataset=DatasetParams(),
                    evaluation=EvaluationParams(behaviour_policy="estimated"))
    whole = prepare.prepare(log, params, "row_key")
    monkeypatch.setattr(prepare, "ROWS_AT_ONCE", 25)
    pieces, given = [], prepare.release
    monkeypatch.setattr(prepare, "release", lambda s: (pieces.append(1), given(s)))
    few = prepare.prepare(log, params, "row_key")
    assert len(pieces) >= 3
    assert few.summary.first() == whole.summary.first()
    columns = sorted(whole.rounds.columns)
    assert sorted(few.rounds.select(columns).collect()) == sorted(whole.rounds.select(columns).collect())


def test_digests_are_written_as_bytes(spark):
    texts = ["00ff", "abc", "ABCD", "", "xyz", None, "0123456789abcdef"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "n long, key string, other string")
    out = durable(df, ("n", "key"))
    assert out.dtypes == df.dtypes and [tuple(r) for r in out.orderBy("n").collect()] == [(i, t, t) for i, t in enumerate(texts)]
    assert "hex" in out._jdf.queryExecution().analyzed().toString()
