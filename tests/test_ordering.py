from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterfold.functions.hashing import hash32
from counterfold.functions.skew import spread_join
from counterfold.operators.ordering import (
    average_rank, dense_index, exact_quantiles, extent, hashed_index, key_before, order_boundaries, prefix_sums,
)
from counterfold.operators.sampling import sample_by_chunk, sample_exact


@pytest.fixture(scope="module")
def rows(spark):
    # a third of all rows share one value
    v = F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(50)))
    return spark.range(6000).select("id", v.cast("long").alias("v"), (F.col("id") % 4).alias("g")).repartition(5)


@pytest.fixture(scope="module")
def pdf(rows):
    return rows.toPandas()


def test_dense_index_is_the_sorted_position(rows, pdf):
    out = dense_index(rows, ["v", "id"], "i").toPandas().sort_values("i")
    want = pdf.sort_values(["v", "id"])
    assert out["id"].tolist() == want["id"].tolist()
    assert out["i"].tolist() == list(range(len(want)))


def test_dense_index_per_group_spans_slices(rows, pdf):
    out = dense_index(rows.withColumn("g", F.lit(1)), ["v", "id"], "i", group=["g"]).toPandas()
    assert sorted(out["i"]) == list(range(len(pdf)))


def test_hashed_index_counts_through_slices(rows):
    hashed = rows.withColumn("h", hash32(1, "id"))
    out = hashed_index(hashed, "h", "id", "i", ["g"]).toPandas()
    want = out.sort_values(["g", "h", "id"]).groupby("g").cumcount()
    assert (out.loc[want.index, "i"] == want).all()


def test_prefix_sums_per_group(rows, pdf):
    out = prefix_sums(rows, ["v", "id"], {"s": "v"}, "i", group=["g"]).toPandas()
    want = pdf.sort_values(["g", "v", "id"])
    want["s"] = want.groupby("g")["v"].cumsum()
    out = out.sort_values(["g", "v", "id"])
    assert out["s"].tolist() == want["s"].tolist()


@pytest.mark.parametrize("rank", [0, 1, 700, 2500, 5999])
def test_boundary_has_exactly_rank_rows_before(rows, rank):
    (key,) = order_boundaries(rows, ["v", "id"], [rank])
    assert rows.filter(key_before(["v", "id"], key)).count() == rank


def test_boundaries_of_text_keys(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(200)], "k string")
    assert order_boundaries(df, ["k"], [0, 57]) == [("k000",), ("k057",)]


def test_boundaries_with_wide_and_float_ranges(spark):
    df = spark.createDataFrame([(float(x), i) for i, x in enumerate(np.exp(np.linspace(-30, 30, 9000)))], "x double, id long")
    keys = order_boundaries(df, ["x", "id"], [1, 4500, 8999])
    assert [df.filter(key_before(["x", "id"], k)).count() for k in keys] == [1, 4500, 8999]
    assert extent(df, "id") == (0, 8999, 9000)


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0)], "k int, x double")
    got = {r["k"]: r["r"] for r in average_rank(df, "x", "r", ["k"]).collect()}
    assert got == {3: 1.0, 1: 2.5, 2: 2.5, 4: 4.0}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_plain_join(spark, rows, how):
    dim = spark.range(40).select(F.col("id").alias("v"), (F.col("id") * 2).alias("w"))
    plain = rows.join(dim, ["v"], how).select("id", "v", "w").orderBy("id").collect()
    salted = spread_join(rows, dim, ["v"], how, ["id"], plain_rows=-1, hot_share=20)
    assert salted.select("id", "v", "w").orderBy("id").collect() == plain


def test_spread_join_splits_the_hot_key(spark, rows):
    dim = spark.range(60).select(F.col("id").alias("v"), F.lit(1).alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spread_join(rows, dim, ["v"], "left", ["id"], plain_rows=-1, hot_share=20)
        assert joined.count() == rows.count()
        assert "__salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_sample_has_exact_size_and_ignores_layout(rows):
    a = {r["id"] for r in sample_exact(rows, 777, 1, "id").collect()}
    b = {r["id"] for r in sample_exact(rows.repartition(1), 777, 1, "id").collect()}
    assert len(a) == 777 and a == b
    assert a != {r["id"] for r in sample_exact(rows, 777, 2, "id").collect()}
    assert sample_exact(rows, 10_000, 1, "id").count() == 6000


def test_chunked_sample_takes_the_rounded_share_of_each_chunk(rows):
    out = sample_by_chunk(rows, 600, 3, "id", chunk_rows=1000)
    per_chunk = out.groupBy(F.floor(F.col("id") / 1000)).count().collect()
    assert {r["count"] for r in per_chunk} == {100}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_null_groups_and_layouts(spark, parts):
    """A null group is a group; results don't depend on the number of partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        g = F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3)
        df = spark.range(12_000).select("id", g.alias("g"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 7).alias("v"))
        out = prefix_sums(df.repartition(parts), ["id"], {"s": "v"}, "i", group=["g"]).toPandas().sort_values("id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    pdf = df.toPandas().sort_values("id")
    by = pdf.groupby("g", dropna=False)
    assert len(out) == 12_000 and (out["i"].to_numpy() == by.cumcount().to_numpy()).all()
    want = pdf.assign(v=pdf["v"].fillna(0)).groupby("g", dropna=False)["v"].cumsum()
    assert (out["s"].to_numpy() == want.to_numpy()).all()


def test_ranks_of_null_nan_and_infinite_keys(spark):
    special = {0: None, 1: float("nan"), 2: float("inf"), 3: float("-inf")}
    rows = [(special.get(i % 40, float((i * 7919) % 10_007) - 5000), i) for i in range(12_000)]
    df = spark.createDataFrame(rows, "x double, id long").repartition(6)
    order = lambda r: (r[0] is None, (r[0] != r[0], 0 if r[0] != r[0] else r[0]) if r[0] is not None else (), r[1])
    want = sorted(rows, key=order)
    ranks = [0, 150, 299, 300, 301, 5000, 11_399, 11_400, 11_699, 11_700, 11_999]
    for rank, key in zip(ranks, order_boundaries(df, ["x", "id"], ranks), strict=True):
        before = {r["id"] for r in df.filter(key_before(["x", "id"], key)).select("id").collect()}
        assert before == {i for _, i in want[:rank]}
    low, middle, high = exact_quantiles(df.where("NOT isnan(x)"), "x", [0.0, 0.5, 1.0])
    assert (low, high) == (float("-inf"), float("inf")) and abs(middle) < 5100


def test_quantiles_without_rows(spark):
    assert exact_quantiles(spark.range(3).select(F.lit(None).cast("double").alias("x")), "x", [0.5]) == [None]
