"""Work that is done once, and tasks whose number follows the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterfold.functions import skew
from counterfold.operators import graph, overlap
from counterfold.plans import queries_evaluation


def plan(df):
    return df._jdf.queryExecution().toString()


def test_shuffles_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    with skew.tasks_by_rows(spark, 95):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "10"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert skew.tasks_for(spark, 1) == 4


def test_full_tasks_are_not_put_together(spark, monkeypatch):
    """Compressed bytes say little about a task's rows: above a full task for each core the partitions stay."""
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    pairs = spark.range(2_000).select((F.col("id") % 40).alias("user_idx"), (F.col("id") % 30).alias("item_idx"))
    with skew.tasks_by_rows(spark, 2_000):
        edges = graph.bipartite_graph(pairs, 40, 30)
        assert edges.rdd.getNumPartitions() == 2 * 20  # both directions
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    with skew.tasks_by_rows(spark, 300):
        assert graph.bipartite_graph(pairs, 40, 30).rdd.getNumPartitions() < 2 * 4


def test_item_values_read_the_rounds_once(spark, sf_dir):
    for df in queries_evaluation._line_values(spark, sf_dir):
        assert "lineitem" not in plan(df)


def test_overlap_counts_users_without_expanding_cells(spark):
    log = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 9), (None, 1), (1, None)], "user_id long, item_id long")
    block = spark.createDataFrame([(1, 1), (2, 7), (5, 1), (None, 2)], "user_id long, item_id long")
    out = overlap.block_overlap(log, block, block.select("item_id"))
    assert "Expand" not in plan(out)
    assert out.first().asDict() == {
        "eval_users": 4, "eval_items": 3, "eval_users_in_log": 2, "eval_user_log_rows": 5, "eval_item_log_rows": 5,
        "eval_item_log_users": 2, "overlap_rows": 4, "overlap_cells": 3, "regime": "warm: 3 cells"}
