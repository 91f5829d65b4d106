"""The star-schema tables as logged decisions.

``events``             a bandit log with repeated draws per (user, action) cell
``lineitem``           a large log with many actions and an item feature
``orders``             an evaluation block with holes and duplicate cells
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfold.functions.skew import lookup_join
from counterfold.operators.encoding import as_category, fit_vocabulary
from counterfold.operators.ordering import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_action(df: DataFrame, source: DataFrame, column: str) -> DataFrame:
    vocab = fit_vocabulary(source, column).select(F.col("value").alias("__v"), F.col("code").alias("action"))
    return lookup_join(df.withColumn("__v", as_category(column)), vocab, ["__v"], "inner").drop("__v")


def event_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds out of ``events``: the context is the user, the action the event type."""
    events = table(spark, sf_dir, "events")
    rounds = events.select(
        F.col("event_id").alias("round_id"), F.col("user_id").alias("user_idx"),
        F.col("user_id").alias("context_id"), "event_type",
        (F.col("value") >= 50).cast("double").alias("reward"),
        micros("ts").alias("t"),
        F.get_json_object("props", "$.k").cast("double").alias("feature"),
    )
    return _with_action(rounds, events, "event_type").drop("event_type")


def user_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_idx, embedding)`` for every vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_idx"), "embedding")


def _line_text() -> F.Column:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                       cents("l_extendedprice"), F.col("l_quantity").cast("long"),
                       cents("l_discount"), cents("l_tax"))


def line_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds out of ``lineitem``: user = customer, action = brand, feature = size.

    ``round_id`` is a digest of the whole row, since no short key is unique.
    """
    part = table(spark, sf_dir, "part")
    brands = _with_action(part.select("p_partkey", "p_brand", "p_size"), part, "p_brand")
    return (
        table(spark, sf_dir, "lineitem")
        .join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.md5(_line_text()).alias("round_id"), F.col("o_custkey").alias("user_idx"),
            F.col("o_custkey").alias("context_id"), "action",
            (F.col("l_quantity") >= 25).cast("double").alias("reward"),
            F.col("p_size").cast("double").alias("feature"), micros("l_shipdate").alias("t"),
        )
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block row with its write order: duplicates of a cell included."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("row_seq"), F.col("o_custkey").alias("user_idx"), "o_orderpriority",
        (F.col("o_totalprice") >= 250000).cast("double").alias("reward"),
        micros("o_orderdate").alias("t"),
    )
    return _with_action(rows, orders, "o_orderpriority").drop("o_orderpriority")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uplift units: urgent orders are treated, the price is the outcome."""
    return table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col("o_orderkey").alias("round_id"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("treatment"),
        F.col("o_totalprice").alias("outcome"),
        F.col("c_acctbal").alias("x0"), F.col("c_nationkey").cast("double").alias("x1"),
        "c_mktsegment",
    )


def purchase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-part interactions, one row per line item."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
