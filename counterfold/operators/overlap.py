"""How a training log and an evaluation block overlap, and what can be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.errors import refuse_if
from counterfold.functions.rows import one_row
from counterfold.session import durable

#: Median history below which an evaluation user's representation is thin.
THIN_HISTORY = 20


def _pairs(log: DataFrame, user: str, item: str) -> DataFrame:
    return log.groupBy(F.col(user).alias("u"), F.col(item).alias("i")).agg(F.count("*").alias("n"))


def block_overlap(
    log: DataFrame, block: DataFrame, universe: DataFrame, user: str = "user_id", item: str = "item_id"
) -> DataFrame:
    """One row: users, items, rows and cells the log shares with the block.

    The log is reduced to (user, item) cells before it meets the items, so a hot
    user or item costs no more than its distinct cells, and to users before it meets
    the block's users, so that no distinct count is taken over cells.
    """
    users = durable(block.select(F.col(user).alias("u")).distinct()).withColumn("in_users", F.lit(True))
    items = durable(universe.select(F.col(universe.columns[0]).alias("i")).distinct()).withColumn("in_items", F.lit(True))
    by_item = F.coalesce("in_items", F.lit(False))
    per_user = _pairs(log, user, item).join(items, "i", "left").groupBy("u").agg(
        F.sum("n").alias("rows"), F.sum(F.when(by_item, F.col("n")).otherwise(0)).alias("item_rows"),
        F.count_if(by_item).alias("item_cells")).join(users, "u", "left")
    by_user, known = F.coalesce("in_users", F.lit(False)), F.col("u").isNotNull()
    total = lambda cond, n: F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0)).cast("long")
    in_log = per_user.agg(
        F.count_if(by_user & known).alias("eval_users_in_log"),
        total(by_user, "rows").alias("eval_user_log_rows"),
        total(F.lit(True), "item_rows").alias("eval_item_log_rows"),
        F.count_if((F.col("item_cells") > 0) & known).alias("eval_item_log_users"),
        total(by_user, "item_rows").alias("overlap_rows"),
        total(by_user, "item_cells").alias("overlap_cells"),
    )
    n_users = users.agg(F.count("*").alias("eval_users"))
    n_items = items.agg(F.count("*").alias("eval_items"))
    # three one-row tables side by side
    return (
        n_users.join(one_row(n_items), F.lit(True)).join(one_row(in_log), F.lit(True))
        .withColumn("regime", F.when(F.col("overlap_rows") == 0, F.lit("cold_item"))
                    .otherwise(F.concat(F.lit("warm: "), F.col("overlap_cells"), F.lit(" cells"))))
    )


def evaluation_reachability(graph_rows: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row on how evaluation users are reached by the training graph.

    All inputs carry ``user_idx``; ``train`` and ``test`` also ``action``.
    """
    evaluated = test.select("user_idx").distinct()
    history = graph_rows.groupBy("user_idx").agg(F.count("*").alias("n"))
    per_user = evaluated.join(history, "user_idx", "left")
    # the exact percentile keeps one counter per distinct history length, and N
    # rows can show at most sqrt(2N) different lengths
    users = per_user.agg(
        F.count("*").alias("evaluation_users"),
        F.count("n").alias("reachable_users"),
        F.count_if(F.col("n").isNull()).alias("cold_users"),
        F.coalesce(F.percentile("n", F.lit(0.5)), F.lit(0.0)).alias("median_history"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("evaluation_user_rows"),
    )
    cells = (
        train.select("user_idx", "action").intersect(test.select("user_idx", "action"))
        .agg(F.count("*").alias("overlap_cells"))
    )
    return users.join(one_row(cells), F.lit(True)).withColumn(
        "thin_history", F.col("median_history") < THIN_HISTORY
    ).withColumn(
        "regime", F.when(F.col("overlap_cells") == 0, F.lit("cold_item"))
        .otherwise(F.concat(F.lit("warm: "), F.col("overlap_cells"), F.lit(" cells"))),
    )


def check_reachability(graph_rows: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    report = evaluation_reachability(graph_rows, train, test)
    row = report.first()
    refuse_if(row["reachable_users"] == 0, "users_unreachable",
              "no evaluation user appears in the rows the graph is built from",
              evaluation_users=row["evaluation_users"])
    return report
