"""From raw interactions to rounds with parts, propensities and a graph."""

from __future__ import annotations

import dataclasses as dc
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.errors import refuse_if
from counterfold.functions.rows import one_row
from counterfold.functions.skew import tasks_by_rows
from counterfold.operators.checks import constant_propensity
from counterfold.operators.encoding import apply_index, encode_categories, fit_index, fit_vocabulary, refuse_unseen
from counterfold.operators.graph import bipartite_graph, social_edges
from counterfold.operators.overlap import check_reachability
from counterfold.operators.projections import require_columns
from counterfold.operators.propensity import assign_propensities
from counterfold.operators.splits import split_rows, split_training_log
from counterfold.params import Params
from counterfold.session import durable, release


@dc.dataclass(frozen=True)
class Prepared:
    """Everything downstream reads; all frames are lazy."""

    rounds: DataFrame
    graph: DataFrame
    user_index: DataFrame
    item_index: DataFrame
    graph_item_index: DataFrame
    n_users: int
    n_actions: int
    n_graph_items: int
    propensity_source: str
    regime: str
    summary: DataFrame


#: Rows that meet their indexes at once: whole rows are dealt anew for each index.
ROWS_AT_ONCE = 30_000_000


def prepare(
    log: DataFrame, params: Params, row_key: str, eval_block: DataFrame | None = None,
    action_universe: DataFrame | None = None, social: DataFrame | None = None, dataset: str = "log",
) -> Prepared:
    """Encode, index, split, weight and connect a log (and its evaluation block).

    Users and items share one index across log and block.  The graph keeps every
    training row; only the policy rows are restricted to the action universe.
    """
    rows = log.count() + (eval_block.count() if eval_block is not None else 0)
    with tasks_by_rows(log.sparkSession, rows):
        return _prepare(log, params, row_key, eval_block, action_universe, social, dataset)


def _prepare(
    log: DataFrame, params: Params, row_key: str, eval_block: DataFrame | None, action_universe: DataFrame | None,
    social: DataFrame | None, dataset: str,
) -> Prepared:
    d = params.dataset
    for frame in [log] + ([eval_block] if eval_block is not None else []):
        require_columns(frame, [d.user_column, d.item_column, d.reward_column, row_key], "interactions")
    frames = [log] + ([eval_block] if eval_block is not None else [])
    categorical = [c for c in d.categorical_columns if all(c in f.columns for f in frames)]
    for column in categorical:
        both = frames[0].select(column)
        for other in frames[1:]:
            both = both.unionByName(other.select(column))
        vocab = fit_vocabulary(both, column)
        frames = [encode_categories(f, vocab, [column]) for f in frames]
    user_index = fit_index(frames, d.user_column)
    universe = frames if action_universe is None else [
        action_universe.select(F.col(action_universe.columns[0]).alias(d.item_column))]
    item_index = fit_index(universe, d.item_column)
    n_items = item_index.count()
    n_users = user_index.count()
    n_actions = d.num_actions or n_items
    refuse_if(n_items > n_actions, "too_many_items", "widen num_actions, never clip",
              items=n_items, num_actions=n_actions)

    def indexed(frame: DataFrame, strict: bool) -> DataFrame:
        refuse_unseen(frame, user_index, d.user_column)
        if strict:
            refuse_unseen(frame, item_index, d.item_column)
        times = max(1, -(-frame.count() // ROWS_AT_ONCE))
        pieces = []
        for k in range(times):
            some = frame if times == 1 else frame.where(F.pmod(F.xxhash64(F.lit("piece"), F.col(row_key)), F.lit(times)) == k)
            pieces.append(index_piece(some))
            release(log.sparkSession)  # what was dealt for this piece
        return reduce(DataFrame.unionByName, pieces)

    def index_piece(frame: DataFrame) -> DataFrame:
        out = apply_index(frame, user_index, d.user_column, "user_idx", False, salt_by=[row_key])
        out = apply_index(out, item_index, d.item_column, "action", False, salt_by=[row_key])
        # joined once, read by the split, the propensities, the graph and the summary; the key travels under one name
        out = out.withColumn("reward", F.col(d.reward_column).cast("double")).withColumn("round_id", F.col(row_key))
        named = [*dc.asdict(d).values(), *dc.asdict(params.split).values(), "round_id"]  # columns with a part of their own
        return durable(out if row_key in named else out.drop(row_key), (row_key, "round_id"))

    timed = dc.replace(params.split)
    if eval_block is None:
        rounds = split_rows(indexed(frames[0], True), timed, params.seed, "round_id")
        graph_rows = rounds.filter(F.col("part") == "train")
        graph_item_index, n_graph_items = item_index, max(n_items, n_actions)
        regime, block_part = "single_log", None
    else:
        split = split_training_log(indexed(frames[0], False), timed, params.seed, "round_id")
        block = indexed(frames[1], True).withColumn("part", F.lit("test"))
        graph_rows = split.filter(F.col("part") == "train")
        graph_item_index = fit_index(
            [frames[0], action_universe.select(F.col(action_universe.columns[0]).alias(d.item_column))
             if action_universe is not None else frames[1]], d.item_column)
        n_graph_items = graph_item_index.count()
        policy_rows = split.filter(F.col("action") >= 0)
        shared = [c for c in policy_rows.columns if c in block.columns]
        rounds = policy_rows.select(*shared).unionByName(block.select(*shared))
        report = check_reachability(graph_rows, policy_rows.filter(F.col("part") == "train"), block)
        regime, block_part = report.first()["regime"], "test"
    rounds, source = assign_propensities(rounds, n_actions, params.evaluation, d.propensity_column, block_part)
    rounds = durable(rounds, ("round_id",)).withColumn(row_key, F.col("round_id"))
    release(rounds.sparkSession)

    pairs = apply_index(graph_rows, graph_item_index, d.item_column, "item_idx", salt_by=["round_id"])
    friends = None
    if social is not None:
        friends, _ = social_edges(social, user_index)
    graph = bipartite_graph(pairs, n_users, n_graph_items, friends)
    summary = dataset_summary(rounds, dataset, n_users, n_items, n_actions, n_graph_items, source, regime,
                              params, d.reward_definition or f"{d.reward_column} (as logged)", graph_rows, graph)
    return Prepared(rounds, graph, user_index, item_index, graph_item_index, n_users, n_actions,
                    n_graph_items, source, regime, summary)


def rounds_summary(rounds: DataFrame) -> DataFrame:
    """Counts, mean reward and propensity range of a rounds table with ``part``."""
    part = lambda p: F.count_if(F.col("part") == p)
    return rounds.agg(
        F.count("*").alias("n_interactions"), F.avg("reward").alias("mean_reward"),
        part("train").alias("n_train"), part("validation").alias("n_validation"), part("test").alias("n_test"),
    ).join(one_row(constant_propensity(rounds)), F.lit(True))


def dataset_summary(
    rounds: DataFrame, dataset: str, n_users: int, n_items: int, n_actions: int, n_graph_items: int,
    source: str, regime: str, params: Params, reward_definition: str, graph_rows: DataFrame, graph: DataFrame,
) -> DataFrame:
    """Facts read from the loaded data for the dataset table."""
    constants = {
        "dataset": dataset, "n_users": n_users, "n_items": n_items, "n_actions": n_actions,
        "reward_definition": reward_definition, "propensity_source": source,
        "split_strategy": params.split.strategy + ("" if regime == "single_log" else "+eval_block"),
        "evaluation_regime": regime, "graph_item_universe": n_graph_items,
        "graph_nodes": n_users + n_graph_items,
    }
    out = rounds_summary(rounds)
    for name, value in constants.items():
        out = out.withColumn(name, F.lit(value))
    out = out.withColumn("policy_rows", F.col("n_train"))
    out = out.join(one_row(graph_rows.agg(F.count("*").alias("representation_rows"))), F.lit(True))
    return out.join(one_row(graph.agg(F.count("*").alias("graph_edges"))), F.lit(True))


def describe_matrix(frame: DataFrame, item: str, reward: str, propensity: str | None = None) -> DataFrame:
    """Rows, positive rate, distinct items and, where logged, the propensity range of a raw frame."""
    logged = [] if propensity is None else [
        F.min(propensity).alias("propensity_min"), F.max(propensity).alias("propensity_max")]
    return frame.agg(F.count("*").alias("n_rows"), F.avg(reward).alias("positive_rate"),
                     F.count_distinct(item).alias("n_items"), *logged)
