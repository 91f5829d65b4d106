"""Off-policy evaluation on sufficient statistics.

Rounds are reduced once, map-side, to (context, fold, action) cells.  Within a
cell the evaluated policy's probability is constant, so every weighted sum of
every policy is that probability times a cell sum: no round is joined with any
policy, and a context holding most of the log is a handful of cells.
"""

from __future__ import annotations

import dataclasses as dc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfold.errors import refuse_if
from counterfold.functions.rows import one_row
from counterfold.operators.bootstrap import METHODS, percentile_interval, replicate_sums
from counterfold.operators.checks import validate_policy
from counterfold.operators.ordering import dense_index
from counterfold.operators.propensity import ENUMERATED_ROUNDS_PER_CELL
from counterfold.operators.reward_model import (
    PRIOR_WEIGHT, RIDGE, LinearRewardModel, RewardModel, linear_reward_model, tabular_reward_model,
)
from counterfold.operators.splits import context_folds, deal_rounds, stratified_folds
from counterfold.params import EPSILON, NEEDS_REWARD_MODEL, EvaluationParams
from counterfold.session import durable

# Status, warning and caveat words of a result row.
OK, NOT_IDENTIFIABLE = "ok", "not_identifiable"
NO_OVERLAP, DR_IS_DM, NO_INTERVAL = "no_overlap", "dr_reduces_to_dm", "ci_unavailable"
LOW_ESS_SHARE = 0.01

Model = RewardModel | LinearRewardModel
#: Fits a model on cells: ``fit(cells, weight=, weighted_reward=, group=, pairs=)``.
Fit = Callable[..., Model]

_SUMS = ["n", "w", "w2", "wr", "eq", "corr", "meq", "mcorr", "rsum", "rn"]


def importance_weight(probability: Column | str, propensity: Column | str = "propensity") -> Column:
    """``pi_e(a|x) / max(p, 1e-12)``."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(probability) / F.greatest(c(propensity), F.lit(EPSILON))


def mrdr_weight(probability: Column | str, propensity: Column | str = "propensity") -> Column:
    """``pi_e (1 - p) / p^2``: what drives the variance of the DR estimate."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    p = c(propensity)
    return c(probability) * (1.0 - p) / F.greatest(p * p, F.lit(EPSILON))


def kish_ess(w: str = "w", w2: str = "w2") -> Column:
    return F.when(F.col(w2) <= EPSILON, F.lit(0.0)).otherwise(F.col(w) * F.col(w) / F.col(w2))


def ipw_value(wr: str = "wr", w: str = "w", n: str = "n") -> Column:
    """NULL, never 0, when no logged action is supported."""
    return F.when(F.col(w) > EPSILON, F.col(wr) / F.col(n))


def snipw_value(wr: str = "wr", w: str = "w") -> Column:
    return F.when(F.col(w) > EPSILON, F.col(wr) / F.col(w))


def estimator_value(name: str) -> Column:
    """An estimator as an expression over summed unit statistics."""
    return {
        "ipw": ipw_value(), "snipw": snipw_value(),
        "dm": F.col("eq") / F.col("n"), "dr": (F.col("eq") + F.col("corr")) / F.col("n"),
        "mrdr": (F.col("meq") + F.col("mcorr")) / F.col("n"),
        "exact": F.when(F.col("rn") > 0, F.col("rsum") / F.col("rn")),
    }[name]


# ------------------------------------------------------------------ cells


def logged_cells(
    rounds: DataFrame, keys: tuple[str, ...] = ("context_id", "fold", "action"), *extra: Column
) -> DataFrame:
    """Cell sums that serve every policy and every weighted estimator."""
    p = F.greatest(F.col("propensity"), F.lit(EPSILON))
    m = mrdr_weight(F.lit(1.0))
    bad_p = F.col("propensity").isNull() | ~((F.col("propensity") > 0) & (F.col("propensity") <= 1))
    return rounds.groupBy(*keys).agg(
        F.count_if(bad_p).alias("bad_p"),
        F.count_if(F.col("reward").isNull() | F.isnan("reward")).alias("bad_r"),
        F.count("*").alias("n"), F.sum("reward").alias("r"),
        F.sum(1.0 / p).alias("inv"), F.sum(F.col("reward") / p).alias("rinv"),
        F.sum(1.0 / (p * p)).alias("inv2"),
        F.sum(m).alias("m"), F.sum(m * F.col("reward")).alias("mr"), F.count_if(m > 0).alias("m_rounds"), *extra,
    )


def alike_rounds(rounds: DataFrame) -> DataFrame:
    """Rounds equal in context, fold, action, reward and propensity, as one row each.

    They are exchangeable, so a bootstrap need only know how many there are.  The
    row is named by its first round.
    """
    sums = logged_cells(rounds, ("context_id", "fold", "action", "reward", "propensity"), F.min("round_id").alias("round_id"))
    return sums.drop("reward", "propensity")


def rounds_per_cell(rounds: DataFrame) -> DataFrame:
    cells = rounds.groupBy("context_id", "action").agg(F.count("*").alias("n"))
    return cells.agg(
        F.sum("n").alias("n_rounds"), F.count("*").alias("n_cells"),
        F.count_distinct("context_id").alias("n_contexts"),
    ).withColumn("rounds_per_cell", F.col("n_rounds") / F.col("n_cells"))


def independent_unit(rounds: DataFrame, override: str = "auto") -> DataFrame:
    """Is the independent observation the context or the round?

    Cells seen about once are an enumeration: a context's rounds are its row, and
    the sample is of contexts.  Cells seen many times are repeated draws.  With
    one round per context the two coincide.
    """
    rule = F.when(F.col("n_contexts") == F.col("n_rounds"), "round")
    if override != "auto":
        rule = rule.otherwise(F.lit(override))
    else:
        rule = rule.when(F.col("rounds_per_cell") < ENUMERATED_ROUNDS_PER_CELL, "context").otherwise("round")
    return rounds_per_cell(rounds).withColumn("unit", rule)


def resolve_unit(n_rounds: int, n_cells: int, n_contexts: int, override: str = "auto") -> str:
    if n_contexts == n_rounds:
        return "round"
    if override != "auto":
        return override
    return "context" if n_rounds / n_cells < ENUMERATED_ROUNDS_PER_CELL else "round"


def group_contexts(rounds: DataFrame) -> DataFrame:
    """``(context_id, context, n_rounds)`` by identical context vector."""
    distinct = rounds.groupBy("context").agg(F.min("round_id").alias("rep"), F.count("*").alias("n_rounds"))
    return dense_index(distinct, ["rep"], "context_id").select("context_id", "context", "rep", "n_rounds")


def last_write(rows: DataFrame, order: str = "row_seq") -> DataFrame:
    """One ground-truth cell per (user, action): the last row written wins."""
    return rows.groupBy("user_idx", "action").agg(
        F.max_by("reward", order).alias("reward"), F.max(order).alias(order))


def duplicate_cells(rows: DataFrame) -> DataFrame:
    cells = rows.groupBy("user_idx", "action").agg(F.count("*").alias("n"))
    return cells.agg(F.sum("n").alias("block_rows"), F.count("*").alias("cells"),
                     (F.sum("n") - F.count("*")).alias("duplicate_rows"))


# ------------------------------------------------------------------ exact values


def exact_context_values(policy: DataFrame, block: DataFrame) -> DataFrame:
    """``E[R(x, pi)]`` per context over OBSERVED cells; NULL where none is.

    A distribution over several actions is summed as it is: mass on unobserved
    cells is dropped, not spread over the others.
    """
    truth = block.select(F.col("user_idx").alias("context_id"), "action", F.col("reward").alias("truth"))
    keys = [c for c in ("agent", "context_id") if c in policy.columns]
    return policy.join(truth, ["context_id", "action"], "left").groupBy(*keys).agg(
        F.sum(F.col("prob") * F.col("truth")).alias("value"))


def exact_uniform_values(block: DataFrame) -> DataFrame:
    """The uniform policy IS renormalised: the mean over a context's observed cells."""
    return block.groupBy(F.col("user_idx").alias("context_id")).agg(F.avg("reward").alias("value"))


def exact_value(weights: DataFrame, values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Round-weighted mean of context values with scored and masked round counts."""
    joined = weights.join(values, "context_id", "left")
    seen = F.col("value").isNotNull()
    return joined.groupBy(*by).agg(
        (F.sum(F.col("value") * F.col("n_rounds")) / F.sum(F.when(seen, F.col("n_rounds")))).alias("exact_value"),
        F.coalesce(F.sum(F.when(seen, F.col("n_rounds"))), F.lit(0)).alias("rounds_scored"),
        F.coalesce(F.sum(F.when(~seen, F.col("n_rounds"))), F.lit(0)).alias("rounds_masked"),
    )


def block_coverage(rounds: DataFrame, rows: DataFrame, n_actions: int) -> DataFrame:
    """Ground-truth cells consulted and observed, counted by user, not by grid."""
    per_user = last_write(rows).groupBy("user_idx").agg(F.count("*").alias("observed"))
    visits = rounds.groupBy("user_idx").agg(F.count("*").alias("n"))
    consulted = visits.join(per_user, "user_idx", "left").agg(
        (F.sum("n") * n_actions).alias("cells_consulted"),
        F.sum(F.col("n") * F.coalesce("observed", F.lit(0))).alias("cells_observed"),
    )
    return consulted.join(one_row(duplicate_cells(rows)), F.lit(True)).withColumn(
        "coverage", F.col("cells_observed") / F.col("cells_consulted"))


# ------------------------------------------------------------------ evaluation


@dc.dataclass(frozen=True)
class Evaluation:
    """What the estimators read: one row of sums per (agent, unit), and its unit."""

    unit_stats: DataFrame
    support: DataFrame
    unit: str
    q_label: str
    n_contexts: int


def _unit_cells(rounds: DataFrame, n_actions: int, params: EvaluationParams, folded: bool, seed: int, unit_column: str | None):
    """Cell sums per independent unit with their fold, the unit, the columns of a row, and the context count.

    The rounds are scanned once into (context, action) cells, which also settle
    the invariants and the unit.  When the round is the unit, rounds that agree in
    everything an estimator reads are kept as one row with their number.  Folds
    are of rounds only then, otherwise of contexts.
    """
    cells = durable(logged_cells(rounds, ("context_id", "action")))
    row = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rounds"), F.count("*").alias("n_cells"),
        F.count_distinct("context_id").alias("n_contexts"),
        F.coalesce(F.sum("bad_p"), F.lit(0)).alias("propensity_out_of_range"),
        F.coalesce(F.sum("bad_r"), F.lit(0)).alias("reward_missing"),
        F.coalesce(F.sum(F.when(F.col("action").isNull() | (F.col("action") < 0) | (F.col("action") >= n_actions),
                                F.col("n"))), F.lit(0)).alias("action_out_of_range"),
    ).first().asDict()
    refuse_if(row["n_rounds"] == 0, "no_rounds", "there is nothing to evaluate")
    bad = {k: v for k, v in row.items() if k.endswith(("range", "missing")) and v}
    refuse_if(bool(bad), "invalid_rounds", "rows break the rounds contract", **bad)
    unit = resolve_unit(row["n_rounds"], row["n_cells"], row["n_contexts"], params.independent_unit)
    if unit_column is not None:
        refuse_if(unit_column not in rounds.columns, "missing_unit", f"no column {unit_column!r}", columns=rounds.columns[:20])
        unit = unit_column
        cells = durable(logged_cells(rounds.withColumn("__unit", F.col(unit_column).cast("string")), ("__unit", "context_id", "action")))
    if unit == "round":
        narrow = rounds.select("round_id", "context_id", "action", "reward", "propensity")
        narrow = context_folds(narrow, params.folds, seed, key="round_id") if folded else narrow.withColumn("fold", F.lit(0))
        cells = durable(alike_rounds(narrow))
    elif folded:
        folds = context_folds(cells.select("context_id").distinct(), params.folds, seed)
        cells = durable(cells.join(folds, "context_id"))
    else:
        cells = cells.withColumn("fold", F.lit(0))
    key = ["round_id", "context_id"] if unit == "round" else ["context_id"] if unit_column is None else ["__unit", "context_id"]
    return cells, unit, key, row["n_contexts"]


def _agent_cells(cells: DataFrame, policies: DataFrame | None, uniform: tuple[str, ...], n_actions: int) -> DataFrame:
    """Cells an agent supports, with ``pi``."""
    out = None
    if policies is not None:
        out = cells.join(policies.select("agent", "context_id", "action", F.col("prob").alias("pi")),
                         ["context_id", "action"])
    for name in uniform:
        part = cells.withColumn("agent", F.lit(name)).withColumn("pi", F.lit(1.0 / n_actions))
        out = part if out is None else out.unionByName(part.select(*out.columns))
    return out


def _expected_q(
    model: Model, policies: DataFrame | None, uniform: tuple[str, ...], name: str
) -> DataFrame:
    """``(agent, context_id, fold, name)``: E_pi[q] once per context and fold."""
    out = None
    if policies is not None:
        rows = model.q_at(policies.join(model.folds(), [*model.group, "context_id"]))
        out = rows.groupBy("agent", "context_id", "fold").agg(F.sum(F.col("prob") * F.col("q")).alias(name))
    for agent in uniform:
        part = model.uniform_q(name)
        part = part.filter(F.col("agent") == agent) if model.group else part.withColumn("agent", F.lit(agent))
        part = part.select("agent", "context_id", "fold", name)
        out = part if out is None else out.unionByName(part)
    return out


def _agents(policies: DataFrame | None, uniform: tuple[str, ...], spark) -> list[str]:
    named = [] if policies is None else [r[0] for r in policies.select("agent").distinct().collect()]
    return sorted({*named, *uniform})


def _mrdr_folds(base: DataFrame, supported: DataFrame, n_folds: int, seed: int, key: list[str], by_round: bool) -> DataFrame:
    """``base`` with fold and number of rounds per (agent, row): supported ones are balanced among themselves.

    Rows without weight do not enter the fit and keep the shared fold.  Contexts go into
    one fold whole; the rounds that a row stands for are dealt over the folds.
    """
    if by_round:
        dealt = deal_rounds(supported, n_folds, seed, key="round_id", mult="n", group=("agent",)).select(
            "agent", "round_id", F.col("fold").alias("__f"), F.col("n").alias("__n"))
        out = base.join(dealt, ["agent", "round_id"], "left").withColumn("n", F.coalesce("__n", "n")).drop("__n")
    else:
        ranked = stratified_folds(
            supported.select("agent", "context_id").distinct().withColumn("supported", F.lit(True)), n_folds, seed, group=("agent",))
        out = base.join(ranked.select("agent", "context_id", F.col("fold").alias("__f")), ["agent", "context_id"], "left")
    return out.withColumn("fold", F.coalesce("__f", "fold").cast("int")).drop("__f")


def reward_model_fit(
    n_actions: int, n_folds: int, buckets: DataFrame | None = None, contexts: DataFrame | None = None,
    prior: float = PRIOR_WEIGHT, ridge: float = RIDGE,
) -> Fit:
    """How dm, dr and each agent's mrdr fit their reward model.

    ``contexts`` (context_id, context) give ridge regressions per arm, else
    ``buckets`` (context_id, bucket) shrunk means.
    """
    if contexts is not None:
        contexts = durable(contexts.select("context_id", "context"))
        dim = contexts.agg(F.max(F.size("context"))).first()[0] or 0
        return lambda cells, **kw: linear_reward_model(cells, contexts, n_actions, n_folds, dim, ridge, **kw)
    buckets = durable(buckets.select("context_id", "bucket"))
    return lambda cells, **kw: tabular_reward_model(cells, buckets, n_actions, n_folds, prior, **kw)


def prepare_evaluation(
    rounds: DataFrame, policies: DataFrame | None, n_actions: int, params: EvaluationParams,
    uniform: tuple[str, ...] = (), buckets: DataFrame | None = None, block: DataFrame | None = None,
    model: Model | None = None, prior: float = PRIOR_WEIGHT, seed: int = 42, contexts: DataFrame | None = None,
    fit: Fit | None = None, unit_column: str | None = None,
) -> Evaluation:
    """Reduce rounds, policies, reward models and ground truth to unit statistics.

    ``rounds``: round_id, context_id, action, reward, propensity.
    ``policies``: agent, context_id, action, prob.  ``uniform`` names agents that
    play uniformly and need no table.  Reward models come from ``fit`` (see
    :func:`reward_model_fit`), or from ``contexts`` or ``buckets`` through it; ``model`` is
    one that was fitted before and serves dm and dr.  ``unit_column`` names the
    column of ``rounds`` that holds the independent unit, such as a user or a persona.
    """
    refuse_if("exact" in params.estimators and block is None, "no_ground_truth",
              "the exact value needs an observed block")
    needs_q = bool(set(params.estimators) & NEEDS_REWARD_MODEL)
    shared = bool(set(params.estimators) & (NEEDS_REWARD_MODEL - {"mrdr"}))
    can_fit = not (buckets is None and contexts is None and fit is None)
    refuse_if((shared and model is None or "mrdr" in params.estimators) and not can_fit, "no_reward_model",
              "dm, dr and mrdr need a reward model", estimators=params.estimators)
    spark = rounds.sparkSession
    if policies is not None:
        # read several times below; one row per agent, context and action
        policies = durable(policies.select("agent", "context_id", "action", "prob"))
        validate_policy(policies.withColumn("context_id", F.struct("agent", "context_id")), n_actions)
    agents = _agents(policies, uniform, spark)
    agent_list = F.explode(F.array(*[F.lit(a) for a in agents])).alias("agent")
    cells, unit, key, n_contexts = _unit_cells(rounds, n_actions, params, needs_q, seed, unit_column)
    if needs_q and fit is None and can_fit:
        fit = reward_model_fit(n_actions, params.folds, buckets, contexts, prior)
    if shared and model is None:
        fit_cells = cells if key == ["context_id"] else cells.groupBy("context_id", "fold", "action").agg(
            *[F.sum(c).alias(c) for c in ("n", "r", "m", "mr", "m_rounds")])
        model = fit(fit_cells)
    if model is not None:
        model = model.written()

    # base: every (agent, row), whether or not any of its rounds is supported
    base = cells.groupBy(*key, "fold").agg(F.sum("n").alias("n")).select("*", agent_list)
    mine = _agent_cells(cells, policies, uniform, n_actions)
    if model is not None:
        mine = model.q_at(mine)
    else:
        mine = mine.withColumn("q", F.lit(0.0))
    weighted = mine.groupBy("agent", *key).agg(
        F.sum(F.col("pi") * F.col("inv")).alias("w"), F.sum(F.col("pi") ** 2 * F.col("inv2")).alias("w2"),
        F.sum(F.col("pi") * F.col("rinv")).alias("wr"),
        F.sum(F.col("pi") * (F.col("rinv") - F.col("q") * F.col("inv"))).alias("corr"),
        F.sum(F.when(F.col("pi") > 0, F.col("m_rounds")).otherwise(0)).alias("m_rounds"),
    )
    stats = base.join(weighted, ["agent", *key], "left")
    if model is not None:
        stats = stats.join(_expected_q(model, policies, uniform, "__eq"), ["agent", "context_id", "fold"], "left")
    else:
        stats = stats.withColumn("__eq", F.lit(None).cast("double"))

    if "mrdr" in params.estimators:
        stats = stats.join(_mrdr_stats(cells, policies, uniform, n_actions, fit, params, unit, key, base, seed), ["agent", *key], "left")
    else:
        stats = stats.withColumns({"meq": F.lit(None).cast("double"), "mcorr": F.lit(None).cast("double"),
                                   "part_n": F.col("n"), "part": F.lit(0)})

    if block is not None and "exact" in params.estimators:
        truth = None
        if policies is not None:
            truth = exact_context_values(policies, block)
        for agent in uniform:
            part = exact_uniform_values(block).withColumn("agent", F.lit(agent)).select("agent", "context_id", "value")
            truth = part if truth is None else truth.select("agent", "context_id", "value").unionByName(part)
        stats = stats.join(truth, ["agent", "context_id"], "left")
    else:
        stats = stats.withColumn("value", F.lit(None).cast("double"))

    # a row of alike rounds was cut where the folds of mrdr cut it
    share, n = F.col("part_n") / F.col("n"), F.col("part_n").cast("double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * share
    unit_id = F.concat_ws("|", "round_id", "part") if unit == "round" else F.col(key[0]).cast("string")
    final = stats.select(
        "agent", unit_id.alias("unit_id"), n.alias("n"),
        zero("w").alias("w"), zero("w2").alias("w2"), zero("wr").alias("wr"), zero("corr").alias("corr"),
        (F.col("__eq") * n).alias("eq"), "meq", "mcorr",
        F.coalesce(F.col("value") * n, F.lit(0.0)).alias("rsum"),
        F.when(F.col("value").isNotNull(), n).otherwise(0.0).alias("rn"),
        zero("m_rounds").alias("m_rounds"),
        F.when(F.col("m_rounds") > 0, F.col("context_id")).alias("supported"),
        # how many independent units the row stands for
        (F.col("part_n") if unit == "round" else F.lit(1)).cast("long").alias("mult"),
    )
    if unit_column is not None:
        final = final.groupBy("agent", "unit_id").agg(
            *[F.sum(c).alias(c) for c in (*_SUMS, "m_rounds")], F.collect_set("supported").alias("supported"), F.max("mult").alias("mult"))
        final = durable(final)
        contexts_of = final.select("agent", F.explode("supported").alias("supported"))
    else:
        final = durable(final)
        contexts_of = final.select("agent", "supported")
    support = final.groupBy("agent").agg(
        F.round(F.sum("m_rounds")).cast("long").alias("supported_rounds"), F.sum("rn").alias("rn"),
    ).join(contexts_of.groupBy("agent").agg(F.count_distinct("supported").alias("supported_contexts")), "agent", "left").fillna(
        0, ["supported_contexts"])
    if "exact" in params.estimators:
        empty = [r["agent"] for r in support.filter("rn = 0").collect()]
        refuse_if(bool(empty), "nothing_observed", "no round has a recorded reward for the chosen action",
                  agents=empty)
    return Evaluation(final.drop("supported"), support, unit, model.label if model is not None else "none", n_contexts)


def _mrdr_stats(cells, policies, uniform, n_actions, fit, params, unit, key, base, seed):
    """``(agent, row, part, part_n, meq, mcorr)`` under a reward model refitted per agent.

    ``part`` is the fold and ``part_n`` the number of the row's rounds in it.
    """
    mine = _agent_cells(cells, policies, uniform, n_actions)
    supported = mine.filter((F.col("m_rounds") > 0) & (F.col("pi") > 0)).select("agent", *key, "n")
    folds = durable(_mrdr_folds(base, supported, params.folds, seed, key, unit == "round"))
    parts = folds.select("agent", *key, "fold", F.col("n").alias("part_n"))
    mine = mine.drop("fold").join(parts, ["agent", *key])
    if unit == "round":  # a row is one cell here, and a part of it has its share of the sums
        mine = mine.withColumns({c: F.col(c) * F.col("part_n") / F.col("n") for c in ("inv", "rinv", "m", "mr")})
    fitted = mine.groupBy("agent", "context_id", "fold", "action").agg(
        F.sum(F.col("pi") * F.col("m")).alias("mw"), F.sum(F.col("pi") * F.col("mr")).alias("ms"))
    model = fit(fitted, weight="mw", weighted_reward="ms", group=("agent",),
                pairs=folds.select("agent", "context_id", "fold").distinct()).written()
    correction = model.q_at(mine).groupBy("agent", *key, "fold").agg(
        F.sum(F.col("pi") * (F.col("rinv") - F.col("q") * F.col("inv"))).alias("mcorr"))
    expected = _expected_q(model, policies, uniform, "__meq")
    return (
        parts.join(expected, ["agent", "context_id", "fold"], "left")
        .join(correction, ["agent", *key, "fold"], "left")
        .select("agent", *key, F.col("fold").alias("part"), "part_n", (F.col("__meq") * F.col("part_n")).alias("meq"),
                F.coalesce("mcorr", F.lit(0.0)).alias("mcorr"))
    )


def estimate(evaluation: Evaluation, params: EvaluationParams) -> DataFrame:
    """Point estimates with status and warnings, one row per (agent, estimator)."""
    totals = evaluation.unit_stats.groupBy("agent").agg(
        *[F.sum(s).alias(s) for s in _SUMS], F.sum("mult").alias("n_independent_units"))
    totals = totals.join(evaluation.support.drop("rn"), "agent")
    no_overlap = F.col("w") <= EPSILON
    # what is dealt over the folds, rounds or whole contexts, must reach all of them
    thin = F.col("supported_rounds") < params.folds
    if evaluation.unit != "round":
        thin = thin | (F.col("supported_contexts") < params.folds)
    rows = []
    for name in params.estimators:
        value, warn = estimator_value(name), F.array().cast("array<string>")
        status, detail = F.lit(OK), F.lit(None).cast("string")
        ess = kish_ess()
        if name in ("ipw", "snipw"):
            status = F.when(no_overlap, NOT_IDENTIFIABLE).otherwise(OK)
            detail = F.when(no_overlap, "all importance weights are zero: no logged action is supported")
        elif name == "dm":
            warn = F.when(no_overlap, F.array(F.lit(NO_OVERLAP))).otherwise(warn)
            detail = F.when(no_overlap, "the reward model extrapolates to actions no round supports")
        elif name in ("dr", "mrdr"):
            warn = F.when(no_overlap, F.array(F.lit(NO_OVERLAP), F.lit(DR_IS_DM))).otherwise(warn)
            detail = F.when(no_overlap, "the correction term is zero, so this is the direct method")
        if name == "mrdr":
            status = F.when(thin, NOT_IDENTIFIABLE).otherwise(OK)
            value, ess = F.when(~thin, value), F.when(~thin, ess)
            spread = "supported_rounds" if evaluation.unit == "round" else "supported_contexts"
            detail = F.when(thin, F.concat(
                F.lit("only "), F.col(spread).cast("string"), F.lit(f" {spread.replace('_', ' ')} of this agent for {params.folds} folds")
            )).otherwise(detail)
            warn = F.when(thin, F.array().cast("array<string>")).otherwise(warn)
        rows.append(F.struct(
            F.lit(name).alias("estimator"), value.alias("value"), status.alias("status"),
            detail.alias("detail"), warn.alias("warnings"), ess.alias("effective_sample_size"),
        ))
    return totals.select(
        "agent", F.col("n").cast("long").alias("n_samples"), "n_independent_units",
        F.col("rn").cast("long").alias("exact_rounds_scored"),
        (F.col("n") - F.col("rn")).cast("long").alias("exact_rounds_masked"),
        F.explode(F.array(*rows)).alias("e"),
    ).select("agent", "e.*", "n_samples", "n_independent_units", "exact_rounds_scored", "exact_rounds_masked")


def evaluate_policies(
    rounds: DataFrame, policies: DataFrame | None, n_actions: int, params: EvaluationParams,
    uniform: tuple[str, ...] = (), buckets: DataFrame | None = None, block: DataFrame | None = None,
    model: Model | None = None, seed: int = 42, provenance: dict[str, object] | None = None,
    method: str = METHODS[0], prior: float = PRIOR_WEIGHT, contexts: DataFrame | None = None, fit: Fit | None = None,
    unit_column: str | None = None,
) -> DataFrame:
    """Result rows: every estimator of every agent with its interval and provenance."""
    ev = prepare_evaluation(
        rounds, policies, n_actions, params, uniform, buckets, block, model, prior, seed, contexts, fit, unit_column)
    points = estimate(ev, params)
    replicates, method, _ = replicate_sums(ev.unit_stats, _SUMS, params.n_bootstrap, seed, method=method)
    replicates = durable(replicates)
    intervals = None
    for name in params.estimators:
        part = percentile_interval(replicates, estimator_value(name), params.confidence_level)
        part = part.withColumn("estimator", F.lit(name))
        intervals = part if intervals is None else intervals.unionByName(part)
    has_value = F.col("status") == OK
    lost = has_value & (F.col("undefined") > 0)
    out = points.join(intervals, ["agent", "estimator"], "left").withColumn(
        "warnings", F.when(lost, F.array_append("warnings", F.lit(NO_INTERVAL))).otherwise(F.col("warnings"))
    ).withColumn("detail", F.when(lost & F.col("detail").isNull(), F.concat(
        F.lit("no interval: "), "undefined", F.lit(f" of {params.n_bootstrap} replicates have no value"))).otherwise(F.col("detail"))
    ).withColumn("ci_lower", F.when(has_value, F.col("ci_lower"))).withColumn(
        "ci_upper", F.when(has_value, F.col("ci_upper"))
    ).withColumn("low_ess", F.col("effective_sample_size") < LOW_ESS_SHARE * F.col("n_samples"))
    if "exact" not in params.estimators:
        out = out.withColumn("exact_rounds_scored", F.lit(None).cast("long")).withColumn(
            "exact_rounds_masked", F.lit(None).cast("long"))
    extra = {"dataset": None, "state_source": None, "cate_reward_weight": 0.0, "evaluation_regime": "unspecified",
             "propensity_source": "unspecified", **(provenance or {})}
    for key, value in extra.items():
        out = out.withColumn(key, F.lit(value))
    return out.select(
        "agent", "dataset", "state_source", "cate_reward_weight", F.lit(seed).cast("long").alias("seed"),
        F.col("n_samples").alias("n_test_rounds"), "estimator", "value", "ci_lower", "ci_upper", "n_samples",
        "effective_sample_size", "low_ess", "status", "detail", F.array_join("warnings", ";").alias("warnings"),
        F.lit(ev.unit).alias("resampling_unit"), "n_independent_units",
        F.lit(method).alias("bootstrap_method"), F.lit(params.n_bootstrap).alias("n_bootstrap"),
        F.lit(params.confidence_level).alias("confidence_level"), "propensity_source",
        F.lit(ev.q_label).alias("q_model"), "evaluation_regime",
        F.lit(ev.n_contexts).alias("n_distinct_contexts"), "exact_rounds_scored", "exact_rounds_masked",
    )
