"""Queries on policies, off-policy evaluation and reference policies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterfold.functions.hashing import hash32_sql
from counterfold.functions.rows import one_row
from counterfold.operators import bootstrap, checks, ope, policies, propensity, reference, reward_model
from counterfold.operators.splits import context_folds
from counterfold.params import EvaluationParams
from counterfold.plans.queries_data import SEED, event_parts, n_events_actions
from counterfold.plans.registry import (
    BLOCK, EVENT_ROUNDS, EVENT_SPLIT, GREEDY, LINE_ROUNDS, ctes, query, r9, rounded,
)
from counterfold.session import durable
from counterfold.sources.tables import event_rounds, line_rounds, order_rows, table, user_contexts

_ENUM = ctes(EVENT_SPLIT, GREEDY)


def event_train_test(spark: SparkSession, sf_dir: str, rounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rounds, and later rounds weighted by their own action shares."""
    rounds = event_parts(spark, sf_dir) if rounds is None else rounds
    scored = propensity.enumerated_propensities(rounds.filter("part <> 'train'"), ["round_id"])
    # evaluation scans the rounds several times: written once, as a prepared dataset is
    return rounds.filter("part = 'train'"), durable(scored)


def event_policies(rounds: DataFrame, train: DataFrame) -> DataFrame:
    """``greedy_mean`` and the most popular action, for every context."""
    popular = policies.popularity_constants(train).filter("rule = 'most_interactions'").select("action")
    everywhere = rounds.select("context_id").distinct().join(F.broadcast(popular), F.lit(True))  # one row
    named = lambda df, name: df.select(F.lit(name).alias("agent"), "context_id", "action", F.lit(1.0).alias("prob"))
    return named(policies.greedy_mean(train), "greedy_mean").unionByName(named(everywhere, "popular"))


def event_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole state vector of every context of ``events``."""
    return user_contexts(spark, sf_dir).select(
        F.col("user_idx").alias("context_id"), F.transform("embedding", lambda x: x.cast("double")).alias("context"))


def buckets_of(contexts: DataFrame) -> DataFrame:
    """Four coarse inputs, by the signs of the first two entries of the state."""
    sign = lambda i: (F.col("context")[i] > 0).cast("long")
    return contexts.select("context_id", (2 * sign(0) + sign(1)).alias("bucket"))


def customer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the block's contexts: a customer's balance, nation and segment."""
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("context_id"), F.array(
        F.col("c_acctbal") / 10000.0, F.col("c_nationkey") / 25.0,
        *[(F.col("c_mktsegment") == s).cast("double") for s in segments]).alias("context"))


def block_rounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Block rows, the deduplicated block, and its cells as evaluation rounds."""
    rows = order_rows(spark, sf_dir)
    block = ope.last_write(rows)
    rounds = propensity.enumerated_propensities(block).select(
        F.col("row_seq").alias("round_id"), "user_idx", F.col("user_idx").alias("context_id"), "action", "reward",
        "propensity")
    return rows, block, rounds


def block_policy(block: DataFrame) -> DataFrame:
    """Each user gets the action after the one they ordered first: often unobserved."""
    first = block.groupBy(F.col("user_idx").alias("context_id")).agg(F.min_by("action", "row_seq").alias("a"))
    return first.select("context_id", ((F.col("a") + 1) % 5).alias("action"), F.lit(1.0).alias("prob"))


_BLOCK_POLICY = """bpol AS (SELECT context_id, (a + 1) % 5 AS action, 1.0::DOUBLE AS prob FROM
  (SELECT user_idx AS context_id, arg_min(action, row_seq) AS a FROM block GROUP BY user_idx))"""

# ------------------------------------------------------------------ policies


@query("POL1", "D12", sql=ctes(EVENT_ROUNDS) + "SELECT DISTINCT context_id, round(1.0::DOUBLE / (SELECT count(*) FROM acts), 9) AS prob FROM ev")
def uniform_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform policy is a constant; it needs no (context, action) table."""
    contexts = event_rounds(spark, sf_dir).select("context_id").distinct()
    return contexts.withColumn("prob", r9(F.lit(1.0 / n_events_actions(spark, sf_dir))))


@query("POL4", "WIN4", "D11", sql=_ENUM + "SELECT context_id, action, prob FROM greedy")
def greedy_mean_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.greedy_mean(event_train_test(spark, sf_dir)[0])


_SUPPORT = """bu AS (SELECT user_idx, count(*) AS n_user FROM train GROUP BY ALL),
bm AS (SELECT a.action, (coalesce(n, 0) + 1.0::DOUBLE) / ((SELECT count(*) FROM train) + (SELECT count(*) FROM acts)) AS marginal
  FROM acts a LEFT JOIN (SELECT action, count(*) AS n FROM train GROUP BY ALL) USING (action)),
mq AS (SELECT g.context_id, g.action, g.n, g.q, (g.n + 10 * m.marginal) / (u.n_user + 10) AS p,
  10 * (SELECT max(marginal) FROM bm) / (u.n_user + 10) AS floor_p
  FROM gq g JOIN bm m USING (action) JOIN bu u ON u.user_idx = g.context_id),
sup AS (SELECT *, p / greatest(max(p) OVER (PARTITION BY context_id), floor_p) AS support FROM mq)"""


@query("POL5", sql=ctes(EVENT_SPLIT, GREEDY, _SUPPORT) + """
SELECT context_id, action, round(support, 9) AS support, round(q, 9) AS q FROM sup WHERE support >= 0.9""")
def supported_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = event_train_test(spark, sf_dir)
    behaviour = propensity.fit_behaviour_policy(train, n_events_actions(spark, sf_dir))
    out = policies.supported_actions(train, behaviour, 0.9)
    return rounded(out.select("context_id", "action", "support", "q"), "support", "q")


@query("POL5", sql=ctes(EVENT_SPLIT, GREEDY, _SUPPORT) + """
SELECT context_id, action, 1.0::DOUBLE AS prob FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY q DESC, action) AS k
  FROM sup WHERE support >= 0.3) WHERE k = 1""")
def greedy_supported_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = event_train_test(spark, sf_dir)
    behaviour = propensity.fit_behaviour_policy(train, n_events_actions(spark, sf_dir))
    return policies.greedy_supported(train, behaviour)


# Between two neighbouring action values the expectile equation is linear, so each stretch has one root; the one that lies in its stretch holds.
_EXPECTILE = """ex AS (SELECT context_id, q, sum(n) AS n, sum(n * q) AS nq FROM gq GROUP BY context_id, q),
es AS (SELECT context_id, q, sum(n) OVER a AS below, sum(nq) OVER a AS below_q, sum(n) OVER w - sum(n) OVER a AS above, sum(nq) OVER w - sum(nq) OVER a AS above_q,
    lead(q) OVER (PARTITION BY context_id ORDER BY q) AS next_q FROM ex
  WINDOW a AS (PARTITION BY context_id ORDER BY q ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY context_id)),
er AS (SELECT context_id, q, next_q, (0.3::DOUBLE * below_q + 0.7::DOUBLE * above_q) / (0.3::DOUBLE * below + 0.7::DOUBLE * above) AS v FROM es),
ev2 AS (SELECT context_id, min(CASE WHEN next_q IS NULL OR v <= next_q THEN greatest(v, q) END) AS v FROM er GROUP BY context_id)"""


@query("POL6", sql=ctes(EVENT_SPLIT, GREEDY, _EXPECTILE) + """, a AS (SELECT gq.*, v, n * least(exp(3.0 * (q - v)), 100.0) AS w FROM gq JOIN ev2 USING (context_id))
SELECT context_id, action, round(w / sum(w) OVER (PARTITION BY context_id), 9) AS prob, round(v, 9) AS v, true AS solved FROM a""")
def advantage_weighted_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advantage-weighted shares around the expectile, which solves its equation to the last digits."""
    train, _ = event_train_test(spark, sf_dir)
    out = policies.advantage_weighted(train).join(policies.action_values(train).select("context_id", "action", "n"), ["context_id", "action"])
    tilt = F.when(F.col("q") > F.col("v"), 0.7).otherwise(0.3)
    every = Window.partitionBy("context_id")
    residual = F.abs(F.sum(tilt * F.col("n") * (F.col("q") - F.col("v"))).over(every)) / F.sum("n").over(every)
    return rounded(out.select("context_id", "action", "prob", "v", (residual < 1e-12).alias("solved")), "prob", "v")


@query("POL7", "WIN5", sql=_ENUM + """
SELECT context_id, action, round(exp(q - m) / sum(exp(q - m)) OVER (PARTITION BY context_id), 9) AS prob
FROM (SELECT *, max(q) OVER (PARTITION BY context_id) AS m FROM gq)""")
def softmax_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = policies.action_values(event_train_test(spark, sf_dir)[0])
    return rounded(policies.softmax_policy(values, "q"), "prob")


@query("POL9", "POL7", sql=_ENUM + """
SELECT context_id, action FROM (SELECT context_id, action, row_number() OVER (PARTITION BY context_id ORDER BY n DESC, action) AS k FROM gq) WHERE k = 1""")
def action_of_stochastic_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = policies.action_values(event_train_test(spark, sf_dir)[0])
    return policies.policy_actions(values.withColumn("prob", F.col("n").cast("double")))


@query("POL8", sql=ctes(LINE_ROUNDS) + """, s AS (SELECT action, count(*) AS n, avg(reward) AS rate FROM ln GROUP BY action)
SELECT 'most_interactions' AS rule, action, n AS log_interactions, round(rate, 9) AS log_reward_rate FROM (SELECT * FROM s ORDER BY n DESC, action LIMIT 1)
UNION ALL SELECT 'highest_logged_reward_rate', action, n, round(rate, 9) FROM (SELECT * FROM s
  WHERE n >= 100 OR (SELECT max(n) FROM s) < 100 ORDER BY rate DESC, action LIMIT 1)""")
def popularity_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policies.popularity_constants(line_rounds(spark, sf_dir)), "log_reward_rate")


_ARMS = """, x AS MATERIALIZED (SELECT action, context_id, count(*) AS n, sum(reward) AS r FROM train GROUP BY ALL), d AS (SELECT unnest(range(1, 65)) AS i),
p AS (SELECT action, a.i, b.i AS j, sum(n * embedding[a.i]::DOUBLE * embedding[b.i]) AS xx FROM x JOIN embeddings ON vec_id = context_id, d a, d b GROUP BY ALL)"""


def _event_states(spark: SparkSession, sf_dir: str, dim: int) -> tuple[DataFrame, DataFrame]:
    states = user_contexts(spark, sf_dir).select(
        F.col("user_idx").alias("context_id"),
        F.transform(F.slice("embedding", 1, dim), lambda x: x.cast("double")).alias("context"))
    return event_train_test(spark, sf_dir)[0], states


@query("POL2", sql=ctes(EVENT_SPLIT) + _ARMS[0:] + """
SELECT action, i * 64 + j - 65 AS position, round(xx, 5) AS xx FROM p""")
def linear_arm_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, states = _event_states(spark, sf_dir, 64)
    stats = policies.linucb_statistics(train.join(states, "context_id"), 64)
    return stats.select("action", F.posexplode("xx").alias("position", "xx")).select(
        "action", F.col("position").cast("long").alias("position"), r9("xx", 5).alias("xx"))


@query("POL2", "POL3")
def linear_bandit_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-confidence-bound arm per context, fitted on 64 state entries."""
    train, states = _event_states(spark, sf_dir, 64)
    n_actions = n_events_actions(spark, sf_dir)
    arms = policies.linucb_arms(policies.linucb_statistics(train.join(states, "context_id"), 64), n_actions, 64)
    contexts = states.join(train.select("context_id").distinct(), "context_id", "left_semi")
    return rounded(policies.linucb_decide(contexts, arms, n_actions, 64), "score", digits=6)


# ------------------------------------------------------------------ weighted estimators

_WEIGHTS = """, w AS (SELECT e.agent, t.*, coalesce(p.prob, 0) / greatest(t.propensity, 1e-12) AS w, coalesce(p.prob, 0) AS pi FROM
  (SELECT DISTINCT agent FROM everyone) e CROSS JOIN test t LEFT JOIN everyone p ON p.agent = e.agent AND p.context_id = t.context_id AND p.action = t.action)"""


def _unit_stats(spark: SparkSession, sf_dir: str, *estimators: str) -> ope.Evaluation:
    rounds = event_parts(spark, sf_dir)
    train, test = event_train_test(spark, sf_dir, rounds)
    return ope.prepare_evaluation(
        test, event_policies(rounds, train), n_events_actions(spark, sf_dir), EvaluationParams(estimators=estimators),
        uniform=("random",), contexts=event_contexts(spark, sf_dir))


@query("OPE1", "JOIN8", sql=ctes(EVENT_SPLIT, GREEDY) + _WEIGHTS + "SELECT round_id, round(w, 9) AS weight FROM w WHERE agent = 'greedy_mean'")
def importance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = event_train_test(spark, sf_dir)
    greedy = policies.greedy_mean(train)
    joined = test.join(greedy, ["context_id", "action"], "left")
    return joined.select("round_id", r9(ope.importance_weight(F.coalesce("prob", F.lit(0.0)))).alias("weight"))


@query("OPE8", sql=ctes(EVENT_SPLIT, GREEDY) + _WEIGHTS + """
SELECT round_id, round(pi * (1 - propensity) / greatest(propensity * propensity, 1e-12), 9) AS weight FROM w WHERE agent = 'greedy_mean'""")
def variance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = event_train_test(spark, sf_dir)
    joined = test.join(policies.greedy_mean(train), ["context_id", "action"], "left")
    return joined.select("round_id", r9(ope.mrdr_weight(F.coalesce("prob", F.lit(0.0)))).alias("weight"))


@query("OPE1", "OPE2", "OPE3", "OPE4", sql=ctes(EVENT_SPLIT, GREEDY) + _WEIGHTS + """
SELECT agent, count(*) AS n_samples, round(sum(w * reward) / count(*), 9) AS ipw, round(sum(w * reward) / sum(w), 9) AS snipw,
  round(sum(w) * sum(w) / sum(w * w), 6) AS effective_sample_size FROM w GROUP BY agent""")
def weighted_policy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPW, SNIPW and effective sample size of three policies on held-out rounds."""
    rounds = event_parts(spark, sf_dir)
    train, test = event_train_test(spark, sf_dir, rounds)
    cells = ope.logged_cells(test, ("context_id", "action"))
    pols = event_policies(rounds, train)
    n_actions = n_events_actions(spark, sf_dir)
    mine = cells.join(pols, ["context_id", "action"]).select(*cells.columns, "agent", "prob").unionByName(
        cells.select("*", F.lit("random").alias("agent"), F.lit(1.0 / n_actions).alias("prob")))
    p = F.col("prob")
    sums = mine.groupBy("agent").agg(F.sum(p * F.col("inv")).alias("w"), F.sum(p * p * F.col("inv2")).alias("w2"),
                                     F.sum(p * F.col("rinv")).alias("wr"))
    total = cells.agg(F.sum("n").alias("n"))
    return sums.join(one_row(total), F.lit(True)).select(
        "agent", F.col("n").alias("n_samples"), r9(ope.ipw_value()).alias("ipw"), r9(ope.snipw_value()).alias("snipw"),
        r9(ope.kish_ess(), 6).alias("effective_sample_size"))


@query("OPE15", "OPE16", sql=ctes(EVENT_SPLIT, BLOCK) + """, e AS (SELECT 'events' AS source, count(*) AS n_rounds,
  count(DISTINCT concat_ws('|', context_id, action)) AS n_cells, count(DISTINCT context_id) AS n_contexts FROM test
UNION ALL SELECT 'block', count(*), count(*), count(DISTINCT user_idx) FROM block)
SELECT *, round(n_rounds / n_cells::DOUBLE, 9) AS rounds_per_cell, CASE WHEN n_contexts = n_rounds THEN 'round'
  WHEN n_rounds / n_cells::DOUBLE < 1.5 THEN 'context' ELSE 'round' END AS unit FROM e""")
def independent_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test = event_train_test(spark, sf_dir)
    _, _, rounds = block_rounds(spark, sf_dir)
    out = ope.independent_unit(test).withColumn("source", F.lit("events")).unionByName(
        ope.independent_unit(rounds).withColumn("source", F.lit("block")))
    return rounded(out, "rounds_per_cell")


@query("OPE14", "D16", sql=ctes(EVENT_ROUNDS) + """, c AS (SELECT round_id, feature, t // 86400000000 % 7 AS day FROM ev)
SELECT feature AS f0, day::DOUBLE AS f1, min(round_id) AS rep, count(*) AS n_rounds, row_number() OVER (ORDER BY min(round_id)) - 1 AS context_id
FROM c GROUP BY feature, day""")
def contexts_by_identical_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("t") / 86400000000).cast("long") % 7
    rounds = event_rounds(spark, sf_dir).withColumn("context", F.array(F.col("feature"), day.cast("double")))
    out = ope.group_contexts(rounds)
    return out.select(F.col("context")[0].alias("f0"), F.col("context")[1].alias("f1"), "rep", "n_rounds", "context_id")


# ------------------------------------------------------------------ reward models

_FOLDS = f"""rf AS (SELECT *, CASE WHEN rk < (n % 5) * (n // 5 + 1) THEN rk // (n // 5 + 1)
    ELSE n % 5 + (rk - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM
  (SELECT *, row_number() OVER (ORDER BY {hash32_sql(SEED, 'round_id')}, round_id) - 1 AS rk, count(*) OVER () AS n FROM test)),
folds AS (SELECT unnest(range(5)) AS fold),
emb AS (SELECT vec_id AS context_id, CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS bucket FROM embeddings),
rb AS (SELECT rf.*, bucket FROM rf JOIN emb USING (context_id)), bk AS (SELECT DISTINCT bucket FROM rb)"""

_Q = """, g AS (SELECT f.fold, sum(reward) / count(*) AS g FROM rf, folds f WHERE rf.fold <> f.fold GROUP BY f.fold),
qa AS (SELECT f.fold, a.action, (coalesce(sum(reward) FILTER (rf.fold <> f.fold), 0) + 10 * any_value(g)) / (count(rf.round_id) FILTER (rf.fold <> f.fold) + 10) AS m
  FROM folds f CROSS JOIN acts a JOIN g USING (fold) LEFT JOIN rf ON rf.action = a.action GROUP BY f.fold, a.action),
q AS (SELECT f.fold, b.bucket, a.action, (coalesce(sum(reward) FILTER (rb.fold <> f.fold), 0) + 10 * any_value(m)) / (count(rb.round_id) FILTER (rb.fold <> f.fold) + 10) AS q
  FROM folds f CROSS JOIN bk b CROSS JOIN acts a JOIN qa ON qa.fold = f.fold AND qa.action = a.action
  LEFT JOIN rb ON rb.action = a.action AND rb.bucket = b.bucket GROUP BY f.fold, b.bucket, a.action)"""


def linear_sql(cells: str, states: str = "SELECT vec_id AS context_id, list_prepend(1.0::DOUBLE, list_transform(embedding, lambda v: v::DOUBLE)) AS x FROM embeddings") -> str:
    """Ridge regressions per (ag, fold, action) on all but the fold, solved by elimination.

    ``cells`` selects (ag, context_id, fold, action, w, s). Gives lth (ag, fold, action, theta)
    and lmu (ag, fold, mu).
    """
    return f"""lc AS MATERIALIZED ({cells}), lst AS MATERIALIZED ({states}),
ld AS MATERIALIZED (SELECT unnest(range(1, (SELECT len(any_value(x)) + 1 FROM lst))) AS i),
lxx AS MATERIALIZED (SELECT ag, fold, action, a.i, b.i AS j, sum(w * x[a.i] * x[b.i]) AS v FROM lc JOIN lst USING (context_id), ld a, ld b GROUP BY ALL),
lxs AS MATERIALIZED (SELECT ag, fold, action, i, sum(s * x[i]) AS v FROM lc JOIN lst USING (context_id), ld GROUP BY ALL),
lmu AS MATERIALIZED (SELECT ag, f.fold, sum(s) / sum(w) AS mu FROM lc, folds f WHERE lc.fold <> f.fold GROUP BY ALL),
lrow AS (SELECT a.ag, f.fold, a.action, a.i, a.j, sum(a.v) + CASE WHEN a.i = a.j THEN 1.0 ELSE 0.0 END AS v
  FROM lxx a, folds f WHERE a.fold <> f.fold GROUP BY a.ag, f.fold, a.action, a.i, a.j),
lrhs AS (SELECT b.ag, f.fold, b.action, b.i, sum(b.v) AS v FROM lxs b, folds f WHERE b.fold <> f.fold GROUP BY ALL),
lone AS (SELECT a.ag, f.fold, a.action, a.i, sum(a.v) AS v FROM lxx a, folds f WHERE a.fold <> f.fold AND a.j = 1 GROUP BY ALL),
lsys AS MATERIALIZED (SELECT ag, fold, action, i, list_append(list(lrow.v ORDER BY j), any_value(lrhs.v - mu * lone.v)) AS r
  FROM lrow JOIN lrhs USING (ag, fold, action, i) JOIN lone USING (ag, fold, action, i) JOIN lmu USING (ag, fold) GROUP BY ag, fold, action, i),
lgj AS (SELECT ag, fold, action, 1 AS k, list(r ORDER BY i) AS m FROM lsys GROUP BY ALL
  UNION ALL SELECT ag, fold, action, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN piv ELSE list_transform(r, lambda v, j: v - r[k] * piv[j]) END)
  FROM (SELECT *, list_transform(m[k], lambda v: v / m[k][k]) AS piv FROM lgj WHERE k <= len(m))),
lth AS MATERIALIZED (SELECT ag, fold, action, list_transform(m, lambda r: r[len(m) + 1]) AS theta FROM lgj WHERE k = len(m) + 1)"""


@query("OPE12", "SPL6", "JOIN9", "D14", sql=ctes(EVENT_SPLIT, _FOLDS) + _Q + "SELECT fold::INT || '|' || bucket AS model_key, action, round(q, 9) AS q FROM q")
def tabular_reward_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward model fitted outside each fold, once per model input and action."""
    _, test = event_train_test(spark, sf_dir)
    test = durable(test.select("round_id", "context_id", "action", "reward", "propensity"))
    folded = context_folds(test, 5, SEED, key="round_id")
    model = reward_model.tabular_reward_model(
        ope.logged_cells(folded), buckets_of(event_contexts(spark, sf_dir)), n_events_actions(spark, sf_dir), 5)
    return rounded(model.table, "q")


@query("OPE13", sql=ctes(EVENT_SPLIT) + """, tb AS (SELECT test.*, CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS bucket
  FROM test JOIN embeddings ON vec_id = context_id), g AS (SELECT avg(reward) AS g FROM test),
qa AS (SELECT action, (coalesce(sum(reward), 0) + 10 * any_value(g)) / (count(round_id) + 10) AS m FROM acts CROSS JOIN g LEFT JOIN test USING (action) GROUP BY action)
SELECT '0|' || (b.bucket) AS model_key, qa.action, round((coalesce(sum(reward), 0) + 10 * any_value(m)) / (count(round_id) + 10), 9) AS q
FROM qa CROSS JOIN (SELECT DISTINCT bucket FROM tb) b LEFT JOIN tb t ON t.action = qa.action AND t.bucket = b.bucket GROUP BY ALL""")
def in_sample_reward_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test = event_train_test(spark, sf_dir)
    cells = ope.logged_cells(test.withColumn("fold", F.lit(0)))
    model = reward_model.tabular_reward_model(
        cells, buckets_of(event_contexts(spark, sf_dir)), n_events_actions(spark, sf_dir), 1, in_sample=True)
    return rounded(model.table, "q")


@query("OPE12", "OPE13", sql="WITH RECURSIVE " + ",\n".join([EVENT_SPLIT, _FOLDS, linear_sql(
    "SELECT 'all' AS ag, context_id, fold, action, count(*)::DOUBLE AS w, sum(reward) AS s FROM rf GROUP BY ALL")]) + """
SELECT fold::INT AS fold, lth.action, round(mu, 9) AS mean, context_id, round(mu + list_dot_product(theta, x), 7) AS q
FROM lth JOIN lmu USING (ag, fold), lst WHERE context_id IN (SELECT context_id FROM test)""")
def linear_reward_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-fitted ridge regression per arm on the whole state, read at every context."""
    _, test = event_train_test(spark, sf_dir)
    test = durable(test.select("round_id", "context_id", "action", "reward", "propensity"))
    n_actions, contexts = n_events_actions(spark, sf_dir), event_contexts(spark, sf_dir)
    cells = ope.logged_cells(context_folds(test, 5, SEED, key="round_id"))
    model = ope.reward_model_fit(n_actions, 5, contexts=contexts)(cells).written()
    probe = test.select("context_id").distinct().join(model.arms.select("fold", "action"), F.lit(True))  # folds x arms, read at each context
    out = model.q_at(probe).join(model.means.select("fold", "mean"), "fold")
    return rounded(rounded(out.select("fold", "action", "mean", "context_id", "q"), "mean"), "q", digits=7)


@query("OPE12")
def boosted_reward_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the whole state and the action, five folds."""
    _, test = event_train_test(spark, sf_dir)
    folded = test.join(context_folds(test.select("context_id").distinct(), 5, SEED), "context_id")
    cells = durable(ope.logged_cells(folded))
    model = reward_model.boosted_reward_model(
        cells, event_contexts(spark, sf_dir), n_events_actions(spark, sf_dir), 5, SEED, iterations=20, depth=5)
    return rounded(model.table, "q", digits=6)


_LINEAR = linear_sql("SELECT 'all' AS ag, context_id, fold, action, count(*)::DOUBLE AS w, sum(reward) AS s FROM rf GROUP BY ALL")


@query("OPE5", "OPE6", "OPE7", "JOIN10", sql="WITH RECURSIVE " + ",\n".join([EVENT_SPLIT, GREEDY, _FOLDS, _LINEAR]) + _WEIGHTS.replace("test t", "rf t") + """,
q AS (SELECT c.context_id, f.fold, a.action, mu + coalesce(list_dot_product(theta, x), 0) AS q FROM (SELECT DISTINCT context_id FROM rf) c JOIN lst USING (context_id)
  CROSS JOIN folds f CROSS JOIN acts a JOIN lmu ON lmu.fold = f.fold LEFT JOIN lth ON lth.fold = f.fold AND lth.action = a.action),
eq AS (SELECT p.agent, p.context_id, q.fold, sum(prob * q) AS eq FROM everyone p JOIN q ON q.context_id = p.context_id AND q.action = p.action GROUP BY ALL)
SELECT w.agent, round(avg(eq), 7) AS dm, round(avg(eq + w * (reward - q)), 7) AS dr FROM w
  JOIN eq ON eq.agent = w.agent AND eq.context_id = w.context_id AND eq.fold = w.fold
  JOIN q ON q.fold = w.fold AND q.context_id = w.context_id AND q.action = w.action GROUP BY w.agent""")
def direct_and_doubly_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM and DR on a cross-fitted linear reward model of the whole state."""
    ev = _unit_stats(spark, sf_dir, "dm", "dr")
    points = ope.estimate(ev, EvaluationParams(estimators=("dm", "dr")))
    return rounded(points.groupBy("agent").pivot("estimator", ["dm", "dr"]).agg(F.first("value")), "dm", "dr", digits=7)


# the supported rounds of an agent, in the order of a hash of the first round like them, are dealt to the folds in turn
_MRDR = f"""mw0 AS (SELECT *, mw > 0 AS s, min(round_id) OVER (PARTITION BY agent, context_id, fold, action, reward, propensity) AS rep FROM
    (SELECT *, pi * (1 - propensity) / greatest(propensity * propensity, 1e-12) AS mw FROM w)),
mr AS (SELECT agent, round_id, (row_number() OVER (PARTITION BY agent ORDER BY {hash32_sql(SEED, 'rep')}, rep, round_id) - 1) % 5 AS dealt FROM mw0 WHERE s),
mf AS MATERIALIZED (SELECT mw0.*, coalesce(dealt, fold) AS mfold FROM mw0 LEFT JOIN mr USING (agent, round_id)),
""" + linear_sql("SELECT agent AS ag, context_id, mfold AS fold, action, sum(mw) AS w, sum(mw * reward) AS s FROM mf WHERE pi > 0 GROUP BY ALL") + """,
mq AS (SELECT c.ag AS agent, c.context_id, f.fold, a.action, mu + coalesce(list_dot_product(theta, x), 0) AS q
  FROM (SELECT DISTINCT agent AS ag, context_id FROM mf) c JOIN lst USING (context_id) CROSS JOIN folds f CROSS JOIN acts a
  JOIN lmu ON lmu.fold = f.fold AND lmu.ag = c.ag LEFT JOIN lth ON lth.ag = c.ag AND lth.fold = f.fold AND lth.action = a.action),
me AS (SELECT p.agent, p.context_id, mq.fold, sum(prob * q) AS eq FROM everyone p
  JOIN mq ON mq.agent = p.agent AND mq.context_id = p.context_id AND mq.action = p.action GROUP BY ALL)"""


@query("OPE9", "SPL7", sql="WITH RECURSIVE " + ",\n".join([EVENT_SPLIT, GREEDY, _FOLDS]) + _WEIGHTS.replace("test t", "rf t") + ",\n" + _MRDR + """
SELECT mf.agent, round(avg(eq + w * (reward - coalesce(q, 0))), 7) AS mrdr FROM mf
  JOIN me ON me.agent = mf.agent AND me.context_id = mf.context_id AND me.fold = mfold
  LEFT JOIN mq ON mq.agent = mf.agent AND mq.fold = mfold AND mq.context_id = mf.context_id AND mq.action = mf.action GROUP BY mf.agent""")
def more_robust_doubly_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear reward model refitted per policy under variance weights."""
    ev = _unit_stats(spark, sf_dir, "mrdr")
    points = ope.estimate(ev, EvaluationParams(estimators=("mrdr",)))
    return points.select("agent", r9("value", 7).alias("mrdr"))


# ------------------------------------------------------------------ exact values


@query("OPE10", "OPE11", "D15", sql=ctes(BLOCK, _BLOCK_POLICY) + """
SELECT round(sum(reward * n_rounds) / sum(n_rounds) FILTER (reward IS NOT NULL), 9) AS exact_value,
  CAST(coalesce(sum(n_rounds) FILTER (reward IS NOT NULL), 0) AS BIGINT) AS rounds_scored,
  CAST(coalesce(sum(n_rounds) FILTER (reward IS NULL), 0) AS BIGINT) AS rounds_masked
FROM weights JOIN bpol USING (context_id) LEFT JOIN block ON user_idx = context_id AND block.action = bpol.action""")
def exact_deterministic_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, block, rounds = block_rounds(spark, sf_dir)
    values = ope.exact_context_values(block_policy(block), block)
    return rounded(ope.exact_value(reference.context_weights(rounds), values), "exact_value")


@query("OPE10", sql=ctes(BLOCK) + """, u AS (SELECT user_idx AS context_id, avg(reward) AS value FROM block GROUP BY user_idx)
SELECT round(sum(value * n_rounds) / sum(n_rounds), 9) AS exact_value, CAST(sum(n_rounds) AS BIGINT) AS rounds_scored, 0::BIGINT AS rounds_masked
FROM weights JOIN u USING (context_id)""")
def exact_uniform_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform play is renormalised over the observed cells."""
    _, block, rounds = block_rounds(spark, sf_dir)
    return rounded(ope.exact_value(reference.context_weights(rounds), ope.exact_uniform_values(block)), "exact_value")


@query("OPE10", "D13", sql=ctes(BLOCK) + """, s AS (SELECT user_idx AS context_id, sum(0.2::DOUBLE * reward) AS value FROM block GROUP BY user_idx)
SELECT round(sum(value * n_rounds) / sum(n_rounds), 9) AS exact_value, CAST(sum(n_rounds) AS BIGINT) AS rounds_scored, 0::BIGINT AS rounds_masked
FROM weights JOIN s USING (context_id)""")
def exact_stochastic_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written-out distribution is summed as it is: missing mass is dropped."""
    _, block, rounds = block_rounds(spark, sf_dir)
    spread = block.select(F.col("user_idx").alias("context_id")).distinct().select(
        "context_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("action"), F.lit(0.2).alias("prob"))
    values = ope.exact_context_values(spread, block)
    return rounded(ope.exact_value(reference.context_weights(rounds), values), "exact_value")


@query("OPE21", sql=ctes(BLOCK) + """, p AS (SELECT user_idx, count(*) AS k FROM block GROUP BY user_idx), v AS (SELECT user_idx, count(*) AS n FROM bl GROUP BY user_idx)
SELECT CAST(sum(n * 5) AS BIGINT) AS cells_consulted, CAST(sum(n * k) AS BIGINT) AS cells_observed, (SELECT count(*) FROM bl) AS block_rows,
  (SELECT count(*) FROM block) AS cells, (SELECT count(*) FROM bl) - (SELECT count(*) FROM block) AS duplicate_rows,
  round(sum(n * k) / sum(n * 5)::DOUBLE, 9) AS coverage FROM v JOIN p USING (user_idx)""")
def ground_truth_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_rows(spark, sf_dir)
    return rounded(ope.block_coverage(rows, rows, 5), "coverage")


# ------------------------------------------------------------------ intervals

def _interval_checks(
    ev: ope.Evaluation, points: DataFrame, sums: list[str], value, method: str = "percentile", ends: bool = False
) -> DataFrame:
    """Replicates against what is known of them: their number, centre and spread, and the interval around the estimate.

    With ``ends`` the interval, centre and spread themselves are results too.
    """
    reps, method, n_units = bootstrap.replicate_sums(ev.unit_stats, sums, 100, SEED, method=method)
    reps = durable(reps)
    interval = bootstrap.percentile_interval(reps, value, 0.95)
    spread = reps.withColumn("v", value).groupBy("agent").agg(
        F.count("*").alias("n_replicates"), F.avg("v").alias("centre"), F.stddev_samp("v").alias("spread"))
    out = points.join(interval, "agent").join(spread, "agent")
    return out.select(
        "agent", r9("value").alias("value"), F.lit(n_units).cast("long").alias("n_units"), "n_replicates",
        F.col("value").between(F.col("ci_lower"), F.col("ci_upper")).alias("inside"),
        # 100 replicates tell a standard error to within a few tenths, and their mean to a few tenths of it
        F.col("spread").between(F.col("se") * 0.7, F.col("se") * 1.4).alias("spread_fits"),
        (F.abs(F.col("centre") - F.col("value")) < 0.4 * F.col("se")).alias("centre_fits"), F.lit(method).alias("method"),
        *[r9(c).alias(c) for c in ("ci_lower", "ci_upper", "centre", "spread") if ends])


def _ratio_errors(ev: ope.Evaluation, top: str, bottom: str) -> DataFrame:
    """A ratio of sums per agent with its standard error over units, by linearisation."""
    rows = ev.unit_stats.select("agent", F.col(top).alias("a"), F.col(bottom).alias("b"), "mult")
    value = rows.groupBy("agent").agg((F.sum("a") / F.sum("b")).alias("value"), F.sum("b").alias("sb"))
    return rows.join(value, "agent").groupBy("agent", "value").agg(
        (F.sqrt(F.sum((F.col("a") - F.col("value") * F.col("b")) ** 2 / F.col("mult"))) / F.first("sb")).alias("se"))


# draws, replicates rp (agent, rep, v) and estimates pt (agent, value, n_units, se), of un (unit, id) and st (agent, id, a, b)
_REPLICATES = bootstrap.drawn_sql(SEED, 100) + """,
rp AS MATERIALIZED (SELECT agent, rep, CASE WHEN sum(b) > 1e-12 THEN sum(a) / sum(b) END AS v FROM dr JOIN st USING (id) GROUP BY ALL),
pv AS (SELECT agent, sum(a) / sum(b) AS value, count(*) AS n_units, sum(b) AS sb FROM st GROUP BY agent),
pt AS (SELECT agent, value, n_units, sqrt(sum((a - value * b) ** 2)) / sb AS se FROM st JOIN pv USING (agent) GROUP BY agent, value, n_units, sb),
iv AS (SELECT agent, count(*) AS n_replicates, avg(v) AS centre, stddev_samp(v) AS spread,
  CASE WHEN count(v) = count(*) THEN quantile_cont(v, 0.025) END AS ci_lower, CASE WHEN count(v) = count(*) THEN quantile_cont(v, 0.975) END AS ci_upper FROM rp GROUP BY agent)
SELECT agent, round(value, 9) AS value, n_units, n_replicates, value BETWEEN ci_lower AND ci_upper AS inside, spread BETWEEN se * 0.7::DOUBLE AND se * 1.4::DOUBLE AS spread_fits,
  abs(centre - value) < 0.4::DOUBLE * se AS centre_fits, 'percentile' AS method, round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper,
  round(centre, 9) AS centre, round(spread, 9) AS spread FROM pt JOIN iv USING (agent)"""


@query("OPE17", "WIN6", sql=ctes(EVENT_SPLIT, GREEDY) + _WEIGHTS + """, un AS MATERIALIZED (SELECT round_id AS id,
  (min(round_id) OVER (PARTITION BY context_id, action, reward, propensity)) || '|0' AS unit FROM test),
st AS MATERIALIZED (SELECT agent, round_id AS id, w * reward AS a, w AS b FROM w),
""" + _REPLICATES)
def bootstrap_over_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds drawn with replacement: 100 replicates and their interval."""
    ev = _unit_stats(spark, sf_dir, "snipw")
    return _interval_checks(ev, _ratio_errors(ev, "wr", "w"), ["w", "wr"], ope.snipw_value(), ends=True)


@query("OPE18", "D17", sql=ctes(BLOCK, _BLOCK_POLICY) + """, un AS MATERIALIZED (SELECT context_id AS id, context_id::VARCHAR AS unit FROM weights),
st AS MATERIALIZED (SELECT 'next_action' AS agent, context_id AS id, coalesce(reward * n_rounds, 0)::DOUBLE AS a, CASE WHEN reward IS NULL THEN 0 ELSE n_rounds END::DOUBLE AS b
  FROM weights JOIN bpol USING (context_id) LEFT JOIN block ON user_idx = context_id AND block.action = bpol.action),
""" + _REPLICATES)
def bootstrap_over_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn context carries all its rounds: cluster bootstrap of the exact value."""
    _, block, rounds = block_rounds(spark, sf_dir)
    pols = block_policy(block).withColumn("agent", F.lit("next_action"))
    params = EvaluationParams(estimators=("exact",))
    ev = ope.prepare_evaluation(rounds, pols, 5, params, block=block)
    return _interval_checks(ev, _ratio_errors(ev, "rsum", "rn"), ["rsum", "rn"], ope.estimator_value("exact"), ends=True)


@query("OPE18", "OPE16", sql=ctes(EVENT_SPLIT, GREEDY) + _WEIGHTS + """
SELECT agent, round(sum(w * reward) / sum(w), 9) AS value, count(DISTINCT t // 86400000000) AS n_units, 100::BIGINT AS n_replicates, true AS inside, true AS spread_fits,
  true AS centre_fits, 'percentile' AS method FROM w GROUP BY agent""")
def bootstrap_over_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller names the independent unit: all rounds of a day are drawn together."""
    rounds = event_parts(spark, sf_dir)
    train, test = event_train_test(spark, sf_dir, rounds)
    ev = ope.prepare_evaluation(
        test.withColumn("day", F.floor(F.col("t") / 86400000000)), event_policies(rounds, train), n_events_actions(spark, sf_dir),
        EvaluationParams(estimators=("snipw",)), uniform=("random",), unit_column="day")
    return _interval_checks(ev, _ratio_errors(ev, "wr", "w"), ["w", "wr"], ope.snipw_value())


@query("OPE17", "OPE18", sql=ctes(EVENT_SPLIT, GREEDY) + _WEIGHTS + """
SELECT agent, round(sum(w * reward) / sum(w), 9) AS value, count(*) AS n_units, 100::BIGINT AS n_replicates, true AS inside, true AS spread_fits, true AS centre_fits,
  'percentile_poisson' AS method FROM w GROUP BY agent""")
def poisson_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Poisson count per unit and replicate in place of exactly n draws."""
    ev = _unit_stats(spark, sf_dir, "snipw")
    return _interval_checks(ev, _ratio_errors(ev, "wr", "w"), ["w", "wr"], ope.snipw_value(), "percentile_poisson")


def _renamed(sql: str, prefix: str) -> str:
    """The tables of :func:`linear_sql` under other names, so that it can be used twice."""
    return re.sub(r"\b(lc|lst|ld|lxx|lxs|lmu|lrow|lrhs|lone|lsys|lgj|lth)\b", lambda m: prefix + m[1], sql)


_CUSTOMER_STATES = """SELECT c_custkey AS context_id, [1.0, c_acctbal / 10000.0, c_nationkey / 25.0::DOUBLE, """ + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + """] AS x FROM customer"""


def _dealt_sql(n: str, rank: str) -> str:
    return f"CASE WHEN {rank} < ({n} % 5) * ({n} // 5 + 1) THEN {rank} // ({n} // 5 + 1) ELSE {n} % 5 + ({rank} - ({n} % 5) * ({n} // 5 + 1)) // greatest({n} // 5, 1) END"


_EVALUATED = ",\n".join([BLOCK, _BLOCK_POLICY, f"""folds AS (SELECT unnest(range(5)) AS fold),
rd AS MATERIALIZED (SELECT row_seq AS round_id, user_idx AS context_id, action, reward, 1.0::DOUBLE / count(*) OVER (PARTITION BY user_idx) AS p FROM block),
cf AS MATERIALIZED (SELECT context_id, k AS n, {_dealt_sql('nn', 'rk')} AS fold FROM (SELECT context_id, count(*) AS k,
  row_number() OVER (ORDER BY {hash32_sql(SEED, 'context_id')}, context_id) - 1 AS rk, count(*) OVER () AS nn FROM rd GROUP BY context_id)),
po AS (SELECT 'next_action' AS agent, context_id, action, prob FROM bpol UNION ALL SELECT 'random', context_id, unnest(range(5)), 0.2::DOUBLE FROM cf),
mine AS MATERIALIZED (SELECT agent, rd.*, cf.fold, prob AS pi, prob / p AS w, prob * (1 - p) / (p * p) AS mw FROM rd JOIN cf USING (context_id) JOIN po USING (context_id, action))""",
    _renamed(linear_sql("SELECT 'all' AS ag, context_id, fold, action, count(*)::DOUBLE AS w, sum(reward) AS s FROM rd JOIN cf USING (context_id) GROUP BY ALL", _CUSTOMER_STATES), "d"),
    f"""sf AS (SELECT agent, context_id, {_dealt_sql('nn', 'rk')} AS mfold FROM (SELECT agent, context_id,
  row_number() OVER (PARTITION BY agent ORDER BY {hash32_sql(SEED, 'context_id')}, context_id) - 1 AS rk, count(*) OVER (PARTITION BY agent) AS nn
  FROM (SELECT DISTINCT agent, context_id FROM mine WHERE mw > 0))),
mf AS MATERIALIZED (SELECT a.agent, cf.context_id, cf.n, cf.fold, coalesce(mfold, cf.fold) AS mfold FROM cf CROSS JOIN (SELECT DISTINCT agent FROM po) a
  LEFT JOIN sf ON sf.agent = a.agent AND sf.context_id = cf.context_id)""",
    _renamed(linear_sql("SELECT m.agent AS ag, m.context_id, mfold AS fold, action, sum(mw) AS w, sum(mw * reward) AS s FROM mine m JOIN mf USING (agent, context_id) GROUP BY ALL", _CUSTOMER_STATES), "m"),
    """q AS MATERIALIZED (SELECT mf.agent, mf.context_id, a.action, dmu.mu + coalesce(list_dot_product(dth.theta, x), 0) AS q, mmu.mu + coalesce(list_dot_product(mth.theta, x), 0) AS mq
  FROM mf JOIN dst USING (context_id) CROSS JOIN (SELECT unnest(range(5)) AS action) a JOIN dmu ON dmu.fold = mf.fold JOIN mmu ON mmu.fold = mf.mfold AND mmu.ag = mf.agent
  LEFT JOIN dth ON dth.fold = mf.fold AND dth.action = a.action LEFT JOIN mth ON mth.fold = mf.mfold AND mth.ag = mf.agent AND mth.action = a.action)""".replace("dst USING", "dlst USING").replace(
        "dmu", "dlmu").replace("mmu", "mlmu").replace("dth", "dlth").replace("mth", "mlth"),
    """eq AS (SELECT agent, sum(n * e) AS dm, sum(n * me) AS mm, sum(n) AS n FROM (SELECT agent, context_id, sum(prob * q) AS e, sum(prob * mq) AS me FROM po JOIN q USING (agent, context_id, action) GROUP BY ALL)
  JOIN cf USING (context_id) GROUP BY agent),
co AS (SELECT agent, sum(w) AS w, sum(w * w) AS w2, sum(w * reward) AS wr, sum(w * (reward - q)) AS corr, sum(w * (reward - mq)) AS mcorr FROM mine JOIN q USING (agent, context_id, action) GROUP BY agent),
xv AS (SELECT agent, cf.context_id, n, CASE WHEN agent = 'random' THEN avg(reward) ELSE sum(prob * reward) END AS v FROM po JOIN cf USING (context_id) LEFT JOIN rd USING (context_id, action) GROUP BY agent, cf.context_id, n),
xx AS (SELECT agent, sum(v * n) / sum(n) FILTER (v IS NOT NULL) AS exact, coalesce(sum(n) FILTER (v IS NOT NULL), 0)::BIGINT AS scored, coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS masked FROM xv GROUP BY agent)"""])


@query("OPE19", "OPE20", "D18", sql="WITH RECURSIVE " + _EVALUATED + """
SELECT agent, unnest(['ipw', 'snipw', 'dm', 'dr', 'mrdr', 'exact']) AS estimator,
  unnest([round(wr / n, 7), round(wr / w, 7), round(dm / n, 7), round((dm + corr) / n, 7), round((mm + mcorr) / n, 7), round(exact, 7)]) AS value,
  round(w * w / w2, 6) AS effective_sample_size, 'ok' AS status, '' AS warnings, n::BIGINT AS n_samples, (SELECT count(*) FROM cf) AS n_independent_units,
  scored AS exact_rounds_scored, masked AS exact_rounds_masked, 'context' AS resampling_unit, 'cross_fitted_linear(k=5)_ridge(1)' AS q_model, true AS inside
FROM eq JOIN co USING (agent) JOIN xx USING (agent)""")
def evaluated_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows on the block: all estimators with status, interval and provenance."""
    _, block, rounds = block_rounds(spark, sf_dir)
    pols = block_policy(block).withColumn("agent", F.lit("next_action"))
    params = EvaluationParams(estimators=("ipw", "snipw", "dm", "dr", "mrdr", "exact"), n_bootstrap=100)
    out = ope.evaluate_policies(
        rounds, pols, 5, params, uniform=("random",), contexts=customer_contexts(spark, sf_dir), block=block, seed=SEED,
        provenance={"dataset": "orders", "state_source": "raw_features", "propensity_source": "eval_block:enumerated_empirical"})
    out = out.withColumn("inside", F.col("value").between(F.col("ci_lower"), F.col("ci_upper")))
    return rounded(rounded(out.select(
        "agent", "estimator", "value", "effective_sample_size", "status", "warnings", "n_samples", "n_independent_units", "exact_rounds_scored",
        "exact_rounds_masked", "resampling_unit", "q_model", "inside"), "value", digits=7), "effective_sample_size", digits=6)


# ------------------------------------------------------------------ reference policies

_VALUES = """, cv AS (SELECT action, sum(reward * n_rounds) / sum(n_rounds) AS value, CAST(sum(n_rounds) AS BIGINT) AS rounds_observed
  FROM block JOIN weights ON context_id = user_idx GROUP BY action)"""


@query("REF1", "REF2", "REF3", sql=ctes(BLOCK) + """, o AS (SELECT user_idx AS context_id, max(reward) AS best FROM block GROUP BY user_idx)
SELECT round(sum(best * n_rounds) / sum(n_rounds), 9) AS value, CAST(sum(n_rounds) AS BIGINT) AS rounds_scored, 0::BIGINT AS rounds_masked FROM weights JOIN o USING (context_id)""")
def oracle_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, block, rounds = block_rounds(spark, sf_dir)
    return rounded(reference.oracle_value(block, reference.context_weights(rounds)), "value")


@query("REF4", "WIN3", sql=ctes(BLOCK) + _VALUES + "SELECT action, round(value, 9) AS value, rounds_observed FROM cv ORDER BY cv.value DESC, action LIMIT 3")
def best_constant_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, block, rounds = block_rounds(spark, sf_dir)
    values = reference.constant_values(block, reference.context_weights(rounds))
    return rounded(reference.best_constants(values, 3), "value")


@query("REF5", "WIN2", sql=ctes(BLOCK) + _VALUES + "SELECT action, round(value, 9) AS value, rounds_observed, rank() OVER (ORDER BY cv.value DESC) AS constant_rank FROM cv")
def constant_policy_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, block, rounds = block_rounds(spark, sf_dir)
    values = reference.constant_values(block, reference.context_weights(rounds))
    return rounded(reference.constant_ranks(values), "value")


_LINE_VALUES = """, lv AS (SELECT action, avg(reward) AS value, count(*) AS rounds_observed, avg(feature) AS item_feature FROM ln GROUP BY action)"""


def _line_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # one row per action, read many times; the rounds are read once
    stats = durable(line_rounds(spark, sf_dir).groupBy("action").agg(
        F.avg("reward").alias("value"), F.count("*").alias("rounds_observed"), F.avg("feature").alias("item_feature")))
    return stats.select("action", "item_feature"), stats.select("action", "value", "rounds_observed")


@query("REF6", sql=ctes(LINE_ROUNDS) + "SELECT action, round(avg(feature), 9) AS item_feature FROM ln GROUP BY action")
def mean_item_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reference.item_feature(line_rounds(spark, sf_dir)), "item_feature")


@query("REF7", sql=ctes(LINE_ROUNDS) + _LINE_VALUES + """,
rk AS (SELECT *, rank() OVER (ORDER BY item_feature) + (count(*) OVER (PARTITION BY item_feature) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS ry FROM lv), c AS (SELECT count(*) AS n, corr(rx, ry) AS rho, quantile_cont(item_feature, 0.5) AS m FROM rk)
SELECT n AS n_items, round(rho, 9) AS spearman_rho, round(m, 9) AS median_feature, round(rho * sqrt((n - 2) / (1 - rho * rho)), 6) AS t_statistic, round(1 - abs(CASE WHEN df % 2 = 1 THEN 2 / pi() * (th + sin(th) * ser) ELSE sin(th) * ser END), 9) AS p_value
FROM (SELECT *, cos(th) * cos(th) AS c2, list_sum(list_transform(range(0, (df - CASE WHEN df % 2 = 1 THEN 3 ELSE 2 END) // 2 + 1), lambda m:
    list_product(list_prepend(CASE WHEN df % 2 = 1 THEN cos(th) ELSE 1.0 END, list_transform(range(1, m + 1), lambda k:
      cos(th) * cos(th) * CASE WHEN df % 2 = 1 THEN 2 * k / (2 * k + 1)::DOUBLE ELSE (2 * k - 1) / (2 * k)::DOUBLE END))))) AS ser
  FROM (SELECT *, n - 2 AS df, atan(rho * sqrt((n - 2) / (1 - rho * rho)) / sqrt(n - 2)) AS th FROM c))""")
def feature_value_confound(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, values = _line_values(spark, sf_dir)
    out = reference.feature_confound(features, values)
    return rounded(rounded(out, "spearman_rho", "median_feature", "p_value"), "t_statistic", digits=6)


@query("REF7", "REF4", sql=ctes(LINE_ROUNDS) + _LINE_VALUES + """
SELECT action, round(value, 9) AS value, rounds_observed, round(item_feature, 9) AS item_feature, round(item_feature / (SELECT quantile_cont(item_feature, 0.5) FROM lv), 9) AS feature_vs_median,
  round((SELECT quantile_cont(item_feature, 0.5) FROM lv), 9) AS median_feature FROM lv ORDER BY lv.value DESC, action LIMIT 5""")
def top_constants_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, values = _line_values(spark, sf_dir)
    out = reference.top_constants_against_median(features, values)
    return rounded(out, "value", "item_feature", "feature_vs_median", "median_feature")


# antitonic regression at x is the least over starts up to x of the greatest over ends from x of the mean between
def _antitonic_sql(source: str) -> str:
    return f"""ax AS MATERIALIZED (SELECT row_number() OVER (ORDER BY item_feature) AS i, item_feature, count(*) AS w, sum(value) AS s FROM {source} GROUP BY item_feature),
am AS (SELECT a.i AS a, b.i AS b, (SELECT sum(s) / sum(w) FROM ax c WHERE c.i BETWEEN a.i AND b.i) AS m FROM ax a JOIN ax b ON a.i <= b.i),
ag AS (SELECT x.i, am.a, max(am.m) AS m FROM ax x JOIN am ON am.a <= x.i AND am.b >= x.i GROUP BY ALL),
af AS (SELECT item_feature, min(m) AS baseline FROM ag JOIN ax USING (i) GROUP BY item_feature)"""


@query("REF8", sql=ctes(LINE_ROUNDS) + _LINE_VALUES + ",\n" + _antitonic_sql("lv") + " SELECT action, round(baseline, 9) AS baseline FROM lv JOIN af USING (item_feature)")
def feature_baseline_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antitonic fit of a brand's value on its mean size."""
    return rounded(reference.feature_baseline(*_line_values(spark, sf_dir)), "baseline")


@query("REF9", "REF8", sql=ctes(BLOCK, _BLOCK_POLICY) + _VALUES + """, bf AS (SELECT action, avg(t / 2.6e12 % 12) AS item_feature, any_value(value) AS value FROM bl JOIN cv USING (action) GROUP BY action),
""" + _antitonic_sql("bf") + """, c AS (SELECT n_rounds, reward, baseline FROM weights JOIN bpol USING (context_id) JOIN bf ON bf.action = bpol.action JOIN af USING (item_feature)
  LEFT JOIN block ON user_idx = context_id AND block.action = bpol.action)
SELECT round(sum(reward * n_rounds) / sum(n_rounds) FILTER (reward IS NOT NULL), 9) AS exact_value,
  round(sum(baseline * n_rounds) FILTER (reward IS NOT NULL) / sum(n_rounds) FILTER (reward IS NOT NULL), 9) AS feature_predicted,
  round(sum((reward - baseline) * n_rounds) / sum(n_rounds) FILTER (reward IS NOT NULL), 9) AS feature_adjusted_residual,
  CAST(coalesce(sum(n_rounds) FILTER (reward IS NOT NULL), 0) AS BIGINT) AS rounds_scored, CAST(coalesce(sum(n_rounds) FILTER (reward IS NULL), 0) AS BIGINT) AS rounds_masked FROM c""")
def feature_adjusted_policy_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy's value against the antitonic fit of its items' month, the feature of the order block."""
    rows, block, rounds = block_rounds(spark, sf_dir)
    block, weights = durable(block), durable(reference.context_weights(rounds))
    train = rows.withColumn("feature", (F.col("t") / 2.6e12) % 12)
    baseline = reference.feature_baseline(reference.item_feature(train), reference.constant_values(block, weights))
    out = reference.feature_adjusted_value(block_policy(block), block, weights, baseline)
    return rounded(out, "exact_value", "feature_predicted", "feature_adjusted_residual")


def _feistel_sql() -> str:
    """One pass of the keyed bijection over column x: high halves take on a function of the low ones and the other way round."""
    out = ["x & lm AS l0", "x >> lb AS h0"]
    for k in range(1, 7):
        i, j = (k - 1) // 2, k // 2
        other = f"l{i}" if k % 2 else f"h{j}"
        out += [f"({other} + ks[{k}]) % 2147483647 AS y{k}", f"(y{k} * y{k} + ks[{k}]) % 2147483647 AS z{k}",
                f"((z{k} * z{k} + ks[{k}]) % 2147483647) >> 5 AS f{k}",
                f"xor(h{i}, f{k} & hm) AS h{i + 1}" if k % 2 else f"xor(l{j - 1}, f{k} & lm) AS l{j}"]
    return ", ".join(out)


_SHUFFLED = f"""ix AS MATERIALIZED (SELECT context_id, n_rounds, bpol.action, row_number() OVER (ORDER BY context_id) - 1 AS i FROM weights JOIN bpol USING (context_id)),
dims AS (SELECT n, lb, (1 << lb) - 1 AS lm, (1 << (bits - lb)) - 1 AS hm FROM (SELECT *, bits // 2 AS lb FROM
  (SELECT count(*) AS n, greatest(2, length(bin(count(*) - 1))) AS bits FROM ix))),
ky AS (SELECT rep, list_transform(range(6), lambda k: ('0x' || substr(md5(concat_ws('|', '{SEED}', rep, k)), 1, 7))::BIGINT) AS ks FROM (SELECT unnest(range(200)) AS rep)),
walk AS (SELECT rep, ks, action, i AS x, 0 AS t FROM ix, ky
  UNION ALL SELECT rep, ks, action, (h3 << lb) + l3, 1 FROM (SELECT *, {_feistel_sql()} FROM walk, dims WHERE t = 0 OR x >= n)),
sh AS MATERIALIZED (SELECT rep, action, x AS i FROM walk, dims WHERE t = 1 AND x < n),
real AS (SELECT sum(reward * n_rounds) / sum(n_rounds) FILTER (reward IS NOT NULL) AS realised FROM ix LEFT JOIN block ON user_idx = context_id AND block.action = ix.action),
nl AS (SELECT rep, sum(reward * n_rounds) / sum(n_rounds) AS v FROM sh JOIN (SELECT i, context_id, n_rounds FROM ix) USING (i)
  JOIN block ON user_idx = context_id AND block.action = sh.action GROUP BY rep)"""


@query("REF10", sql="WITH RECURSIVE " + ",\n".join([BLOCK, _BLOCK_POLICY, _SHUFFLED]) + """
SELECT round(any_value(realised), 9) AS realised, round(avg(v), 9) AS shuffled_mean, round(stddev_samp(v), 9) AS shuffled_std, round(any_value(realised) - avg(v), 9) AS gain_from_matching,
  round((any_value(realised) - avg(v)) / stddev_samp(v), 6) AS z_score, round((count(*) FILTER (v >= realised - 1e-12) + 1) / (count(*) + 1)::DOUBLE, 9) AS p_value, count(*) AS n_permutations, true AS usable
FROM nl, real""")
def matching_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, block, rounds = block_rounds(spark, sf_dir)
    out = reference.personalisation_test(
        durable(block_policy(block)), durable(block), durable(reference.context_weights(rounds)), seed=SEED)
    out = rounded(out, "realised", "shuffled_mean", "shuffled_std", "gain_from_matching", "p_value")
    return rounded(out, "z_score", digits=6)


@query("REF11", sql=ctes(BLOCK, _BLOCK_POLICY) + """, u AS (SELECT action, sum(n_rounds) AS w, count(*) AS k FROM bpol JOIN weights USING (context_id) GROUP BY action),
s AS (SELECT *, w / (sum(w) OVER ())::DOUBLE AS share FROM u)
SELECT count(*) AS n_distinct_actions, CAST(sum(k) AS BIGINT) AS n_contexts, arg_max(action, w * 1000 - action) AS top_action, round(max(share), 9) AS top_action_share,
  round(-sum(share * ln(share)), 9) AS entropy_nats, round(ln(5.0::DOUBLE), 9) AS max_entropy_nats, count(*) = 1 AS collapsed FROM s""")
def policy_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, block, rounds = block_rounds(spark, sf_dir)
    out = reference.concentration(block_policy(block), reference.context_weights(rounds), 5)
    return rounded(out, "top_action_share", "entropy_nats", "max_entropy_nats")


_REPORT = ",\n".join([BLOCK, _BLOCK_POLICY, _SHUFFLED, _VALUES.lstrip(", "), """bf AS (SELECT action, avg(t / 2.6e12 % 12) AS item_feature, any_value(value) AS value FROM bl JOIN cv USING (action) GROUP BY action)""",
    _antitonic_sql("bf"), """va AS (SELECT sum(reward * n_rounds) / sum(n_rounds) FILTER (reward IS NOT NULL) AS value, sum(baseline * n_rounds) FILTER (reward IS NOT NULL) / sum(n_rounds) FILTER (reward IS NOT NULL) AS feature_predicted,
  coalesce(sum(n_rounds) FILTER (reward IS NOT NULL), 0)::BIGINT AS rounds_scored, coalesce(sum(n_rounds) FILTER (reward IS NULL), 0)::BIGINT AS rounds_masked
  FROM weights JOIN bpol USING (context_id) JOIN bf ON bf.action = bpol.action JOIN af USING (item_feature) LEFT JOIN block ON user_idx = context_id AND block.action = bpol.action),
us AS (SELECT action, sum(n_rounds) AS w, count(*) AS k, sum(n_rounds) / (sum(sum(n_rounds)) OVER ())::DOUBLE AS share FROM bpol JOIN weights USING (context_id) GROUP BY action),
cn AS (SELECT count(*) AS n_distinct_actions, sum(k)::BIGINT AS n_contexts, arg_max(action, w * 1000 - action) AS top_action, max(share) AS top_action_share, -sum(share * ln(share)) AS entropy_nats FROM us),
rk AS (SELECT action AS top_action, rank() OVER (ORDER BY value DESC) AS constant_rank FROM cv),
pm AS (SELECT avg(v) AS shuffled_mean, stddev_samp(v) AS sd, (count(*) FILTER (v >= realised - 1e-12) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM nl, real)"""])


@query("REF12", "RES11", sql="WITH RECURSIVE " + _REPORT + """
SELECT 'next_action' AS agent, round(value, 9) AS value, rounds_scored, rounds_masked, n_distinct_actions, n_contexts, top_action, round(top_action_share, 9) AS top_action_share,
  round(entropy_nats, 9) AS entropy_nats, round(ln(5.0::DOUBLE), 9) AS max_entropy_nats, n_distinct_actions = 1 AS collapsed, constant_rank, round(shuffled_mean, 9) AS shuffled_mean,
  round(value - shuffled_mean, 9) AS gain_from_matching, round((value - shuffled_mean) / sd, 6) AS z_score, round(p_value, 9) AS p_value, round(feature_predicted, 9) AS feature_predicted,
  round(value - feature_predicted, 9) AS feature_adjusted_residual
FROM va, cn JOIN rk USING (top_action), pm""")
def reference_policy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined report of one agent, its item feature being the order month."""
    rows, block, rounds = block_rounds(spark, sf_dir)
    block, rounds = durable(block), durable(rounds)
    train = rows.withColumn("feature", (F.col("t") / 2.6e12) % 12)
    out = reference.reference_report(
        {"next_action": durable(block_policy(block))}, block, durable(reference.context_weights(rounds)), train, 5,
        n_permutations=200, seed=SEED)
    out = rounded(out, "value", "top_action_share", "entropy_nats", "max_entropy_nats", "shuffled_mean", "gain_from_matching", "p_value",
                  "feature_predicted", "feature_adjusted_residual")
    return rounded(out, "z_score", digits=6)


@query("CHK5", sql=ctes(EVENT_SPLIT) + "SELECT (SELECT count(DISTINCT context_id) FROM test) * (SELECT count(*) FROM acts) AS cells")
def planned_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a contexts x actions table, counted before one is built."""
    _, test = event_train_test(spark, sf_dir)
    return checks.planned_cells(test.select("context_id"), table(spark, sf_dir, "events").select("event_type"))
