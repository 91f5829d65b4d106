"""Queries on graphs, treatment effects, comparison tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfold.errors import AnalysisRefused
from counterfold.functions.hashing import hash32_sql
from counterfold.functions.rows import one_row
from counterfold.functions.skew import tasks_by_rows
from counterfold.operators import graph, ope, policies, rollup, slices, splits, uplift
from counterfold.operators.ordering import micros, prefix_sums
from counterfold.plans.queries_data import SEED, n_events_actions
from counterfold.plans.queries_evaluation import block_policy, block_rounds
from counterfold.plans.registry import BLOCK, EVENT_ROUNDS, LINE_ROUNDS, ctes, query, r9, rounded
from counterfold.session import durable, release, scratch_path
from counterfold.sources import results
from counterfold.sources.tables import line_rounds, table, units
from counterfold.streaming.incremental import StoredState, linucb_sink, linucb_state, running_estimates, vocabulary_sink

# ------------------------------------------------------------------ graph


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "part").count()


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and part keys are dense from zero, so they are node numbers."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(F.col("o_custkey").alias("user_idx"), F.col("l_partkey").alias("item_idx"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tasks_by_rows(spark, table(spark, sf_dir, "lineitem").count()):
        return graph.bipartite_graph(_pairs(spark, sf_dir), *_sizes(spark, sf_dir))


def _node_features(spark: SparkSession, sf_dir: str, dim: int = 64) -> graph.SharedFeatures:
    n_users, n_items = _sizes(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("v"), F.transform(F.slice("embedding", 1, dim), lambda x: x.cast("double")).alias("embedding"))
    n = vectors.count()
    return graph.SharedFeatures(
        graph.nodes(spark, n_users, n_items).select("node_id", (F.col("node_id") % n).alias("v")), vectors)


def _long(vectors: DataFrame, digits: int = 9) -> DataFrame:
    return vectors.select("node_id", F.posexplode("embedding").alias("d", "x")).select(
        "node_id", F.col("d").cast("long").alias("d"), r9("x", digits).alias("x"))


_GRAPH = """nu AS (SELECT (SELECT count(*) FROM customer) AS u, (SELECT count(*) FROM part) AS i),
fw AS (SELECT DISTINCT o_custkey AS src, l_partkey + u AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey, nu),
ed AS (SELECT src, dst FROM fw UNION SELECT dst, src FROM fw),
nd AS (SELECT unnest(range((SELECT u + i FROM nu))) AS node_id),
ft AS MATERIALIZED (SELECT node_id, d, embedding[d + 1]::DOUBLE AS x FROM nd JOIN embeddings ON vec_id = node_id % (SELECT count(*) FROM embeddings),
  (SELECT unnest(range(64)) AS d)),
dg AS (SELECT src, count(*) AS degree FROM ed GROUP BY src),
nm AS MATERIALIZED (SELECT ed.src, ed.dst, 1 / sqrt(a.degree::DOUBLE * b.degree) AS norm FROM ed JOIN dg a ON a.src = ed.src JOIN dg b ON b.src = ed.dst)"""


@query("GRA1", "GRA2", "D9", sql=ctes(_GRAPH) + "SELECT src, count(*) AS degree, CAST(sum(dst) AS BIGINT) AS neighbour_sum FROM ed GROUP BY src")
def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("src").agg(F.count("*").alias("degree"), F.sum("dst").alias("neighbour_sum"))


@query("GRA1", "JOIN5", sql=ctes(_GRAPH) + """, fr AS (SELECT user_id AS src, event_id % 200 AS dst FROM events), uq AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 7 <> 0),
ix AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS n FROM uq)
SELECT count(a.k) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS social_edges, count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS dropped,
  CAST(sum(a.n + b.n) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS BIGINT) AS checksum FROM fr LEFT JOIN ix a ON a.k = src LEFT JOIN ix b ON b.k = dst""")
def mapped_social_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Friendships between known users only; the others are counted as dropped."""
    from counterfold.operators.encoding import fit_index

    index = fit_index([table(spark, sf_dir, "orders").filter("o_custkey % 7 <> 0")], "o_custkey")
    raw = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 200).alias("dst"))
    kept, report = graph.social_edges(raw, index)
    return report.join(one_row(kept.agg(F.sum(F.col("src") + F.col("dst")).alias("checksum"))), F.lit(True))


@query("GRA3", sql=f"""WITH nd AS (SELECT c_custkey AS node_id, d FROM customer, (SELECT unnest(range(64)) AS d))
SELECT node_id, d, round(sqrt(-2 * ln(({hash32_sql('42.a', 'node_id', 'd')} + 0.5::DOUBLE) / 4294967296.0))
  * cos(6.283185307179586 * (({hash32_sql('42.b', 'node_id', 'd')} + 0.5::DOUBLE) / 4294967296.0)), 6) AS x FROM nd""")
def seeded_node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))
    return _long(graph.seeded_features(ids, 64, SEED), 6)


_HELD = f"""ho AS (SELECT *, row_number() OVER (ORDER BY {hash32_sql(SEED, 'src', 'dst')}, src, dst) <= greatest(1, floor((SELECT count(*) FROM fw) * 0.1::DOUBLE)) AS is_val FROM fw)"""


@query("SPL5", "FLT3", sql=ctes(_GRAPH, _HELD) + "SELECT src, count(*) AS n, count(*) FILTER (is_val) AS n_val FROM ho GROUP BY src")
def held_out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_users, _ = _sizes(spark, sf_dir)
    out = splits.split_edges(graph.forward_edges(_edges(spark, sf_dir), n_users), 0.1, SEED)
    return out.groupBy("src").agg(F.count("*").alias("n"), F.count_if("is_val").alias("n_val"))


@query("GRA4", "JOIN6", sql=ctes(_GRAPH, _HELD) + """, m AS (SELECT src, dst FROM ho WHERE NOT is_val UNION SELECT dst, src FROM ho WHERE NOT is_val)
SELECT src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS neighbour_sum FROM m GROUP BY src""")
def message_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_users, _ = _sizes(spark, sf_dir)
    out = splits.split_edges(graph.forward_edges(_edges(spark, sf_dir), n_users), 0.1, SEED)
    m = graph.message_graph(out.filter("NOT is_val"), out.filter("is_val"))
    return m.groupBy("src").agg(F.count("*").alias("n"), F.sum("dst").alias("neighbour_sum"))


@query("GRA5", sql=ctes(_GRAPH) + "SELECT src, count(*) AS n, count(*) FILTER (src = dst) AS loops FROM (SELECT src, dst FROM ed UNION ALL SELECT node_id, node_id FROM nd) GROUP BY src")
def edges_with_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.self_loops(_edges(spark, sf_dir), graph.nodes(spark, *_sizes(spark, sf_dir)))
    return out.groupBy("src").agg(F.count("*").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


@query("GRA6", sql=ctes(_GRAPH) + "SELECT src, round(sum(norm), 9) AS norm_sum, round(max(norm), 9) AS norm_max FROM nm GROUP BY src")
def symmetric_edge_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.symmetric_norm(_edges(spark, sf_dir)).groupBy("src").agg(F.sum("norm").alias("norm_sum"), F.max("norm").alias("norm_max"))
    return rounded(out, "norm_sum", "norm_max")


@query("GRA7", sql=ctes(_GRAPH) + "SELECT src AS node_id, d, round(sum(norm * x), 9) AS x FROM nm JOIN ft ON node_id = dst GROUP BY ALL")
def neighbour_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(graph.aggregate_neighbours(_edges(spark, sf_dir), _node_features(spark, sf_dir), "symmetric", both_ways=True))


# one column per entry, which sums far faster than one row per entry
_each = lambda text: ", ".join(text.format(d=d) for d in range(64))


def _wide_hops(hops: int) -> str:
    """Vectors of all nodes after each hop, w0 (the input) to w<hops>."""
    out = [f"w0 AS MATERIALIZED (SELECT node_id, {_each('embedding[{d} + 1]::DOUBLE AS x{d}')} FROM nd JOIN embeddings ON vec_id = node_id % (SELECT count(*) FROM embeddings))"]
    for k in range(1, hops + 1):
        out.append(f"w{k} AS MATERIALIZED (SELECT nd.node_id, {_each('coalesce(s.x{d}, 0) AS x{d}')} FROM nd LEFT JOIN (SELECT src, {_each('sum(norm * x{d}) AS x{d}')} "
                   f"FROM nm JOIN w{k - 1} ON node_id = dst GROUP BY src) s ON s.src = nd.node_id)")
    return ", " + ",\n".join(out)


@query("GRA8", sql=ctes(_GRAPH) + _wide_hops(3) + f"""
SELECT node_id, unnest(range(64)) AS d, unnest([{_each("round((w0.x{d} + w1.x{d} + w2.x{d} + w3.x{d}) / 4, 8)")}]) AS x
FROM w0 JOIN w1 USING (node_id) JOIN w2 USING (node_id) JOIN w3 USING (node_id)""")
def light_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hops; every hop is checkpointed."""
    edges = _edges(spark, sf_dir)
    light = graph.light_propagation(edges, slices.cut(_node_features(spark, sf_dir).rows(), edges.count()), 3)
    return light.entries().withColumn("x", r9("x", 8))


@query("GRA9", sql=ctes(_GRAPH) + "SELECT ft.node_id, ft.d, round(coalesce(m, 0), 9) AS x FROM ft LEFT JOIN (SELECT src AS node_id, d, avg(x) AS m FROM ed JOIN ft ON node_id = dst GROUP BY ALL) USING (node_id, d)")
def neighbour_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(graph.neighbour_mean(_edges(spark, sf_dir), _node_features(spark, sf_dir)))


@query("GRA10", sql=ctes(_GRAPH) + """, lp AS (SELECT src, dst FROM ed UNION ALL SELECT node_id, node_id FROM nd), ld AS (SELECT src, count(*) AS g FROM lp GROUP BY src)
SELECT lp.src AS node_id, d, round(sum(x / sqrt(a.g::DOUBLE * b.g)), 9) AS x FROM lp JOIN ld a ON a.src = lp.src JOIN ld b ON b.src = lp.dst JOIN ft ON node_id = lp.dst GROUP BY ALL""")
def normalised_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(graph.convolution(_edges(spark, sf_dir), graph.nodes(spark, *_sizes(spark, sf_dir)), _node_features(spark, sf_dir), True))


@query("GRA11", "WIN5", sql=ctes(_GRAPH) + """, s AS (SELECT src, dst, (src * 7 + dst * 3) % 11 / 5.0::DOUBLE AS score FROM ed),
a AS (SELECT src, dst, exp(score - max(score) OVER (PARTITION BY src)) AS e FROM s)
SELECT src, dst, round(e / sum(e) OVER (PARTITION BY src), 9) AS attention FROM a""")
def edge_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _edges(spark, sf_dir).withColumn("score", (F.col("src") * 7 + F.col("dst") * 3) % 11 / 5.0)
    return graph.segment_softmax(scored).select("src", "dst", r9("attention").alias("attention"))


@query("GRA12", sql=ctes(_GRAPH) + """, s AS (SELECT ft.node_id, ft.d, ft.x AS h, coalesce(s, 0) AS s FROM ft LEFT JOIN (SELECT src AS node_id, d, sum(norm * x) AS s FROM nm JOIN ft ON node_id = dst GROUP BY ALL) USING (node_id, d)),
v AS (SELECT node_id, d, CASE WHEN h + s + s * h < 0 THEN 0.2 * (h + s + s * h) ELSE h + s + s * h END AS y FROM s)
SELECT node_id, d, round(y / sqrt(sum(y * y) OVER (PARTITION BY node_id)), 8) AS x FROM v""")
def interaction_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(graph.interaction_messages(_edges(spark, sf_dir), _node_features(spark, sf_dir), True), 8)


_NEG = f"""ng AS (SELECT src, dst, u + (({hash32_sql(SEED, 'src', 'dst', '0')} % i * (4294967296 % i) + {hash32_sql(f"{SEED}.low", 'src', 'dst', '0')}) % i) AS negative FROM ho, nu WHERE is_val)"""


def _triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n_users, n_items = _sizes(spark, sf_dir)
    out = splits.split_edges(graph.forward_edges(_edges(spark, sf_dir), n_users), 0.1, SEED)
    return out.filter("NOT is_val"), graph.negative_items(out.filter("is_val"), n_users, n_items, SEED)


@query("GRA13", sql=ctes(_GRAPH, _HELD, _NEG) + "SELECT src, dst, negative FROM ng")
def negative_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir)[1].select("src", "dst", "negative")


@query("GRA14", sql=ctes(_GRAPH, _HELD, _NEG) + """, m AS (SELECT src, dst, negative, sum(a.x * b.x) - sum(a.x * c.x) AS m FROM ng JOIN ft a ON a.node_id = src
  JOIN ft b ON b.node_id = dst AND b.d = a.d JOIN ft c ON c.node_id = negative AND c.d = a.d GROUP BY ALL)
SELECT round(avg(ln(1 + exp(-abs(m))) + greatest(-m, 0)), 9) AS loss, count(*) AS n_triples FROM m""")
def held_out_ranking_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.ranking_loss(_triples(spark, sf_dir)[1], _node_features(spark, sf_dir).rows()), "loss")


def _seeded_sql(d: int) -> str:
    draw = lambda half: f"({hash32_sql(f'{SEED}.{half}', 'node_id', str(d))} + 0.5::DOUBLE) / 4294967296.0"
    return f"sqrt(-2 * ln({draw('a')})) * cos(6.283185307179586 * ({draw('b')})) AS x{d}"


def _loss_sql(name: str, vectors: str) -> str:
    margin = " + ".join(f"a.x{d} * (b.x{d} - c.x{d})" for d in range(64))
    return f"""SELECT '{name}' AS architecture, avg(ln(1 + exp(-abs(m))) + greatest(-m, 0)) AS loss, count(*) AS n_triples FROM
  (SELECT {margin} AS m FROM ng JOIN {vectors} a ON a.node_id = src JOIN {vectors} b ON b.node_id = dst JOIN {vectors} c ON c.node_id = negative)"""


_UNTRAINED = ", ".join([
    "tr AS MATERIALIZED (SELECT src, dst FROM ho WHERE NOT is_val UNION SELECT dst, src FROM ho WHERE NOT is_val)",
    "td AS (SELECT src, count(*) AS degree FROM tr GROUP BY src)",
    "tn AS MATERIALIZED (SELECT tr.src, tr.dst, 1 / sqrt(a.degree::DOUBLE * b.degree) AS norm FROM tr JOIN td a ON a.src = tr.src JOIN td b ON b.src = tr.dst)",
    "s0 AS MATERIALIZED (SELECT node_id, " + ", ".join(_seeded_sql(d) for d in range(64)) + " FROM nd)",
    *(f"s{k} AS MATERIALIZED (SELECT nd.node_id, {_each('coalesce(s.x{d}, 0) AS x{d}')} FROM nd LEFT JOIN (SELECT src, {_each('sum(norm * x{d}) AS x{d}')} "
      f"FROM tn JOIN s{k - 1} ON node_id = dst GROUP BY src) s ON s.src = nd.node_id)" for k in (1, 2, 3)),
    f"pr AS MATERIALIZED (SELECT node_id, {_each('(s0.x{d} + s1.x{d} + s2.x{d} + s3.x{d}) / 4 AS x{d}')} "
    "FROM s0 JOIN s1 USING (node_id) JOIN s2 USING (node_id) JOIN s3 USING (node_id))",
    f"ls AS ({_loss_sql('seeded', 's0')} UNION ALL {_loss_sql('propagated', 'pr')})"])


@query("GRA16", "GRA14", sql=ctes(_GRAPH, _HELD, _NEG) + ", " + _UNTRAINED + """
SELECT architecture, round(loss, 6) AS loss, n_triples, rank() OVER (ORDER BY loss)::INTEGER AS rank FROM ls""")
def untrained_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out loss of seeded node features and of three hops over the training graph, best first."""
    train, triples, start = _encoder_input(spark, sf_dir)
    light = graph.light_propagation(graph.undirected(train, one_way=True), start, 3)
    return rounded(graph.compare_encoders({"seeded": start, "propagated": light}, triples), "loss", digits=6)


def _encoder_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, slices.Triples, slices.Slices]:
    """Training edges, held-out triples and seeded features of all nodes, laid out in slices."""
    train, triples = (durable(x) for x in _triples(spark, sf_dir))
    release(spark)
    nodes = graph.nodes(spark, *_sizes(spark, sf_dir))
    start = slices.cut(graph.seeded_features(nodes, 64, SEED), 2 * train.count(), (nodes.count(), 64))
    return train, slices.ask(triples, start.lay), start


@query("GRA15", "GRA16")
def encoder_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out loss of 64 matrix factors against seeded and propagated features."""
    n_users, _ = _sizes(spark, sf_dir)
    train, triples, start = _encoder_input(spark, sf_dir)
    known = graph.als_embeddings(train, n_users, 64, 10, seed=SEED)
    als = graph.nodes(spark, *_sizes(spark, sf_dir)).join(known.withColumnRenamed("embedding", "e").hint("merge"), "node_id", "left").select(
        "node_id", F.coalesce(F.transform("e", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), 64)).alias("embedding"))
    als = slices.cut(als, 2 * train.count(), (start.lay.n, 64))
    del known
    light = graph.light_propagation(graph.undirected(train, one_way=True), start, 3)
    return rounded(graph.compare_encoders({"als": als, "seeded": start, "propagated": light}, triples), "loss", digits=6)


@query("GRA17", sql=ctes(_GRAPH) + "SELECT CASE WHEN src < u THEN 'user' ELSE 'item' END AS kind, count(*) AS n_nodes, CAST(sum(degree) AS BIGINT) AS degrees FROM dg, nu GROUP BY kind")
def user_and_item_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_users, _ = _sizes(spark, sf_dir)
    deg = graph.degrees(_edges(spark, sf_dir))
    one = lambda df, kind: df.agg(F.count("*").alias("n_nodes"), F.sum("degree").alias("degrees")).withColumn("kind", F.lit(kind))
    return one(graph.user_nodes(deg, n_users, "src"), "user").unionByName(one(graph.item_nodes(deg, n_users, "src"), "item"))


# ------------------------------------------------------------------ treatment effects

_UNITS = """un AS (SELECT o_orderkey AS round_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t,
  o_totalprice AS y, c_acctbal AS x0, c_nationkey::DOUBLE AS x1 FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("CAU2", sql=ctes(_UNITS) + """SELECT count(*) AS n_units, count(DISTINCT t) AS n_arms, round(avg(t), 9) AS treatment_balance,
  round(corr(t, y), 8) AS outcome_treatment_correlation, round(abs(corr(t, x0)), 8) AS abs_corr_x0, round(abs(corr(t, x1)), 8) AS abs_corr_x1,
  round(min((x1 + 0.001) / 24), 9) AS propensity_min, round(max((x1 + 0.001) / 24), 9) AS propensity_max,
  count(*) FILTER ((x1 + 0.001) / 24 < 1e-3 OR (x1 + 0.001) / 24 > 1 - 1e-3) AS logged_propensity_overlap_violations, avg(t) < 0.01 OR avg(t) > 0.99 AS severe_imbalance FROM un""")
def causal_setup_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = uplift.validate_setup(
        units(spark, sf_dir).withColumn("p", (F.col("x1") + 0.001) / 24), ["x0", "x1"], "p",
        lineage={"treatment": ["o_orderpriority"]})
    out = rounded(out, "treatment_balance", "propensity_min", "propensity_max")
    return rounded(out, "outcome_treatment_correlation", "abs_corr_x0", "abs_corr_x1", digits=8)


@query("CAU3")
def functional_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(uplift.functional_dependence(units(spark, sf_dir), ["x0", "x1"]), "accuracy", digits=6)


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    two = F.array(F.struct(F.lit("by_balance").alias("estimator"), (F.col("x0") * 0.01 - F.col("x1")).alias("cate")),
                  F.struct(F.lit("by_nation").alias("estimator"), (F.col("x1") % 5 - 2.0).alias("cate")))
    return u.withColumn("e", F.explode(two)).select("round_id", "treatment", "outcome", "e.estimator", "e.cate")


_EFFECTS = _UNITS + """, ef AS (SELECT round_id, t, y, 'by_balance' AS estimator, x0 * 0.01::DOUBLE - x1 AS cate FROM un
UNION ALL SELECT round_id, t, y, 'by_nation', x1 % 5 - 2.0::DOUBLE FROM un)"""


@query("CAU7", "WIN6", sql=ctes(_EFFECTS) + """SELECT estimator, count(*) AS n, round(avg(cate), 6) AS mean, round(var_pop(cate), 6) AS variance, round(stddev_pop(cate), 6) AS std,
  round(min(cate), 6) AS min, round(max(cate), 6) AS max, round(quantile_cont(cate, 0.25), 6) AS q25, round(quantile_cont(cate, 0.5), 6) AS median, round(quantile_cont(cate, 0.75), 6) AS q75,
  round(avg(CASE WHEN cate > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS fraction_positive, var_pop(cate) < 1e-12 AS is_degenerate FROM ef GROUP BY estimator""")
def effect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = uplift.cate_summary(_effects(spark, sf_dir))
    return rounded(out, "mean", "variance", "std", "min", "max", "q25", "median", "q75", "fraction_positive", digits=6)


@query("CAU8", "PSUM", sql=ctes(_EFFECTS) + """, o AS (SELECT estimator, row_number() OVER w AS k, sum(t) OVER w AS nt, sum(1 - t) OVER w AS nc, sum(t * y) OVER w AS yt, sum((1 - t) * y) OVER w AS yc
  FROM ef WINDOW w AS (PARTITION BY estimator ORDER BY cate DESC, round_id ROWS UNBOUNDED PRECEDING)), c AS (SELECT *, yt - yc * CASE WHEN nc > 0 THEN nt / nc ELSE 0 END AS u FROM o),
t AS (SELECT estimator, count(*) AS n, sum(u) AS area, arg_max(u, k) AS last FROM c GROUP BY estimator)
SELECT estimator, n, round((area - last * n / 2) / (abs(last) * n / 2), 6) AS qini FROM t""")
def qini_by_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(uplift.qini(_effects(spark, sf_dir), by=("estimator",)), "qini", digits=6)


@query("PSUM", "GIX", sql=ctes(LINE_ROUNDS) + """, s AS (SELECT action, row_number() OVER w - 1 AS i, sum(reward) OVER w AS cum FROM ln WINDOW w AS (PARTITION BY action ORDER BY t, round_id ROWS UNBOUNDED PRECEDING))
SELECT action, max(i) AS last_index, round(sum(cum), 3) AS area FROM s GROUP BY action""")
def running_reward_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative reward over time per action, by the distributed prefix sum."""
    out = prefix_sums(line_rounds(spark, sf_dir).select("action", "t", "round_id", "reward"), ["t", "round_id"],
                      {"cum": "reward"}, "i", group=["action"])
    return out.groupBy("action").agg(F.max("i").alias("last_index"), r9(F.sum("cum"), 3).alias("area"))


@query("CAU4", "CAU5", "CAU6", "CAU9")
def effect_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three learners fitted and scored on all units, with summary and Qini."""
    u = durable(units(spark, sf_dir).select("round_id", "treatment", "outcome", "x0", "x1"))
    kw = {"trees": 5, "depth": 4, "seed": SEED}
    cate = uplift.s_learner(u, u, ["x0", "x1"], **kw).unionByName(
        uplift.x_learner(u, u, ["x0", "x1"], **kw)).unionByName(uplift.residual_learner(u, u, ["x0", "x1"], **kw))
    return uplift.compare_effects(durable(cate), u)


# ------------------------------------------------------------------ comparison tables


def _result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of four experiments, measured on slices of the events."""
    e = table(spark, sf_dir, "events")
    arm = F.element_at(F.array(*[F.lit(x) for x in ("shop_main", "shop_ablation_raw", "shop_ablation_cate", "town_main")]),
                       (F.col("user_id") % 4 + 1).cast("int"))
    est = F.element_at(F.array(*[F.lit(x) for x in ("snipw", "dr", "exact")]), (F.col("event_id") % 3 + 1).cast("int"))
    rows = e.select(arm.alias("experiment"), F.col("event_type").alias("agent"), est.alias("estimator"),
                    (F.floor(F.col("event_id") / 3) % 3).cast("long").alias("seed"), "value")
    rows = rows.groupBy("experiment", "agent", "estimator", "seed").agg(
        (F.avg("value") / 100).alias("v"), (F.min("value") / 100).alias("ci_lower"), (F.max("value") / 100).alias("ci_upper"),
        F.count("*").alias("n_test_rounds"))
    bad = ((F.col("agent") == "error") & (F.col("seed") == 1)) | ((F.col("agent") == "view") & (F.col("estimator") == "dr"))
    return rows.select(
        "experiment", "agent", "estimator", "seed", F.lit("events").alias("dataset"), "n_test_rounds",
        F.when(F.col("experiment") == "shop_ablation_raw", "raw_features").otherwise("gnn_embeddings").alias("state_source"),
        F.when(F.col("experiment") == "shop_ablation_cate", 0.5).otherwise(0.0).alias("cate_reward_weight"),
        F.when(~bad, F.col("v")).alias("value"), F.when(~bad, F.col("ci_lower")).alias("ci_lower"), F.when(~bad, F.col("ci_upper")).alias("ci_upper"),
        F.when((F.col("agent") == "signup") & (F.col("seed") == 2), None).otherwise(F.col("n_test_rounds") * 0.9).alias("effective_sample_size"),
        F.when(bad, "not_identifiable").otherwise("ok").alias("status"), F.when(bad, "no overlap").alias("detail"))


def _run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    variant = F.element_at(F.array(*[F.lit(x) for x in ("main", "ablation_raw", "ablation_cate", "pilot")]), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(variant.alias("variant"), (F.floor(F.col("event_id") / 5) % 5).cast("long").alias("seed")).distinct().select(
        "variant", "seed", F.when(F.col("seed") == 3, "failed").when(F.col("seed") == 4, "skipped").otherwise("ok").alias("status"),
        F.when(F.col("seed") == 3, "ran out of time").alias("error"))


_RES = """rs0 AS (SELECT ['shop_main', 'shop_ablation_raw', 'shop_ablation_cate', 'town_main'][user_id % 4 + 1] AS experiment, event_type AS agent,
  ['snipw', 'dr', 'exact'][event_id % 3 + 1] AS estimator, event_id // 3 % 3 AS seed, avg(value) / 100 AS v, min(value) / 100 AS lo, max(value) / 100 AS hi, count(*) AS n_test_rounds FROM events GROUP BY ALL),
rs AS (SELECT experiment, agent, estimator, seed, n_test_rounds, CASE WHEN experiment = 'shop_ablation_raw' THEN 'raw_features' ELSE 'gnn_embeddings' END AS state_source,
  CASE WHEN experiment = 'shop_ablation_cate' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS cate_reward_weight, NOT bad AS ok, CASE WHEN NOT bad THEN v END AS value,
  CASE WHEN NOT bad THEN lo END AS ci_lower, CASE WHEN NOT bad THEN hi END AS ci_upper,
  CASE WHEN agent = 'signup' AND seed = 2 THEN NULL ELSE n_test_rounds * 0.9::DOUBLE END AS ess FROM
  (SELECT *, (agent = 'error' AND seed = 1) OR (agent = 'view' AND estimator = 'dr') AS bad FROM rs0)),
rec AS (SELECT DISTINCT ['main', 'ablation_raw', 'ablation_cate', 'pilot'][user_id % 4 + 1] AS variant, event_id // 5 % 5 AS seed FROM events),
recs AS (SELECT *, CASE seed WHEN 3 THEN 'failed' WHEN 4 THEN 'skipped' ELSE 'ok' END AS status FROM rec),
att AS (SELECT DISTINCT experiment, recs.seed, recs.status FROM recs, (SELECT DISTINCT experiment FROM rs) WHERE (experiment = variant OR ends_with(experiment, '_' || variant)) AND recs.status <> 'skipped'),
ck AS (SELECT DISTINCT experiment, agent, state_source, cate_reward_weight, estimator FROM rs),
sd AS (SELECT ck.*, seed FROM ck JOIN att USING (experiment) UNION SELECT experiment, agent, state_source, cate_reward_weight, estimator, seed FROM rs),
na AS (SELECT experiment, agent, state_source, cate_reward_weight, estimator, count(*) AS n_attempted FROM sd GROUP BY ALL),
ls AS (SELECT ck.*, 'run_' || status AS reason FROM ck JOIN att USING (experiment) WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.experiment = ck.experiment AND rs.agent = ck.agent
  AND rs.state_source = ck.state_source AND rs.cate_reward_weight = ck.cate_reward_weight AND rs.estimator = ck.estimator AND rs.seed = att.seed)),
rn AS (SELECT experiment, agent, state_source, cate_reward_weight, estimator, list(DISTINCT reason) AS reasons FROM (SELECT * FROM ls UNION ALL
  SELECT experiment, agent, state_source, cate_reward_weight, estimator, 'not_identifiable' FROM rs WHERE NOT ok) GROUP BY ALL),
cl AS (SELECT experiment, agent, state_source, cate_reward_weight, estimator, avg(value) FILTER (ok) AS mean, CASE WHEN count(*) FILTER (ok) > 0 THEN coalesce(stddev_samp(value) FILTER (ok), 0) ELSE 0 END AS std,
  avg(ci_lower) FILTER (ok) AS ci_lower, avg(ci_upper) FILTER (ok) AS ci_upper, avg(ess) FILTER (ok) AS ess, count(*) FILTER (ok) = 0 OR count(ess) FILTER (ok) < count(*) FILTER (ok) AS ess_missing,
  count(DISTINCT seed) FILTER (ok) AS n_usable, any_value(n_attempted) AS n_attempted, coalesce(max(n_test_rounds) FILTER (ok), max(n_test_rounds)) AS n_test,
  CASE WHEN count(*) FILTER (ok) > 0 THEN CASE WHEN count(DISTINCT seed) FILTER (ok) < any_value(n_attempted) THEN 'partial' ELSE 'ok' END
    WHEN any_value(len(reasons)) = 1 THEN any_value(reasons[1]) ELSE 'mixed_failure' END AS status,
  count(*) FILTER (ok) > 0 AND count(DISTINCT seed) FILTER (ok) < any_value(n_attempted) AS partial
  FROM rs JOIN na USING (experiment, agent, state_source, cate_reward_weight, estimator) LEFT JOIN rn USING (experiment, agent, state_source, cate_reward_weight, estimator) GROUP BY ALL)"""


def _cells(spark: SparkSession, sf_dir: str, with_runs: bool = True) -> DataFrame:
    rows = _result_rows(spark, sf_dir)
    attempted = None
    if with_runs:
        attempted = results.attempted_seeds(results.attribute_runs(_run_records(spark, sf_dir), rows.select("experiment").distinct()))
    return rollup.aggregate_cells(rows, attempted)


@query("SRC9", "JOIN13", "D22", sql=ctes(_RES) + """
SELECT variant, e.experiment, seed, status, e.experiment IS NULL AS unattributed FROM recs LEFT JOIN (SELECT DISTINCT experiment FROM rs) e ON e.experiment = variant OR ends_with(e.experiment, '_' || variant)""")
def attributed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records matched to experiments by suffix, without a theta join."""
    rows = _result_rows(spark, sf_dir).select("experiment").distinct()
    return results.attribute_runs(_run_records(spark, sf_dir), rows).drop("error")


@query("SRC9", sql=ctes(_RES) + "SELECT variant, seed, 'ran out of time' AS reason FROM recs WHERE variant = 'pilot' AND status = 'failed'")
def unattributed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _result_rows(spark, sf_dir).select("experiment").distinct()
    return results.unattributed_failures(results.attribute_runs(_run_records(spark, sf_dir), rows))


@query("RES1", "JOIN11", sql=ctes(_RES) + """SELECT experiment, agent, state_source, cate_reward_weight, estimator, round(mean, 9) AS mean, round(std, 9) AS std, round(ci_lower, 9) AS ci_lower,
  round(ci_upper, 9) AS ci_upper, round(ess, 9) AS ess, ess_missing, n_usable::INT AS n_usable, n_attempted::INT AS n_attempted, n_test, status, partial FROM cl""")
def aggregated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cells(spark, sf_dir).drop("seeds", "failures", "details")
    return rounded(out, "mean", "std", "ci_lower", "ci_upper", "ess")


@query("RES4", sql=ctes(_RES) + """SELECT experiment, count(*) AS n_cells, false AS refused FROM cl GROUP BY experiment
UNION ALL SELECT 'all together', count(*), count(DISTINCT experiment) > 1 FROM cl""")
def cells_of_one_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each experiment pass into a table of their own; all together are refused."""
    cells = durable(_cells(spark, sf_dir).select("experiment"))
    tables = {r[0]: cells.filter(F.col("experiment") == r[0]) for r in cells.distinct().collect()}  # the experiments of a report
    out = None
    for name, part in {**tables, "all together": cells}.items():
        try:
            rollup.one_group(part)
            refused = False
        except AnalysisRefused:
            refused = True
        row = part.agg(F.count("*").alias("n_cells")).select(F.lit(name).alias("experiment"), "n_cells", F.lit(refused).alias("refused"))
        out = row if out is None else out.unionByName(row)
    return out


_FAMILY = "regexp_replace(experiment, '^(.+)(_main|_ablation_raw|_ablation_cate)$', '\\1')"


@query("RES2", "RES3", sql=ctes(_RES) + f"SELECT DISTINCT experiment, {_FAMILY} AS family, {_FAMILY} AS table_group FROM cl")
def experiment_table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.table_groups(_cells(spark, sf_dir))


@query("RES3", "FLT2", sql="""SELECT experiment, 'x' AS family, experiment AS table_group FROM (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'x_main' ELSE 'x_ablation_raw' END AS experiment FROM events)""")
def split_table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two experiments claiming one column: the family is split; smoke runs are left out."""
    e = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "x_main").otherwise("x_ablation_raw").alias("experiment"))
    e = e.unionByName(e.select(F.concat(F.lit("smoke_"), "experiment").alias("experiment"))).filter(results.is_reportable())
    return rollup.table_groups(e.withColumn("state_source", F.lit("gnn_embeddings")).withColumn("cate_reward_weight", F.lit(0.0)))


_BEST = """, hl AS (SELECT *, CASE WHEN status = 'not_identifiable' THEN 'n.i.' WHEN status NOT IN ('ok', 'partial') THEN 'n/a' WHEN partial THEN n_usable || '/' || n_attempted ELSE '' END AS marker,
  coalesce(estimator IN ('snipw', 'dr') AND ess < 100 AND status = 'ok', false) AS low_ess FROM cl WHERE state_source = 'gnn_embeddings' AND cate_reward_weight = 0),
bs AS (SELECT *, coalesce(status = 'ok' AND NOT partial AND abs(mean - max(mean) FILTER (status = 'ok' AND NOT partial AND NOT (estimator IN ('snipw', 'dr') AND coalesce(ess < 100, false))) OVER (PARTITION BY experiment, estimator)) < 1e-12, false) AS is_best FROM hl)"""
_RES_ALONE = _RES.replace("UNION SELECT experiment, agent, state_source, cate_reward_weight, estimator, seed FROM rs)", "WHERE false UNION SELECT experiment, agent, state_source, cate_reward_weight, estimator, seed FROM rs)").replace(
    "ls AS (SELECT ck.*, 'run_' || status AS reason FROM ck JOIN att USING (experiment) WHERE", "ls AS (SELECT ck.*, 'run_' || status AS reason FROM ck JOIN att USING (experiment) WHERE false AND")


@query("RES5", sql=ctes(_RES_ALONE) + _BEST + """ SELECT experiment, agent, max(ess) AS row_ess, """ + ", ".join(
    f"""round(max(mean) FILTER (estimator = '{e}'), 9) AS {e}_value, max(marker) FILTER (estimator = '{e}') AS {e}_marker, bool_or(is_best) FILTER (estimator = '{e}') AS {e}_best"""
    for e in ("snipw", "dr", "exact")) + " FROM bs GROUP BY experiment, agent")
def policy_value_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.value_table(_cells(spark, sf_dir, False), ["snipw", "dr", "exact"])
    return rounded(out, "snipw_value", "dr_value", "exact_value")


@query("RES10", sql=ctes(_RES) + _BEST + "SELECT experiment, agent, estimator, marker, low_ess, n_usable::INT AS n_usable, n_attempted::INT AS n_attempted FROM hl")
def cell_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.with_markers(_cells(spark, sf_dir).filter("state_source = 'gnn_embeddings' AND cate_reward_weight = 0"))
    return out.select("experiment", "agent", "estimator", "marker", "low_ess", "n_usable", "n_attempted")


@query("RES10", sql=ctes(_RES) + """SELECT experiment, min(n_usable) FILTER (status IN ('ok', 'partial'))::INT AS seeds_min, max(n_usable) FILTER (status IN ('ok', 'partial'))::INT AS seeds_max,
  min(n_test) AS rounds_min, max(n_test) AS rounds_max FROM cl GROUP BY experiment""")
def caption_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.caption_ranges(_cells(spark, sf_dir))


@query("RES6", sql=ctes(_RES) + f""" SELECT {_FAMILY} AS family, agent, round(max(mean) FILTER (state_source = 'gnn_embeddings' AND cate_reward_weight = 0), 9) AS "gnn_embeddings@0.0",
  round(max(mean) FILTER (cate_reward_weight = 0.5), 9) AS "gnn_embeddings@0.5", round(max(mean) FILTER (state_source = 'raw_features'), 9) AS "raw_features@0.0" FROM cl WHERE estimator = 'snipw' GROUP BY ALL""")
def ablation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollup.ablation_table(_cells(spark, sf_dir), "snipw")
    return out.select("family", "agent", *[r9(F.col(f"`{c}`")).alias(c) for c in out.columns if "@" in c])


_ERR = """, tr AS (SELECT experiment, agent, mean AS exact FROM cl WHERE estimator = 'exact' AND status = 'ok' AND state_source = 'gnn_embeddings' AND cate_reward_weight = 0),
er AS (SELECT cl.experiment, cl.agent, cl.estimator, exact, mean, status, partial, CASE WHEN status IN ('ok', 'partial') THEN mean - exact END AS error FROM cl JOIN tr USING (experiment, agent)
  WHERE estimator IN ('snipw', 'dr') AND state_source = 'gnn_embeddings' AND cate_reward_weight = 0)"""


@query("RES7", "RES11", "JOIN12", sql=ctes(_RES_ALONE) + _ERR + "SELECT experiment, agent, estimator, status, partial, round(exact, 9) AS exact, round(mean, 9) AS mean, round(error, 9) AS error FROM er")
def estimator_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.validation_errors(_cells(spark, sf_dir, False)), "exact", "mean", "error")


@query("RES7", sql=ctes(_RES_ALONE) + _ERR + """SELECT experiment, estimator, round(avg(abs(error)) FILTER (status = 'ok' AND NOT partial), 9) AS mae,
  count(error) FILTER (status = 'ok' AND NOT partial) AS n_agents FROM er GROUP BY ALL""")
def estimator_mean_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollup.validation_table(_cells(spark, sf_dir, False)), "mae")


_RANK = """, rk AS (SELECT *, row_number() OVER (PARTITION BY experiment, estimator ORDER BY mean DESC, agent) AS rank FROM cl
  WHERE status IN ('ok', 'partial') AND state_source = 'gnn_embeddings' AND cate_reward_weight = 0)"""


@query("RES9", "WIN2", sql=ctes(_RES) + _RANK + "SELECT experiment, estimator, agent, rank::INT AS rank, partial FROM rk")
def agent_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.ranking(_cells(spark, sf_dir)).select("experiment", "estimator", "agent", "rank", "partial")


@query("RES9", sql=ctes(_RES_ALONE) + _RANK + f""", bd AS (SELECT experiment, estimator, mean AS base, partial AS bp FROM rk WHERE agent = 'click'),
sl AS (SELECT {_FAMILY} AS experiment, estimator, agent, mean, status IN ('ok', 'partial') AS v, partial AS p, state_source, cate_reward_weight FROM cl),
vd AS (SELECT r.experiment, r.estimator, r.agent, 'graph_state' AS claim, l.v AS vl, l.p AS pl, l.mean AS ml, r.v AS vr, r.p AS pr, r.mean AS mr FROM sl l JOIN sl r USING (experiment, estimator, agent)
    WHERE l.state_source = 'raw_features' AND l.cate_reward_weight = 0 AND r.state_source = 'gnn_embeddings' AND r.cate_reward_weight = 0
  UNION ALL SELECT r.experiment, r.estimator, r.agent, 'reward_shaping', l.v, l.p, l.mean, r.v, r.p, r.mean FROM sl l JOIN sl r USING (experiment, estimator, agent)
    WHERE l.state_source = 'gnn_embeddings' AND l.cate_reward_weight = 0 AND r.cate_reward_weight > 0)
SELECT experiment, estimator, 'best' AS claim, arg_min(agent, rank) FILTER (NOT partial) AS subject, CASE WHEN count(*) FILTER (NOT partial) = 0 THEN 'NOT ESTABLISHED' ELSE 'ESTABLISHED' END AS verdict FROM rk GROUP BY ALL
UNION ALL SELECT experiment, estimator, 'beats_random', agent, CASE WHEN bp OR partial THEN 'NOT ESTABLISHED' WHEN mean > base THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END FROM rk JOIN bd USING (experiment, estimator) WHERE agent <> 'click'
UNION ALL SELECT * FROM (SELECT experiment, estimator, 'ess', agent, CASE WHEN ess IS NULL OR ess_missing THEN 'ESS NOT RECORDED' WHEN ess < 0.01 * n_test THEN 'ESS BELOW 1%' END AS v FROM rk WHERE estimator IN ('snipw', 'dr')) WHERE v IS NOT NULL
UNION ALL SELECT experiment, estimator, claim, agent, CASE WHEN NOT vl OR NOT vr THEN 'NO VERDICT: no value' WHEN pl OR pr THEN 'NO VERDICT: lost seeds' WHEN mr > ml THEN 'HELPS' ELSE 'DOES NOT HELP' END FROM vd
UNION ALL SELECT experiment, estimator, 'outperforms', 'purchase>signup', CASE WHEN a.partial OR b.partial THEN 'NOT ESTABLISHED' WHEN a.mean > b.mean THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END
  FROM rk a JOIN rk b USING (experiment, estimator) WHERE a.agent = 'purchase' AND b.agent = 'signup'""")
def claims_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with their verdicts; the click agent stands for the random baseline."""
    return rollup.claims_check(durable(_cells(spark, sf_dir, False)), [("purchase", "signup")], "click")


@query("RES8", sql=ctes(EVENT_ROUNDS, BLOCK) + """, s AS (SELECT 'events' AS dataset, count(*) AS n, count(DISTINCT user_idx) AS u, count(DISTINCT action) AS a, avg(reward) AS m, 'value at least 50' AS r FROM ev
UNION ALL SELECT 'orders', count(*), count(DISTINCT user_idx), count(DISTINCT action), avg(reward), 'price at least 250000' FROM bl),
l AS (SELECT dataset, 0 AS position, 'Interactions' AS property, n::VARCHAR AS text FROM s UNION ALL SELECT dataset, 1, 'Users', u::VARCHAR FROM s UNION ALL SELECT dataset, 2, 'Items (actions)', a::VARCHAR FROM s
UNION ALL SELECT dataset, 3, 'Mean reward', printf('%.5f', m) FROM s UNION ALL SELECT dataset, 4, 'Reward definition', r FROM s UNION ALL SELECT dataset, 5, 'Train / Val / Test', (n - n // 5) || ' / ' || (n // 10) || ' / ' || (n // 10) FROM s
UNION ALL SELECT dataset, 6, 'Split strategy', 'temporal' FROM s UNION ALL SELECT dataset, 7, 'Logged propensities', CASE dataset WHEN 'events' THEN 'Yes' ELSE 'No (uniform)' END FROM s)
SELECT position, property, max(text) FILTER (dataset = 'events') AS events, max(text) FILTER (dataset = 'orders') AS orders FROM l GROUP BY ALL""")
def dataset_statistics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from counterfold.sources.tables import event_rounds, order_rows

    def row(df: DataFrame, name: str, definition: str, constant: bool) -> DataFrame:
        n = F.count("*")
        return df.agg(
            n.alias("n_interactions"), F.count_distinct("user_idx").alias("n_users"), F.count_distinct("action").alias("n_actions"),
            F.avg("reward").alias("mean_reward"), (n - F.floor(n / 5)).alias("n_train"), F.floor(n / 10).alias("n_validation"),
            F.floor(n / 10).alias("n_test")).select(
            "*", F.lit(name).alias("dataset"), F.lit(definition).alias("reward_definition"), F.lit("temporal").alias("split_strategy"),
            F.lit(constant).alias("propensity_is_constant"))

    return rollup.dataset_table(row(event_rounds(spark, sf_dir), "events", "value at least 50", False).unionByName(
        row(order_rows(spark, sf_dir), "orders", "price at least 250000", True)))


@query("RES11", sql=ctes(BLOCK) + """, cv AS (SELECT action, sum(reward * n_rounds) / sum(n_rounds) AS v FROM block JOIN weights ON context_id = user_idx GROUP BY action),
o AS (SELECT sum(b * n_rounds) / sum(n_rounds) AS v FROM weights JOIN (SELECT user_idx AS context_id, max(reward) AS b FROM block GROUP BY user_idx) USING (context_id))
SELECT 'constant_' || action AS agent, round(v, 9) AS value, 1.0::DOUBLE AS n_distinct_actions, 'agent' AS kind FROM cv UNION ALL SELECT 'oracle', round(v, 9), NULL, 'reference' FROM o
UNION ALL SELECT 'best_constant', round(max(v), 9), NULL, 'reference' FROM cv""")
def value_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant policies against the oracle and best-constant lines."""
    from counterfold.operators import reference

    _, block, rounds = block_rounds(spark, sf_dir)
    weights = reference.context_weights(rounds)
    constants = reference.constant_values(block, weights)
    agents = constants.select(F.concat(F.lit("constant_"), "action").alias("agent"), r9("value").alias("value"), F.lit(1).cast("long").alias("n_distinct_actions"))
    lines = reference.oracle_value(block, weights).select(F.lit("oracle").alias("agent"), r9("value").alias("value")).unionByName(
        constants.agg(r9(F.max("value")).alias("value")).withColumn("agent", F.lit("best_constant")))
    return rollup.value_ladder(agents, lines).withColumn("n_distinct_actions", F.col("n_distinct_actions").cast("double"))


@query("RES12", sql=ctes(_RES) + "SELECT DISTINCT variant, s AS seed FROM rec, (SELECT unnest(range(7)) AS s) WHERE NOT EXISTS (SELECT 1 FROM recs r WHERE r.variant = rec.variant AND r.seed = s AND r.status = 'ok')")
def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _run_records(spark, sf_dir)
    return rollup.missing_runs(records.select("variant").distinct(), list(range(7)), records.filter("status = 'ok'"))


@query("SRC10", sql="""SELECT label::VARCHAR AS architecture, round(avg(embedding[1]::DOUBLE), 9) AS mean_loss, round(coalesce(stddev_samp(embedding[1]::DOUBLE), 0), 9) AS std_loss, count(*) AS n_runs
FROM embeddings GROUP BY label""")
def encoder_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder result files written, scanned by their name and summarised per architecture."""
    folder = scratch_path(spark, "encoder-files")
    runs = table(spark, sf_dir, "embeddings").select(F.struct(
        F.col("label").cast("string").alias("architecture"), F.lit("events").alias("dataset"), F.col("vec_id").alias("seed"),
        F.col("embedding")[0].cast("double").alias("best_val_loss"), F.lit(1.0).alias("train_seconds")).alias("run"))
    # a file holds one list of at most about a thousand runs
    lists = runs.groupBy("run.architecture", F.floor(F.col("run.seed") / 1000)).agg(F.to_json(F.collect_list("run")).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/phase1_encoders.json")
    return rounded(results.summarise_encoders(results.read_encoder_runs(spark, folder)), "mean_loss", "std_loss")


def write_result_files(rows: DataFrame, folder: str) -> None:
    """One JSON array per experiment, named as result files are."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(folder).getFileSystem(conf)
    staged = f"{folder}/staged"
    rows.groupBy(F.concat(F.lit("phase4_ope_"), "experiment", F.lit("_seed"), "seed").alias("name")).agg(
        F.to_json(F.collect_list(F.struct(*[c for c in rows.columns if c != "experiment"]))).alias("value")
    ).repartition("name").write.partitionBy("name").text(staged)
    for part in fs.listStatus(path(staged)):
        name = part.getPath().getName()
        if name.startswith("name="):
            for file in fs.listStatus(part.getPath()):
                if file.getPath().getName().startswith("part-"):
                    fs.rename(file.getPath(), path(f"{folder}/{name[5:]}.json"))


@query("SRC7", "SRC8", "FLT2", sql=ctes(_RES) + "SELECT experiment, seed, count(*) AS n, round(avg(value), 9) AS mean_value FROM rs GROUP BY ALL")
def result_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files written and scanned; experiment from the name, smoke runs left out."""
    folder = scratch_path(spark, "result-files")
    rows = _result_rows(spark, sf_dir)
    smoke = rows.filter("experiment = 'town_main'").withColumn("experiment", F.lit("smoke_main"))
    write_result_files(rows.unionByName(smoke), folder)
    out = results.read_results(spark, folder, "events", require_nonempty=True)
    return rounded(out.groupBy("experiment", "seed").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")), "mean_value")


# ------------------------------------------------------------------ streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream of rounds with a propensity per action."""
    events = table(spark, sf_dir, "events")
    from counterfold.operators.encoding import fit_vocabulary

    vocab = fit_vocabulary(events, "event_type").select(F.col("value").alias("event_type"), F.col("code").alias("action"))
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.join(vocab, "event_type").select(
        F.col("event_id").alias("round_id"), F.col("user_id").alias("context_id"), "action",
        (F.col("value") >= 50).cast("double").alias("reward"), (0.1 + F.col("action") / 20).alias("propensity"), micros("ts").alias("t"))


def _drain(spark: SparkSession, writer) -> None:
    q = writer.option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


@query("STR1", sql=ctes(EVENT_ROUNDS) + """, po AS (SELECT DISTINCT 'low' AS agent, context_id, context_id % 2 AS action FROM ev UNION ALL SELECT DISTINCT 'high', context_id, 2 + context_id % 3 FROM ev),
w AS (SELECT a.agent, reward, CASE WHEN po.action IS NULL THEN 0 ELSE 1 / (0.1::DOUBLE + ev.action / 20.0::DOUBLE) END AS w FROM ev CROSS JOIN (SELECT DISTINCT agent FROM po) a
  LEFT JOIN po ON po.agent = a.agent AND po.context_id = ev.context_id AND po.action = ev.action)
SELECT agent, count(*) AS n, round(sum(w * reward) / count(*), 9) AS ipw, round(sum(w * reward) / sum(w), 9) AS snipw, round(sum(w) * sum(w) / sum(w * w), 6) AS ess FROM w GROUP BY agent""")
def streaming_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running IPW, SNIPW and ESS; after the last batch they equal the batch values."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("context_id")).distinct()
    one = lambda name, a: users.select(F.lit(name).alias("agent"), "context_id", a.alias("action"), F.lit(1.0).alias("prob"))
    pols = one("low", F.col("context_id") % 2).unionByName(one("high", 2 + F.col("context_id") % 3))
    name = f"running_{uuid.uuid4().hex}"
    _drain(spark, running_estimates(_event_stream(spark, sf_dir), pols).writeStream.outputMode("complete").format("memory").queryName(name))
    return rounded(rounded(spark.table(name), "ipw", "snipw"), "ess", digits=6)


@query("STR2", sql=ctes(EVENT_ROUNDS) + """, x AS MATERIALIZED (SELECT action, context_id, count(*) AS n, sum(reward) AS r FROM ev GROUP BY ALL),
d AS (SELECT unnest(range(1, 65)) AS i), m AS (SELECT action, a.i, b.i AS j, sum(n * embedding[a.i]::DOUBLE * embedding[b.i]) AS v FROM x JOIN embeddings ON vec_id = context_id, d a, d b GROUP BY ALL)
SELECT action, 'xx' AS part, i * 64 + j - 65 AS position, round(v, 5) AS value FROM m
UNION ALL SELECT action, 'xr', i - 1, round(sum(r * embedding[i]::DOUBLE), 5) FROM x JOIN embeddings ON vec_id = context_id, d GROUP BY action, i
UNION ALL SELECT action, 'n', 0, sum(n)::DOUBLE FROM x GROUP BY action""")
def streaming_arm_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arm statistics on the whole state, kept outside the stream: every sum of every arm."""
    states = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("context_id"), F.transform("embedding", lambda x: x.cast("double")).alias("context"))
    state = linucb_state(spark, scratch_path(spark, "arms"))
    _drain(spark, _event_stream(spark, sf_dir).join(states, "context_id").writeStream.foreachBatch(linucb_sink(state, 64)))
    out = state.read()
    sums = [out.select("action", F.lit(part).alias("part"), F.posexplode(part).alias("position", "value")) for part in ("xx", "xr")]
    both = sums[0].unionByName(sums[1]).unionByName(
        out.select("action", F.lit("n").alias("part"), F.lit(0).alias("position"), F.col("n").cast("double").alias("value")))
    return both.select("action", "part", F.col("position").cast("long").alias("position"), r9("value", 5).alias("value"))


@query("STR3", sql="""SELECT 'event_type' AS column_name, event_type AS value, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)""")
def streaming_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = StoredState(spark, scratch_path(spark, "vocabulary"))
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    _drain(spark, stream.select("event_type").writeStream.foreachBatch(vocabulary_sink(state, "event_type")))
    return state.read()
