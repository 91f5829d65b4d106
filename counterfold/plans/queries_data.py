"""Queries on sources, checks, encodings, splits, overlap and propensities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfold.functions.hashing import hash32_sql
from counterfold.functions.rows import one_row
from counterfold.functions.skew import tasks_by_rows
from counterfold.operators import checks, encoding, overlap, projections, propensity, sampling, splits
from counterfold.operators.ordering import micros
from counterfold.params import DatasetParams, EvaluationParams, Params, SplitParams
from counterfold.plans.prepare import describe_matrix, prepare, rounds_summary
from counterfold.plans.registry import (
    BLOCK, EVENT_ROUNDS, EVENT_SPLIT, LINE_ROUNDS, ctes, query, r9, rounded,
)
from counterfold.session import durable, release, scratch_path
from counterfold.sources import logs, results
from counterfold.sources.tables import (
    event_rounds, line_rounds, order_rows, purchase_pairs, table, user_contexts,
)

BY_TIME = SplitParams(timestamp_column="t")
SEED = 42


def event_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written once: a query reads its parts, policies and contexts from it
    return durable(splits.split_rows(event_rounds(spark, sf_dir), BY_TIME, check=False))


def n_events_actions(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").select("event_type").distinct().count()


# ------------------------------------------------------------------ sources


@query("SRC1", "PRJ1", sql=ctes(EVENT_ROUNDS) + """
SELECT action AS item_id, count(*) AS n_rounds, CAST(sum(reward) AS BIGINT) AS clicks,
  round(avg(feature / 100 + 0.01), 9) AS mean_propensity FROM ev GROUP BY action""")
def bandit_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a log file and read back through the checked scan."""
    root = scratch_path(spark, "log")
    event_rounds(spark, sf_dir).select(
        F.col("t").alias("timestamp"), F.col("action").alias("item_id"), (F.col("feature") % 3 + 1).cast("int").alias("position"),
        F.col("reward").cast("int").alias("click"), (F.col("feature") / 100 + 0.01).alias("propensity_score"),
        F.col("user_idx").alias("user_feature_0"),
    ).write.option("header", True).csv(f"{root}/random/all/all.csv")
    log = logs.read_bandit_log(spark, root, "random", "all")
    return rounded(log.groupBy("item_id").agg(
        F.count("*").alias("n_rounds"), F.sum("click").alias("clicks"),
        F.avg("propensity_score").alias("mean_propensity")), "mean_propensity")


_WATCH = """SELECT o_custkey AS user_id, l_partkey AS video_id, l_quantity AS play_duration,
  p_size::DOUBLE AS video_duration, l_quantity / p_size AS watch_ratio
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""


def _watch_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("video_id"),
                F.col("l_quantity").alias("play_duration"), F.col("p_size").cast("double").alias("video_duration"),
                (F.col("l_quantity") / F.col("p_size")).alias("watch_ratio"))
    )


@query("SRC2", "D3", sql=f"""WITH m AS ({_WATCH})
SELECT 'small_matrix' AS matrix, count(*) AS n_rows, count(DISTINCT user_id) AS n_users,
  count(DISTINCT video_id) AS n_items, 2.0::DOUBLE AS reward_threshold,
  round(avg(CASE WHEN watch_ratio >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS positive_rate FROM m""")
def interaction_matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "matrix")
    _watch_matrix(spark, sf_dir).write.option("header", True).csv(f"{root}/data/small_matrix.csv")
    matrix = logs.read_interaction_matrix(spark, root, "small_matrix")
    return rounded(logs.matrix_metadata(matrix, "small_matrix"), "positive_rate")


@query("SRC4", sql="""SELECT user_id AS src, CAST(sum(2) AS BIGINT) AS n_edges,
  CAST(sum(event_id % 150 + CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS dst_sum
FROM events WHERE event_id % 20 <> 0 GROUP BY user_id""")
def social_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Friend lists as text, one in twenty unreadable."""
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 20 == 0, F.lit("[a, 1]")).otherwise(
        F.concat(F.lit("["), F.col("event_id") % 150, F.lit(", "), k, F.lit(" ]")))
    edges = logs.parse_social_lists(table(spark, sf_dir, "events").select("user_id", text.alias("friend_list")))
    return edges.groupBy("src").agg(F.count("*").alias("n_edges"), F.sum("dst").alias("dst_sum"))


@query("SRC5", sql="""SELECT c_mktsegment AS segment, count(*) AS n_users, CAST(sum(c_custkey) AS BIGINT) AS id_sum
FROM customer GROUP BY c_mktsegment""")
def user_feature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "features")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")) \
        .write.option("header", True).csv(f"{folder}/user_features.csv")
    return logs.read_user_features(spark, folder).groupBy("segment").agg(
        F.count("*").alias("n_users"), F.sum("user_id").alias("id_sum"))


def _log_and_block(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases of a fifth of the parts by a third of the customers are the block."""
    pairs = purchase_pairs(spark, sf_dir)
    in_block = (F.col("user_id") % 3 == 0) & (F.col("item_id") % 5 == 0)
    return pairs.filter(~in_block | (F.col("item_id") % 10 == 0)), pairs.filter(in_block)


_PAIRS = """pairs AS (SELECT o_custkey AS user_id, l_partkey AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
blk AS (SELECT * FROM pairs WHERE user_id % 3 = 0 AND item_id % 5 = 0),
lg AS (SELECT *, user_id IN (SELECT user_id FROM blk) AS eu, item_id IN (SELECT item_id FROM blk) AS ei FROM pairs
  WHERE NOT (user_id % 3 = 0 AND item_id % 5 = 0) OR item_id % 10 = 0),
ovl AS (SELECT (SELECT count(DISTINCT user_id) FROM blk) AS eval_users,
  (SELECT count(DISTINCT item_id) FROM blk) AS eval_items,
  count(DISTINCT CASE WHEN eu THEN user_id END) AS eval_users_in_log,
  count(*) FILTER (eu) AS eval_user_log_rows, count(*) FILTER (ei) AS eval_item_log_rows,
  count(DISTINCT CASE WHEN ei THEN user_id END) AS eval_item_log_users,
  count(*) FILTER (eu AND ei) AS overlap_rows,
  count(DISTINCT CASE WHEN eu AND ei THEN concat_ws('|', user_id, item_id) END) AS overlap_cells FROM lg)"""


@query("OVL1", "JOIN1", "D5", sql=ctes(_PAIRS) + """
SELECT *, CASE WHEN overlap_rows = 0 THEN 'cold_item' ELSE 'warm: ' || overlap_cells || ' cells' END AS regime FROM ovl""")
def block_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, block = _log_and_block(spark, sf_dir)
    return overlap.block_overlap(log, block, block.select("item_id"), "user_id", "item_id")


@query("SRC6", "D4", sql=ctes(_PAIRS) + """
SELECT (SELECT count(*) FROM lg) AS log_rows, (SELECT count(*) FROM blk) AS block_rows,
  (SELECT count(DISTINCT item_id) FROM blk) AS universe_items, overlap_cells FROM ovl""")
def train_eval_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, block = _log_and_block(spark, sf_dir)
    pair = logs.assemble_train_eval(log, block, item="item_id")
    return (
        pair.log.agg(F.count("*").alias("log_rows"))
        .join(one_row(pair.eval_block.agg(F.count("*").alias("block_rows"))), F.lit(True))
        .join(one_row(pair.action_universe.agg(F.count("*").alias("universe_items"))), F.lit(True))
        .join(one_row(pair.overlap.select("overlap_cells")), F.lit(True))
    )


@query("SMP1", sql=f"""SELECT event_id, user_id FROM events
ORDER BY {hash32_sql(SEED, 'event_id')}, event_id LIMIT (SELECT count(*) // 10 FROM events)""")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return sampling.sample_exact(events, events.count() // 10, SEED, "event_id")


@query("SMP2", sql=f"""WITH e AS (SELECT event_id, user_id, event_id // 300 AS chunk FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY {hash32_sql(SEED, 'event_id')}, event_id) AS rn,
  count(*) OVER (PARTITION BY chunk) * ((SELECT count(*) // 7 FROM events) / (SELECT count(*) FROM events)::DOUBLE) AS take FROM e)
SELECT event_id, user_id FROM r WHERE rn <= round_even(take, 0)""")
def chunked_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return sampling.sample_by_chunk(events, events.count() // 7, SEED, "event_id", chunk_rows=300)


# ------------------------------------------------------------------ sinks


@query("SNK1", sql="""SELECT event_type AS experiment, user_id % 3 AS seed, count(*) AS n, round(avg(value), 9) AS value
FROM events GROUP BY ALL""")
def result_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written partitioned by experiment and seed, then read back."""
    path = scratch_path(spark, "results")
    rows = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("experiment"), (F.col("user_id") % 3).alias("seed")
    ).agg(F.count("*").alias("n"), r9(F.avg("value")).alias("value"))
    results.write_results(rows, path, "parquet", ("experiment", "seed"))
    return spark.read.parquet(path).select("experiment", F.col("seed").cast("long").alias("seed"), "n", "value")


@query("SNK2", "D10", sql="""SELECT vec_id AS node_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2
FROM embeddings""")
def embedding_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "embeddings")
    results.write_embeddings(user_contexts(spark, sf_dir).withColumnRenamed("user_idx", "node_id"), path)
    frame = results.read_embeddings(spark, path)
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return frame.select("node_id", r9(norm2, 6).alias("norm2"))


@query("SNK3", sql="""SELECT event_id AS round_id, 'stored' AS estimator, round(value - 50, 9) AS cate FROM events""")
def effect_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cate")
    rounds = table(spark, sf_dir, "events").select(F.col("event_id").alias("round_id"), (F.col("value") - 50).alias("cate"))
    results.write_cate(rounds.withColumn("estimator", F.lit("stored")), path)
    return rounded(results.read_cate(spark, path, "stored", rounds), "cate")


@query("SNK4", "SNK5", sql=ctes(EVENT_SPLIT) + "SELECT part, count(*) AS n, round(avg(reward), 9) AS mean_reward FROM evs GROUP BY part")
def prepared_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared rounds are written once under a key of all their inputs."""
    folder = scratch_path(spark, "prepared")
    key = {"table": sf_dir, "split": vars(BY_TIME), "seed": SEED}
    build = lambda: event_parts(spark, sf_dir)
    inputs = [f"{sf_dir}/events.parquet"]
    results.materialise(spark, folder, key, build, inputs=inputs)
    again = results.materialise(spark, folder, key, build, inputs=inputs)
    return rounded(again.groupBy("part").agg(F.count("*").alias("n"), F.avg("reward").alias("mean_reward")), "mean_reward")


@query("SNK6", "D19", sql="""SELECT 'p_brand' AS column_name, p_brand AS value, row_number() OVER (ORDER BY p_brand) - 1 AS code
FROM (SELECT DISTINCT p_brand FROM part)""")
def vocabulary_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vocabulary")
    results.write_vocabulary(encoding.fit_vocabulary(table(spark, sf_dir, "part"), "p_brand"), path)
    return results.read_vocabulary(spark, path)


# ------------------------------------------------------------------ projections and checks


@query("PRJ2", sql="""WITH p AS (SELECT c_custkey, concat_ws('|', c_mktsegment, c_nationkey) AS persona FROM customer),
v AS (SELECT persona, row_number() OVER (ORDER BY persona) - 1 AS persona_code FROM (SELECT DISTINCT persona FROM p))
SELECT c_custkey, persona, persona_code FROM p JOIN v USING (persona)""")
def persona_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(
        "c_custkey", projections.persona_key(["c_mktsegment", "c_nationkey"]).alias("persona"))
    coded = people.withColumn("persona_code", F.col("persona"))
    vocab = encoding.fit_vocabulary(coded, "persona_code")
    return encoding.encode_categories(coded, vocab, ["persona_code"])


@query("PRJ3", "PRJ4", sql="""SELECT c_custkey, round(c_acctbal, 9) AS x0, c_nationkey::DOUBLE AS x1 FROM customer""")
def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    columns = projections.numeric_features(customer, ["c_acctbal", "c_name"], ["nation"])
    return customer.select("c_custkey", projections.context_vector(columns).alias("x")).select(
        "c_custkey", r9(F.col("x")[0]).alias("x0"), F.col("x")[1].alias("x1"))


@query("PRJ5", "CHK1", sql=ctes(EVENT_ROUNDS) + """
SELECT count(*) AS n_rounds, count(*) FILTER (action >= 4) AS action_out_of_range,
  count(*) FILTER (NOT (feature / 90 > 0 AND feature / 90 <= 1)) AS propensity_out_of_range,
  count(*) FILTER (reward IS NULL) AS reward_missing FROM ev""")
def round_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = event_rounds(spark, sf_dir).withColumn("propensity", F.col("feature") / 90)
    return checks.round_violations(rounds, 4)


@query("CHK1", "D13", sql=ctes(EVENT_ROUNDS) + """, c AS (SELECT context_id, action, count(*) AS n FROM ev GROUP BY ALL),
p AS (SELECT context_id, action, n / (sum(n) OVER (PARTITION BY context_id) + (context_id % 2)) AS prob FROM c)
SELECT count(*) AS n_contexts, count(*) FILTER (abs(s - 1) > 1e-4) AS not_normalised, 0::BIGINT AS action_out_of_range
FROM (SELECT context_id, sum(prob) AS s FROM p GROUP BY context_id)""")
def policy_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical action shares, spoiled for odd contexts."""
    cells = event_rounds(spark, sf_dir).groupBy("context_id", "action").agg(F.count("*").alias("n"))
    totals = cells.groupBy("context_id").agg(F.sum("n").alias("total"))
    policy = cells.join(totals, "context_id").withColumn("prob", F.col("n") / (F.col("total") + F.col("context_id") % 2))
    return checks.policy_violations(policy, 5)


@query("PRJ6", "PRJ10", "FLT1", sql=ctes(EVENT_SPLIT) + """
SELECT round_id, user_idx, action, reward FROM evs WHERE part = 'train' AND action IN (SELECT action FROM acts WHERE event_type LIKE '%i%')""")
def policy_rows_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows whose action is in the universe: a semi join on the actions."""
    actions = encoding.fit_vocabulary(table(spark, sf_dir, "events"), "event_type")
    universe = actions.filter(F.col("value").contains("i")).select(F.col("code").alias("action"))
    return projections.keep_actions(projections.part_arrays(event_parts(spark, sf_dir), "train"), universe)


@query("PRJ7", "PRJ8", sql="""SELECT o_orderkey AS round_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN 1 ELSE 0 END AS treatment,
  round(o_totalprice + 0.5 * (o_totalprice - 250000), 4) AS reward FROM orders""")
def shaped_order_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rounds = orders.select(F.col("o_orderkey").alias("round_id"), F.col("o_totalprice").alias("reward"),
                           projections.binarise_treatment("o_orderpriority", "1-URGENT").alias("treatment"))
    cate = orders.select(F.col("o_orderkey").alias("round_id"), (F.col("o_totalprice") - 250000).alias("cate"))
    return rounded(projections.shape_rewards(rounds, cate, 0.5), "reward", digits=4)


@query("PRJ9", "JOIN3", sql=ctes(EVENT_ROUNDS) + """
SELECT round_id, round(embedding[1]::DOUBLE, 6) AS first_entry, len(embedding)::INT AS width
FROM ev JOIN embeddings ON vec_id = user_idx""")
def rounds_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = projections.attach_state(event_rounds(spark, sf_dir), user_contexts(spark, sf_dir), salt_by=["round_id"])
    return joined.select("round_id", r9(F.col("context")[0], 6).alias("first_entry"), F.size("context").alias("width"))


@query("CHK2", sql=ctes(EVENT_SPLIT) + """
SELECT round(min(propensity), 9) AS propensity_min, round(max(propensity), 9) AS propensity_max,
  max(propensity) - min(propensity) <= 1e-8 + 1e-5 * abs(min(propensity)) AS propensity_is_constant FROM test""")
def propensity_constancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = propensity.enumerated_propensities(event_parts(spark, sf_dir).filter("part <> 'train'"))
    return rounded(checks.constant_propensity(test), "propensity_min", "propensity_max")


@query("CHK3", "JOIN2", sql=ctes(BLOCK) + """
SELECT count(*) AS n_rounds, count(*) FILTER (b.reward IS NULL) AS not_found,
  count(*) FILTER (b.reward <> r.reward) AS mismatched FROM bl r LEFT JOIN block b USING (user_idx, action)""")
def logged_reward_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from counterfold.operators.ope import last_write

    rows = order_rows(spark, sf_dir)
    return checks.reward_reproduction(rows, last_write(rows))


@query("CHK4", sql=ctes(EVENT_ROUNDS) + "SELECT context_id FROM ev GROUP BY context_id HAVING min(feature) <> max(feature)")
def inconsistent_context_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = event_rounds(spark, sf_dir).withColumn("context", F.array("feature"))
    return checks.inconsistent_contexts(rounds)


# ------------------------------------------------------------------ encodings


@query("ENC1", "ENC3", "D19", sql="""WITH v AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
  FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority < '4'))
SELECT o_orderkey, coalesce(code, -1)::BIGINT AS o_orderpriority FROM orders LEFT JOIN v USING (o_orderpriority)""")
def encoded_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary fitted on part of the values; the others become -1."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    vocab = encoding.fit_vocabulary(orders.filter(F.col("o_orderpriority") < "4"), "o_orderpriority")
    return encoding.encode_categories(orders, vocab, ["o_orderpriority"])


@query("ENC2", sql="""WITH a AS (SELECT DISTINCT p_brand AS value FROM part WHERE p_size > 40),
b AS (SELECT DISTINCT p_brand AS value FROM part WHERE p_size <= 40 AND p_brand NOT IN (SELECT value FROM a))
SELECT 'p_brand' AS column_name, value, row_number() OVER (ORDER BY value) - 1 AS code FROM a
UNION ALL SELECT 'p_brand', value, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY value) - 1 FROM b""")
def extended_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = encoding.fit_vocabulary(part.filter("p_size > 40"), "p_brand")
    return encoding.extend_vocabulary(first, part, "p_brand")


@query("ENC4", "ENC5", "GIX", "D20", sql="""WITH i AS (SELECT raw_id, row_number() OVER (ORDER BY raw_id) - 1 AS idx
  FROM (SELECT DISTINCT l_partkey AS raw_id FROM lineitem UNION SELECT p_partkey FROM part WHERE p_size < 25))
SELECT l_partkey AS item_id, idx AS action, count(*) AS n FROM lineitem JOIN i ON l_partkey = raw_id GROUP BY ALL""")
def shared_item_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index over the log's and the catalogue's items, applied strictly."""
    log = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"))
    catalogue = table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("item_id"))
    index = encoding.fit_index([log, catalogue], "item_id")
    counts = log.groupBy("item_id").agg(F.count("*").alias("n"))
    return encoding.apply_index(counts, index, "item_id", "action").select("item_id", "action", "n")


@query("ENC6", sql="""WITH i AS (SELECT raw_id, row_number() OVER (ORDER BY raw_id) - 1 AS idx
  FROM (SELECT DISTINCT o_custkey AS raw_id FROM orders))
SELECT idx, raw_id AS o_custkey FROM i""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = encoding.fit_index([table(spark, sf_dir, "orders")], "o_custkey")
    return encoding.invert_index(index.select("idx"), index, "idx", "o_custkey")


@query("ENC7", sql="""SELECT column_name, round(avg(unknown), 9) AS unknown_rate, max(k)::BIGINT AS cardinality FROM (
SELECT 'p_brand' AS column_name, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS unknown,
  (SELECT count(DISTINCT p_brand) FROM part WHERE p_size = 50) AS k FROM part
UNION ALL SELECT 'p_type', CASE WHEN p_type IN (SELECT p_type FROM part WHERE p_size = 50) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END,
  (SELECT count(DISTINCT p_type) FROM part WHERE p_size = 50) FROM part) GROUP BY column_name""")
def unknown_category_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    seen = part.filter("p_size = 50")
    vocab = encoding.fit_vocabulary(seen, "p_brand").unionByName(encoding.fit_vocabulary(seen, "p_type"))
    return rounded(encoding.unknown_rate(part, vocab, ["p_brand", "p_type"]), "unknown_rate")


@query("ENC8", "REF1", "D16", sql="""WITH g AS (SELECT user_id, min(event_id) AS representative, count(*) AS n_rounds FROM events GROUP BY user_id)
SELECT user_id, representative, n_rounds, row_number() OVER (ORDER BY representative) - 1 AS group_no FROM g""")
def first_appearance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.first_appearance(table(spark, sf_dir, "events"), "user_id", "event_id")


# ------------------------------------------------------------------ splits


@query("SPL1", "WIN1", "D8", sql=ctes(EVENT_SPLIT) + "SELECT round_id, part FROM evs")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_parts(spark, sf_dir).select("round_id", "part")


@query("SPL1", sql=ctes(LINE_ROUNDS) + """, k AS (SELECT *, row_number() OVER (ORDER BY t, round_id) - 1 AS rk, count(*) OVER () AS nn FROM ln),
s AS (SELECT *, CASE WHEN rk < floor(nn * 0.8::DOUBLE) THEN 'train'
  WHEN rk < floor(nn * 0.8::DOUBLE) + floor(nn * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS part FROM k)
SELECT part, action, count(*) AS n, round(avg(reward), 9) AS mean_reward FROM s GROUP BY ALL""")
def temporal_split_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows share a day, so the boundary falls inside a tie."""
    out = splits.split_rows(line_rounds(spark, sf_dir), BY_TIME, check=False)
    return rounded(out.groupBy("part", "action").agg(F.count("*").alias("n"), F.avg("reward").alias("mean_reward")), "mean_reward")


@query("SPL2", sql=ctes(EVENT_ROUNDS) + f""", k AS (SELECT round_id, row_number() OVER (ORDER BY {hash32_sql(7, 'round_id')}, round_id) - 1 AS rk,
  count(*) OVER () AS nn FROM ev)
SELECT round_id, CASE WHEN rk < floor(nn * 0.6::DOUBLE) THEN 'train'
  WHEN rk < floor(nn * 0.6::DOUBLE) + floor(nn * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS part FROM k""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = SplitParams("random", 0.6, 0.2, 0.2)
    return splits.split_rows(event_rounds(spark, sf_dir), params, seed=7).select("round_id", "part")


@query("SPL3", sql=ctes(EVENT_SPLIT) + """
SELECT part, count(*) AS n_rows, min(t) AS t_min, max(t) AS t_max,
  CASE part WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS part_no, false AS leaks, false AS boundary_tied
FROM evs GROUP BY part""")
def split_time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.part_ranges(event_parts(spark, sf_dir), "t")


@query("SPL4", sql=ctes(EVENT_ROUNDS) + """, k AS (SELECT round_id, row_number() OVER (ORDER BY t, round_id) - 1 AS rk, count(*) OVER () AS nn FROM ev)
SELECT round_id, CASE WHEN rk < floor(nn * (0.8::DOUBLE / (0.8::DOUBLE + 0.1::DOUBLE))) THEN 'train' ELSE 'validation' END AS part FROM k""")
def training_log_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_training_log(event_rounds(spark, sf_dir), BY_TIME).select("round_id", "part")


@query("SPL6", sql=ctes(EVENT_ROUNDS) + f""", c AS (SELECT DISTINCT context_id FROM ev),
k AS (SELECT context_id, row_number() OVER (ORDER BY {hash32_sql(SEED, 'context_id')}, context_id) - 1 AS rk, count(*) OVER () AS n FROM c)
SELECT context_id, CASE WHEN rk < (n % 5) * (n // 5 + 1) THEN rk // (n // 5 + 1)
  ELSE n % 5 + (rk - (n % 5) * (n // 5 + 1)) // (n // 5) END::INT AS fold FROM k""")
def balanced_context_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = event_rounds(spark, sf_dir).select("context_id").distinct()
    return splits.context_folds(contexts, 5, SEED)


@query("SPL7", sql=ctes(BLOCK) + f""", c AS (SELECT user_idx AS context_id, max(reward) > 0 AS supported FROM block GROUP BY user_idx),
k AS (SELECT *, row_number() OVER (PARTITION BY supported ORDER BY {hash32_sql(SEED, 'context_id')}, context_id) - 1 AS rk,
  count(*) OVER (PARTITION BY supported) AS n FROM c)
SELECT context_id, supported, CASE WHEN rk < (n % 5) * (n // 5 + 1) THEN rk // (n // 5 + 1)
  ELSE n % 5 + (rk - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END::INT AS fold FROM k""")
def stratified_context_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = order_rows(spark, sf_dir)
    from counterfold.operators.ope import last_write

    flags = last_write(contexts).groupBy(F.col("user_idx").alias("context_id")).agg((F.max("reward") > 0).alias("supported"))
    return splits.stratified_folds(flags, 5, SEED)


@query("OVL2", "JOIN7", sql=ctes(EVENT_SPLIT) + """, te AS (SELECT DISTINCT user_idx FROM evs WHERE part = 'test'),
h AS (SELECT user_idx, count(*) AS n FROM train GROUP BY user_idx), j AS (SELECT te.user_idx, n FROM te LEFT JOIN h USING (user_idx)),
x AS (SELECT count(*) AS overlap_cells FROM (SELECT user_idx, action FROM train INTERSECT SELECT user_idx, action FROM evs WHERE part = 'test'))
SELECT count(*) AS evaluation_users, count(n) AS reachable_users, count(*) - count(n) AS cold_users,
  coalesce(quantile_cont(n, 0.5), 0)::DOUBLE AS median_history, CAST(coalesce(sum(n), 0) AS BIGINT) AS evaluation_user_rows,
  max(overlap_cells) AS overlap_cells, quantile_cont(n, 0.5) < 20 AS thin_history,
  'warm: ' || max(overlap_cells) || ' cells' AS regime FROM j, x""")
def evaluation_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = event_parts(spark, sf_dir)
    train = rounds.filter("part = 'train'")
    return overlap.evaluation_reachability(train, train, rounds.filter("part = 'test'"))


@query("SUM1", sql=ctes(EVENT_SPLIT) + """
SELECT count(*) AS n_interactions, round(avg(reward), 9) AS mean_reward, 0::BIGINT AS n_train,
  count(*) FILTER (part = 'validation') AS n_validation, count(*) FILTER (part = 'test') AS n_test,
  round(min(propensity), 9) AS propensity_min, round(max(propensity), 9) AS propensity_max, false AS propensity_is_constant FROM test""")
def scored_rounds_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = propensity.enumerated_propensities(event_parts(spark, sf_dir).filter("part <> 'train'"))
    return rounded(rounds_summary(test), "mean_reward", "propensity_min", "propensity_max")


@query("SUM2", sql=ctes(LINE_ROUNDS) + "SELECT count(*) AS n_rows, round(avg(reward), 9) AS positive_rate, count(DISTINCT action) AS n_items FROM ln")
def log_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(describe_matrix(line_rounds(spark, sf_dir), "action", "reward"), "positive_rate")


@query("SUM2", sql=ctes(EVENT_SPLIT) + """SELECT count(*) AS n_rows, round(avg(reward), 9) AS positive_rate, count(DISTINCT action) AS n_items,
  round(min(propensity), 9) AS propensity_min, round(max(propensity), 9) AS propensity_max FROM test""")
def scored_log_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with propensities: click rate and propensity range as well."""
    test = propensity.enumerated_propensities(event_parts(spark, sf_dir).filter("part <> 'train'"))
    return rounded(describe_matrix(test, "action", "reward", "propensity"), "positive_rate", "propensity_min", "propensity_max")


# ------------------------------------------------------------------ propensities

_BEHAVIOUR = """bp AS (SELECT user_idx, action, count(*) AS n_pair FROM train GROUP BY ALL),
bu AS (SELECT user_idx, count(*) AS n_user FROM train GROUP BY ALL),
bm AS (SELECT a.action, (coalesce(n, 0) + 1.0::DOUBLE) / ((SELECT count(*) FROM train) + (SELECT count(*) FROM acts)) AS marginal
  FROM acts a LEFT JOIN (SELECT action, count(*) AS n FROM train GROUP BY ALL) USING (action)),
bs AS (SELECT e.*, (coalesce(n_pair, 0) + 10.0::DOUBLE * marginal) / (coalesce(n_user, 0) + 10.0::DOUBLE) AS propensity, n_user IS NULL AS unseen
  FROM evs e JOIN bm USING (action) LEFT JOIN bp USING (user_idx, action) LEFT JOIN bu USING (user_idx))"""


@query("PRO1", sql=ctes(EVENT_SPLIT, _BEHAVIOUR) + "SELECT action, round(marginal, 9) AS marginal FROM bm")
def behaviour_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = event_parts(spark, sf_dir).filter("part = 'train'")
    policy = propensity.fit_behaviour_policy(train, n_events_actions(spark, sf_dir))
    return rounded(policy.marginal, "marginal")


@query("PRO2", "JOIN4", sql=ctes(EVENT_SPLIT, _BEHAVIOUR) + "SELECT round_id, round(propensity, 9) AS propensity FROM bs WHERE part <> 'train'")
def behaviour_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = event_parts(spark, sf_dir)
    policy = propensity.fit_behaviour_policy(rounds.filter("part = 'train'"), n_events_actions(spark, sf_dir))
    scored = propensity.score_rounds(policy, rounds.filter("part <> 'train'"), ["round_id"])
    return scored.select("round_id", r9("propensity").alias("propensity"))


@query("PRO3", sql=ctes(EVENT_SPLIT, _BEHAVIOUR) + """
SELECT round(avg(ln(propensity)), 9) AS mean_log_likelihood, round(ln(1.0::DOUBLE / (SELECT count(*) FROM acts)), 9) AS uniform_log_likelihood,
  round(min(propensity), 9) AS propensity_min, round(max(propensity), 9) AS propensity_max,
  round(avg(CASE WHEN unseen THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS unseen_user_fraction,
  avg(ln(propensity)) > ln(1.0::DOUBLE / (SELECT count(*) FROM acts)) AS beats_uniform FROM bs WHERE part = 'test'""")
def behaviour_fit_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = event_parts(spark, sf_dir)
    policy = propensity.fit_behaviour_policy(rounds.filter("part = 'train'"), n_events_actions(spark, sf_dir))
    out = propensity.behaviour_diagnostics(policy, rounds.filter("part = 'test'"))
    return rounded(out, "mean_log_likelihood", "uniform_log_likelihood", "propensity_min", "propensity_max", "unseen_user_fraction")


@query("PRO4", sql=ctes(BLOCK) + """, c AS (SELECT user_idx, action, count(*) AS n FROM bl GROUP BY ALL),
p AS (SELECT n, n / (sum(n) OVER (PARTITION BY user_idx))::DOUBLE AS p FROM c)
SELECT CAST(sum(n) AS BIGINT) AS block_rows, count(*) AS block_distinct_cells, round(sum(n) / count(*)::DOUBLE, 9) AS block_rows_per_cell,
  round(min(p), 9) AS block_propensity_min, round(max(p), 9) AS block_propensity_max, sum(n) / count(*)::DOUBLE <= 1.5 AS is_enumeration FROM p""")
def enumeration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = propensity.enumeration_diagnostics(order_rows(spark, sf_dir))
    return rounded(out, "block_rows_per_cell", "block_propensity_min", "block_propensity_max")


@query("PRO4", sql=ctes(BLOCK) + """
SELECT row_seq, round(count(*) OVER (PARTITION BY user_idx, action) / (count(*) OVER (PARTITION BY user_idx))::DOUBLE, 9) AS propensity FROM bl""")
def enumerated_round_propensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = propensity.enumerated_propensities(order_rows(spark, sf_dir), ["row_seq"])
    return out.select("row_seq", r9("propensity").alias("propensity"))


@query("PRO5", sql=ctes(EVENT_SPLIT, _BEHAVIOUR) + """
SELECT part, round(avg(propensity), 9) AS mean_propensity, 'eval_block:enumerated_empirical | log:estimated:user_conditional_shrinkage(alpha=10)' AS propensity_source
FROM (SELECT part, propensity FROM bs WHERE part <> 'test' UNION ALL
  SELECT part, count(*) OVER (PARTITION BY user_idx, action) / (count(*) OVER (PARTITION BY user_idx))::DOUBLE FROM evs WHERE part = 'test') GROUP BY part""")
def assigned_propensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = EvaluationParams(behaviour_policy="estimated")
    out, _ = propensity.assign_propensities(event_parts(spark, sf_dir), n_events_actions(spark, sf_dir), params, block_part="test")
    return rounded(out.groupBy("part", "propensity_source").agg(F.avg("propensity").alias("mean_propensity")), "mean_propensity")


@query("PREP", "SUM1", "D7", "JOIN5", sql=ctes(_PAIRS) + """, u AS (SELECT user_id FROM lg UNION SELECT user_id FROM blk),
i AS (SELECT DISTINCT item_id FROM blk), gi AS (SELECT item_id FROM lg UNION SELECT item_id FROM i)
SELECT (SELECT count(*) FROM u) AS n_users, (SELECT count(*) FROM i) AS n_actions, (SELECT count(*) FROM gi) AS graph_item_universe,
  (SELECT count(*) FROM u) + (SELECT count(*) FROM gi) AS graph_nodes, (SELECT count(*) FROM blk) AS n_test,
  (SELECT floor(count(*) * (0.8::DOUBLE / (0.8::DOUBLE + 0.1::DOUBLE))) FROM lg)::BIGINT AS representation_rows,
  'eval_block:enumerated_empirical | log:estimated:user_conditional_shrinkage(alpha=10)' AS propensity_source""")
def prepared_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log and block through the whole preparation; the summary row is returned."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), micros("l_shipdate").alias("t"),
        (F.col("l_quantity") >= 25).cast("double").alias("reward"),
        F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity",
                          "l_discount", "l_tax")).alias("row_key"))
    with tasks_by_rows(spark, table(spark, sf_dir, "lineitem").count()):
        rows = durable(rows, ("row_key",))  # joined once for log, block, indexes and universe
    release(spark)
    in_block = (F.col("user_id") % 3 == 0) & (F.col("item_id") % 5 == 0)
    params = Params(split=BY_TIME, dataset=DatasetParams(),
                    evaluation=EvaluationParams(behaviour_policy="estimated"))
    block = rows.filter(in_block)
    log = rows.filter(~in_block | (F.col("item_id") % 10 == 0))
    out = prepare(log, params, "row_key", block, action_universe=block.select("item_id").distinct())
    return out.summary.select(
        F.col("n_users").cast("long"), F.col("n_actions").cast("long"), F.col("graph_item_universe").cast("long"),
        F.col("graph_nodes").cast("long"), "n_test", "representation_rows", "propensity_source")
