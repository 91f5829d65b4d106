"""Scans of logged interactions with explicit schemas and checked domains."""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterfold.errors import refuse_if
from counterfold.operators.overlap import block_overlap
from counterfold.operators.projections import require_columns
from counterfold.operators.sampling import sample_exact
from counterfold.session import durable

# The domains and thresholds a log must follow for equal results.
LOGGING_POLICIES = ("random", "bts")
CAMPAIGNS = ("all", "men", "women")
MATRICES = ("small_matrix", "big_matrix")
BANDIT_REQUIRED = ["item_id", "click", "propensity_score", "position", "timestamp"]
MATRIX_REQUIRED = ["user_id", "video_id", "watch_ratio", "play_duration", "video_duration"]
REWARD_THRESHOLD = 2.0
MAX_PARSE_FAILURES = 0.10

_BANDIT_TYPES = {
    "item_id": T.LongType(), "click": T.IntegerType(), "propensity_score": T.DoubleType(),
    "position": T.LongType(), "timestamp": T.StringType(),
}
_MATRIX_TYPES = {
    "user_id": T.LongType(), "video_id": T.LongType(), "watch_ratio": T.DoubleType(),
    "play_duration": T.DoubleType(), "video_duration": T.DoubleType(), "timestamp": T.DoubleType(),
}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _typed_csv(
    spark: SparkSession, path: str, types: dict[str, T.DataType], required: list[str],
    double_prefixes: tuple[str, ...] = (), overrides: dict[str, T.DataType] | None = None,
) -> DataFrame:
    """CSV scan with a schema built from the header alone; data is read once.

    Columns without a known type are read as text, so nothing is inferred.
    """
    refuse_if(not _exists(spark, path), "missing_file", path)
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(required) - set(header))
    refuse_if(bool(missing), "missing_column", f"{path} lacks required columns", missing=missing)
    known = {**types, **(overrides or {})}

    def type_of(name: str) -> T.DataType:
        if name in known:
            return known[name]
        return T.DoubleType() if name.startswith(double_prefixes or ("\0",)) else T.StringType()

    schema = T.StructType([T.StructField(c, type_of(c), True) for c in header])
    # the leading column of an exported index has no name
    frame = spark.read.option("header", True).schema(schema).csv(path)
    return frame.drop(*[c for c in header if c.startswith("_c") or c == ""])


def read_bandit_log(
    spark: SparkSession, root: str, policy: str, campaign: str, subsample_rows: int | None = None,
    seed: int = 42, row_key: str | None = None, types: dict[str, T.DataType] | None = None,
) -> DataFrame:
    """``<root>/<policy>/<campaign>/<campaign>.csv`` with its logged propensities.

    ``row_key`` names a unique column to sample by; it is needed only together
    with ``subsample_rows``.
    """
    refuse_if(policy not in LOGGING_POLICIES, "unknown_policy", policy)
    refuse_if(campaign not in CAMPAIGNS, "unknown_campaign", campaign)
    path = f"{root}/{policy}/{campaign}/{campaign}.csv"
    log = _typed_csv(spark, path, _BANDIT_TYPES, BANDIT_REQUIRED, ("user-item_affinity",), types)
    if "timestamp" not in (types or {}):
        log = typed_timestamps(log, "timestamp", path)
    if subsample_rows is None:
        return log
    refuse_if(row_key is None, "missing_row_key", "sampling needs a unique row key")
    return sample_exact(log, subsample_rows, seed, row_key)


def typed_timestamps(df: DataFrame, column: str, where: str = "the input") -> DataFrame:
    """Times given as text as what all of them are: long, double or timestamp; refused if neither.

    Text would order "10" before "2".  Null times stay null and order last.
    """
    text = F.trim(F.col(column))
    forms = {"bigint": text.try_cast("bigint"), "double": text.try_cast("double"), "timestamp": text.try_cast("timestamp")}
    given = F.col(column).isNotNull()
    row = df.agg(*[F.count_if(given & value.isNull()).alias(name) for name, value in forms.items()]).first()
    fitting = next((name for name in forms if row[name] == 0), None)
    refuse_if(fitting is None, "bad_timestamp", f"{where} has times in no single form", unparsed=row["timestamp"])
    return df.withColumn(column, forms[fitting])


def with_watch_reward(matrix: DataFrame, threshold: float = REWARD_THRESHOLD) -> DataFrame:
    """Binary reward: the item was watched at least ``threshold`` times over."""
    return matrix.withColumn("reward", (F.col("watch_ratio") >= F.lit(threshold)).cast("double"))


def _matrix_folder(spark: SparkSession, root: str, matrix: str) -> str:
    for folder in (root, f"{root}/data"):
        if _exists(spark, f"{folder}/{matrix}.csv"):
            return folder
    refuse_if(True, "missing_file", f"no {matrix}.csv under {root}")
    raise AssertionError


def read_interaction_matrix(
    spark: SparkSession, root: str, matrix: str, reward_threshold: float = REWARD_THRESHOLD,
    subsample_rows: int | None = None, seed: int = 42, row_key: str | None = None,
) -> DataFrame:
    """A user x item interaction matrix in long form with its binary reward."""
    refuse_if(matrix not in MATRICES, "unknown_matrix", matrix)
    folder = _matrix_folder(spark, root, matrix)
    frame = _typed_csv(spark, f"{folder}/{matrix}.csv", _MATRIX_TYPES, MATRIX_REQUIRED)
    frame = with_watch_reward(frame, reward_threshold)
    if subsample_rows is None:
        return frame
    refuse_if(row_key is None, "missing_row_key", "sampling needs a unique row key")
    return sample_exact(frame, subsample_rows, seed, row_key)


def matrix_metadata(matrix: DataFrame, name: str, threshold: float = REWARD_THRESHOLD) -> DataFrame:
    """One row: matrix name, sizes, threshold and positive rate."""
    return matrix.agg(
        F.lit(name).alias("matrix"), F.count("*").alias("n_rows"),
        F.count_distinct("user_id").alias("n_users"), F.count_distinct("video_id").alias("n_items"),
        F.lit(threshold).alias("reward_threshold"), F.avg("reward").alias("positive_rate"),
    )


def parse_social_lists(lists: DataFrame, user: str = "user_id", friends: str = "friend_list") -> DataFrame:
    """Directed edges out of list-in-text cells such as ``"[1, 2]"``.

    A row with any unparseable entry counts as failed and gives no edges; more
    than a tenth of failed rows is refused.
    """
    require_columns(lists, [user, friends], "social lists")
    inner = F.regexp_replace(F.trim(F.col(friends)), r"^\[+|\]+$", "")
    entries = F.filter(F.split(inner, ","), lambda x: F.trim(x) != "")
    parsed = F.transform(
        F.coalesce(entries, F.array().cast("array<string>")), lambda x: F.trim(x).try_cast("bigint")
    )
    rows = lists.select(F.col(user).alias("src"), parsed.alias("ids")).withColumn(
        "failed", F.exists("ids", lambda x: x.isNull())
    )
    tally = rows.agg(F.count("*").alias("n"), F.count_if("failed").alias("bad")).first()
    refuse_if(tally["bad"] > MAX_PARSE_FAILURES * max(1, tally["n"]), "social_lists_unparseable",
              "too many friend lists failed to parse", failed=tally["bad"], rows=tally["n"])
    return rows.filter(~F.col("failed")).select(
        F.col("src").cast("long"), F.explode("ids").alias("dst")
    )


def read_social_edges(spark: SparkSession, folder: str) -> DataFrame | None:
    path = f"{folder}/social_network.csv"
    if not _exists(spark, path):
        return None
    lists = spark.read.option("header", True).option("escape", '"').csv(path)
    require_columns(lists, ["user_id", "friend_list"], path)
    return parse_social_lists(lists.withColumn("user_id", F.col("user_id").cast("long")))


def read_user_features(spark: SparkSession, folder: str) -> DataFrame | None:
    """The optional side table of user features, every column as text but the id."""
    path = f"{folder}/user_features.csv"
    if not _exists(spark, path):
        return None
    return _typed_csv(spark, path, {"user_id": T.LongType()}, ["user_id"])


@dc.dataclass(frozen=True)
class TrainEvalPair:
    """A sparse training log and a separately collected evaluation block."""

    log: DataFrame
    eval_rounds: DataFrame
    eval_block: DataFrame
    action_universe: DataFrame
    overlap: DataFrame


def assemble_train_eval(
    log: DataFrame, block: DataFrame, user: str = "user_id", item: str = "video_id",
    eval_subsample_rows: int | None = None, seed: int = 42, row_key: str | None = None,
) -> TrainEvalPair:
    """Pair a log with its evaluation block; nothing is dropped from the log.

    Ground truth always comes from the WHOLE block, also when the evaluation
    rounds are sampled from it.
    """
    universe = durable(block.select(F.col(item).alias("item_id")).distinct())
    overlap = durable(block_overlap(log, block, universe, user, item))  # one row, read again by the caller
    row = overlap.first()
    refuse_if(row["eval_users_in_log"] == 0, "no_shared_users",
              "no evaluation user appears in the training log", eval_users=row["eval_users"])
    refuse_if(row["eval_item_log_rows"] == 0, "no_logged_actions",
              "no evaluation action appears in the training log", eval_items=row["eval_items"])
    rounds = block
    if eval_subsample_rows is not None:
        refuse_if(row_key is None, "missing_row_key", "sampling needs a unique row key")
        rounds = sample_exact(block, eval_subsample_rows, seed, row_key)
    return TrainEvalPair(log, rounds, block, universe, overlap)


def read_train_eval(
    spark: SparkSession, root: str, train_matrix: str, eval_matrix: str,
    reward_threshold: float = REWARD_THRESHOLD, eval_subsample_rows: int | None = None,
    seed: int = 42, row_key: str | None = None,
) -> TrainEvalPair:
    refuse_if(train_matrix == eval_matrix, "same_matrix",
              "training and evaluation must not read the same matrix", matrix=train_matrix)
    log = read_interaction_matrix(spark, root, train_matrix, reward_threshold)
    block = read_interaction_matrix(spark, root, eval_matrix, reward_threshold)
    return assemble_train_eval(log, block, eval_subsample_rows=eval_subsample_rows, seed=seed, row_key=row_key)
