"""Result files, run records and the sinks that write them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterfold.errors import refuse_if
from counterfold.sources.logs import _exists

_D, _L, _S, _I = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType()

RESULT_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in [
    ("agent", _S), ("dataset", _S), ("state_source", _S), ("cate_reward_weight", _D), ("seed", _L),
    ("n_test_rounds", _L), ("estimator", _S), ("value", _D), ("ci_lower", _D), ("ci_upper", _D),
    ("n_samples", _L), ("effective_sample_size", _D), ("status", _S), ("detail", _S), ("warnings", _S),
    ("resampling_unit", _S), ("n_independent_units", _L), ("bootstrap_method", _S), ("n_bootstrap", _I),
    ("confidence_level", _D), ("propensity_source", _S), ("q_model", _S), ("evaluation_regime", _S),
    ("n_distinct_contexts", _L), ("exact_rounds_scored", _L), ("exact_rounds_masked", _L),
]])
RUN_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in [
    ("variant", _S), ("seed", _L), ("status", _S), ("seconds", _D), ("error", _S),
    ("phases", T.ArrayType(_S)), ("traceback", _S),
]])
ENCODER_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in [
    ("architecture", _S), ("dataset", _S), ("seed", _L), ("best_val_loss", _D), ("train_seconds", _D),
]])

# Markers of runs that must not reach a comparison table, and the
# pattern of a result file's name, which alone records its experiment and seed.
NON_REPORTABLE = ("smoke", "fast", "sage")
RESULT_NAME = r"^phase4_ope_(.+)_seed(-?\d+)\.json$"


def is_reportable(experiment: str = "experiment"):
    return ~F.col(experiment).rlike("|".join(NON_REPORTABLE))


def read_results(
    spark: SparkSession, folder: str, dataset: str | None = None, require_nonempty: bool = False
) -> DataFrame:
    """Evaluation result files; the experiment and seed come from the file name."""
    rows = (
        spark.read.option("multiLine", True).schema(RESULT_SCHEMA)
        .json(f"{folder}/phase4_ope_*.json")
        .select("*", F.col("_metadata.file_name").alias("source_file"))
    )
    rows = rows.withColumn("experiment", F.regexp_extract("source_file", RESULT_NAME, 1))
    bad = [r[0] for r in rows.filter(F.col("experiment") == "").select("source_file").distinct().limit(10).collect()]
    refuse_if(bool(bad), "unnamed_experiment", "file names do not tell their experiment", files=bad)
    rows = rows.filter(is_reportable())
    if dataset is not None:
        rows = rows.filter(F.col("dataset") == dataset)
    refuse_if(require_nonempty and rows.isEmpty(), "no_results", f"no result rows in {folder}")
    return rows


def read_run_records(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/experiment_runs.json"
    if not _exists(spark, path):
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.option("multiLine", True).schema(RUN_SCHEMA).json(path).filter(
        F.col("variant").isNotNull() & F.col("seed").isNotNull()
    )


def attribute_runs(records: DataFrame, experiments: DataFrame) -> DataFrame:
    """Match run records to experiments by variant suffix.

    Both sides are run bookkeeping, one row per launched run.  The suffixes of
    an experiment name that follow an underscore are spelled out, so the match
    is an equi-join.
    """
    parts = F.split("experiment", "_")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_")
    )
    keys = experiments.select("experiment").distinct().select(
        "experiment", F.explode(F.array_distinct(suffixes)).alias("variant")
    )
    return records.join(keys, "variant", "left").select(
        "variant", "experiment", "seed", "status", "error",
        F.col("experiment").isNull().alias("unattributed"),
    )


def attempted_seeds(attributed: DataFrame) -> DataFrame:
    """``(experiment, seed, run_status)`` of every attempt that was not skipped."""
    return attributed.filter(~F.col("unattributed") & (F.col("status") != "skipped")).select(
        "experiment", "seed", F.col("status").alias("run_status")
    ).distinct()


def unattributed_failures(attributed: DataFrame) -> DataFrame:
    return attributed.filter(F.col("unattributed") & ~F.col("status").isin("ok", "skipped")).select(
        "variant", "seed", F.coalesce("error", "status").alias("reason")
    )


def read_encoder_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(ENCODER_SCHEMA).json(f"{folder}/phase1_*.json")


def summarise_encoders(runs: DataFrame) -> DataFrame:
    """Mean and sample deviation of the held-out loss per architecture, best first."""
    return runs.groupBy("architecture").agg(
        F.avg("best_val_loss").alias("mean_loss"),
        F.coalesce(F.stddev_samp("best_val_loss"), F.lit(0.0)).alias("std_loss"),
        F.count("*").alias("n_runs"),
    ).orderBy("mean_loss", "architecture")


# ------------------------------------------------------------------ sinks


def fingerprint(params: dict) -> str:
    """Key of an artefact: a digest over ALL its inputs in a canonical form."""
    text = json.dumps(params, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def write_results(df: DataFrame, path: str, fmt: str = "json", partition_by: tuple[str, ...] = ()) -> None:
    """Result sink; ``experiment`` and ``seed`` are natural partition columns."""
    flat = df
    if fmt == "csv":
        for field in df.schema.fields:
            if isinstance(field.dataType, T.ArrayType):
                flat = flat.withColumn(field.name, F.array_join(F.col(field.name).cast("array<string>"), ";"))
    writer = flat.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def data_manifest(spark: SparkSession, paths: list[str]) -> dict:
    """What tells one state of the input files from another: a digest of their names, lengths and change times.

    Digests of single files are added up as they are listed, so the number of
    files does not matter.  Works on any file system that Spark reads.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = files = size = 0
    for path in sorted(paths):
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(conf)
        refuse_if(not fs.exists(root), "input_missing", path)
        listed = fs.listFiles(root, True)
        while listed.hasNext():
            f = listed.next()
            text = f"{path}|{f.getPath().toUri().getPath()}|{f.getLen()}|{f.getModificationTime()}"
            total = (total + int(hashlib.sha256(text.encode()).hexdigest(), 16)) % (1 << 256)
            files, size = files + 1, size + f.getLen()
    return {"files": files, "bytes": size, "digest": f"{total:064x}"}


def materialise(spark: SparkSession, folder: str, params: dict, build, force: bool = False, inputs: list[str] | None = None) -> DataFrame:
    """Reuse ``folder/<fingerprint>`` when it is complete, else build and write it.

    The fingerprint covers ``params`` and the state of all files below ``inputs``,
    so data that changed are prepared anew and what was made of the old ones stays.
    """
    key = params if inputs is None else {**params, "inputs": data_manifest(spark, inputs)}
    path = f"{folder}/{fingerprint(key)}"
    if force or not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
        record = spark.createDataFrame([(json.dumps(key, sort_keys=True, default=str),)], "params string")
        record.coalesce(1).write.mode("overwrite").text(f"{path}.params")
    return spark.read.parquet(path)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.select("node_id", "embedding").write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, dim: int | None = None, nodes: int | None = None) -> DataFrame:
    """Embeddings with their keys, width and finiteness checked."""
    frame = spark.read.parquet(path)
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    row = frame.agg(
        F.count("*").alias("n"), F.count_distinct("node_id").alias("keys"),
        F.count_if(~ok).alias("bad"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"),
    ).first()
    refuse_if(row["n"] == 0, "no_embeddings", path)
    refuse_if(row["bad"] > 0, "non_finite_embeddings", path, vectors=row["bad"])
    refuse_if(row["keys"] != row["n"], "duplicate_embedding_keys", path, rows=row["n"], keys=row["keys"])
    refuse_if(row["lo"] != row["hi"] or (dim is not None and row["lo"] != dim), "embedding_width",
              path, widths=(row["lo"], row["hi"]), expected=dim)
    refuse_if(nodes is not None and row["n"] != nodes, "embedding_rows", path, rows=row["n"], expected=nodes)
    return frame


def write_cate(cate: DataFrame, path: str) -> None:
    cate.select("round_id", "estimator", "cate").write.mode("overwrite").partitionBy("estimator").parquet(path)


def read_cate(spark: SparkSession, path: str, estimator: str, rounds: DataFrame) -> DataFrame:
    """Effect estimates of one estimator, complete over ``rounds`` by key."""
    frame = spark.read.parquet(path).filter(F.col("estimator") == estimator)
    lost = rounds.select("round_id").join(frame.select("round_id"), "round_id", "left_anti").count()
    refuse_if(lost > 0, "effects_incomplete", path, rounds_without_effect=lost)
    return frame.select("round_id", "estimator", "cate")


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
