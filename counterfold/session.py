"""Session settings and durable materialisation."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "counterfold", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only when a session names none (tests, laptops) is a temporary folder made.
    """
    jsc = spark.sparkContext._jsc.sc()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if jsc.getCheckpointDir().isEmpty():
        refuse_local = not spark.sparkContext.master.startswith("local")
        if refuse_local:
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder shared by all executors; "
                "a machine-local folder would not survive losing an executor"
            )
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="counterfold-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def _as_bytes(df: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``df`` with its hexadecimal texts as half as many bytes, and the columns that undo it; other texts stay."""
    undo, types = [], dict(df.dtypes)
    for name in df.columns:
        if name in columns and types[name] == "string":
            back = F.lower(F.hex(F.unhex(name)))
            df = df.withColumn(f"__{name}", F.when(back == F.col(name), F.unhex(name))).withColumn(
                name, F.when(F.col(f"__{name}").isNull(), F.col(name)))
            undo.append(F.coalesce(name, F.lower(F.hex(f"__{name}"))).alias(name))
        else:
            undo.append(F.col(name))
    return df, undo


def durable(df: DataFrame, digests: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    Used where a plan must not be evaluated twice with different outcomes
    (range partitioning samples its input) and to cut the lineage of iterations.
    The result survives the loss of any executor.  Texts of the columns ``digests`` take half the space if hexadecimal.
    """
    if digests:
        shorter, undo = _as_bytes(df, digests)
        return durable(shorter).select(*undo)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Give back shuffle files and checkpoints that nothing refers to any more.

    Spark drops them when the driver's JVM collects its garbage, which a driver with
    little to do may put off until the disks are full.
    """
    spark.sql("VALUES 1").collect()  # the listeners' queues keep the last query that ended, and all it wrote
    with contextlib.suppress(Py4JError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5_000)
    gc.collect()
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while waiting:  # what Python let go of, else told to the JVM once a second
        try:
            client, target = waiting.pop()
        except (IndexError, TypeError, ValueError):
            break
        client.garbage_collect_object(target, False)
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
