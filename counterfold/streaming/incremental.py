"""Operators that grow with the log, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfold.operators.encoding import new_values
from counterfold.operators.ope import ipw_value, kish_ess, snipw_value
from counterfold.operators.policies import linucb_statistics, merge_linucb
from counterfold.params import EPSILON


def running_estimates(rounds: DataFrame, policies: DataFrame) -> DataFrame:
    """IPW, SNIPW and ESS per agent so far; ``rounds`` may be a stream.

    The state is one row with the sums of every agent.  The agents of a (context,
    action) travel with the round as one array, so no round is repeated; an
    agent's weight is zero where its policy has no row.
    """
    per_cell = policies.groupBy("context_id", "action").agg(
        F.map_from_entries(F.collect_list(F.struct("agent", "prob"))).alias("mine"))
    joined = rounds.join(per_cell, ["context_id", "action"], "left")
    names = [r["agent"] for r in policies.select("agent").distinct().orderBy("agent").collect()]
    sums = [F.count("*").alias("n")]
    for i, name in enumerate(names):
        w = F.coalesce(F.try_element_at("mine", F.lit(name)), F.lit(0.0)) / F.greatest("propensity", F.lit(EPSILON))
        sums += [F.sum(w).alias(f"w_{i}"), F.sum(w * w).alias(f"w2_{i}"), F.sum(w * F.col("reward")).alias(f"wr_{i}")]
    each = F.array(*[F.struct(
        F.lit(name).alias("agent"), F.col("n"), *[F.col(f"{c}_{i}").alias(c) for c in ("w", "w2", "wr")])
        for i, name in enumerate(names)])
    return joined.agg(*sums).select(F.explode(each).alias("a")).select("a.*").select(
        "agent", "n", ipw_value().alias("ipw"), snipw_value().alias("snipw"), kish_ess().alias("ess"))


class StoredState:
    """A table of state kept as a base and one delta per micro-batch.

    ``delta-<b>`` is what batch ``b`` added, ``base-<v>`` the state after all batches
    below ``v``; ``merge`` puts parts together.  A folder counts once its ``_SUCCESS`` file
    exists.  A batch that was already applied, as a delta or within the base, is
    skipped, which makes a replayed micro-batch harmless.  After ``compact_every``
    deltas they are merged into a new base, and only when it is complete do the
    parts it covers go; a crash in between leaves parts that no one reads and the next
    compaction removes.
    """

    def __init__(
        self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame] = lambda parts: parts, compact_every: int = 8,
    ) -> None:
        self.spark, self.folder, self.merge, self.compact_every = spark, folder.rstrip("/"), merge, compact_every
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _parts(self, finished: bool = True) -> tuple[list[int], list[int]]:
        """Versions of bases and batches of deltas, ascending; without ``finished`` those of dead writers too."""
        if not self._fs.exists(self._at("")):
            return [], []
        found: dict[str, list[int]] = {"base": [], "delta": []}
        for status in self._fs.listStatus(self._at("")):
            kind, _, number = status.getPath().getName().partition("-")
            if kind in found and (not finished or self._fs.exists(self._at(f"{kind}-{number}/_SUCCESS"))):
                found[kind].append(int(number))
        return sorted(found["base"]), sorted(found["delta"])

    def _live(self) -> tuple[int, list[int]]:
        """Version of the base (0 for none) and the deltas that come after it."""
        bases, deltas = self._parts()
        base = bases[-1] if bases else 0
        return base, [d for d in deltas if d >= base]

    def latest(self) -> int:
        """Batches applied so far: the largest of them and one; 0 for none."""
        base, deltas = self._live()
        return max([base, *(d + 1 for d in deltas)])

    def read(self) -> DataFrame | None:
        base, deltas = self._live()
        names = ([f"base-{base:012d}"] if base else []) + [f"delta-{d:012d}" for d in deltas]
        if not names:
            return None
        parts = self.spark.read.parquet(*[f"{self.folder}/{n}" for n in names])
        return self.merge(parts) if len(names) > 1 else parts

    def apply(self, batch_id: int, delta: Callable[[DataFrame | None], DataFrame]) -> bool:
        """Write what ``batch_id`` adds to the state so far; False if it was applied before."""
        base, deltas = self._live()
        if batch_id < base or batch_id in deltas:
            return False
        delta(self.read()).write.mode("overwrite").parquet(f"{self.folder}/delta-{batch_id:012d}")
        if len(deltas) + 1 >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        """One base in place of all parts."""
        version = self.latest()
        if version and self._live()[1]:
            self.read().write.mode("overwrite").parquet(f"{self.folder}/base-{version:012d}")
        bases, deltas = self._parts(finished=False)
        for name in [f"base-{b:012d}" for b in bases if b < version] + [f"delta-{d:012d}" for d in deltas if d < version]:
            self._fs.delete(self._at(name), True)


def linucb_state(spark: SparkSession, folder: str, compact_every: int = 8) -> StoredState:
    """Stored arm statistics: parts of the same arm add up."""
    return StoredState(spark, folder, merge_linucb, compact_every)


def linucb_sink(state: StoredState, dim: int) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function adding the arm statistics of each micro-batch, alone, to those of :func:`linucb_state`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        state.apply(batch_id, lambda _: linucb_statistics(batch, dim))

    return write


def vocabulary_sink(state: StoredState, column: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function adding each micro-batch's new values; no code ever changes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], "column_name string, value string, code long")
        state.apply(batch_id, lambda old: new_values(empty if old is None else old, batch, column))

    return write
