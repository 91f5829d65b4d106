"""What the two vector searches share: clean vectors, and queries that meet candidate groups.

Candidates are dealt into groups of bounded size.  Query blocks are sent to the
groups they need, and within a task a group's candidates come first, so that a
task holds one group and one query block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows on their way to a group: kind 0 holds candidates, kind 1 a query block.
MEETING = "group long, kind int, key long, n long, ids binary, data binary, extra binary"
_NAMES = ["group", "kind", "key", "n", "ids", "data", "extra"]


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components; a null vector isn't usable."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def one_per_id(df: DataFrame, vector: str) -> DataFrame:
    """``vec_id`` and ``vector`` once for each id (of several, the least); rows without an id are left out."""
    return df.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(vector).alias("vector"))


def matrix(batch: pa.RecordBatch, dims: int, dtype: type, column: str = "vector") -> np.ndarray:
    """Vectors of a batch as rows; shorter ones are filled with zeros."""
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if len(flat) == dims * batch.num_rows:
        return flat.reshape(-1, dims)
    out = np.zeros((batch.num_rows, dims), dtype)
    for row, v in enumerate(values.to_pylist()):
        out[row, :len(v)] = v
    return out


def meeting_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_NAMES)


def meet(candidates: DataFrame, queries: DataFrame, groups: int, kernel: Callable) -> DataFrame:
    """``kernel(held, query_row)`` for every query block and the candidates of its group.

    ``held`` is the list of candidate rows of the group, as dictionaries;
    the kernel returns arrays (query_id, vec_id, score) and may add to ``held``.
    """
    dtype = kernel.score_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    group, held = row["group"], {"rows": []}
                if row["kind"] == 0:
                    held["rows"].append(row)
                    continue
                q, v, s = kernel(held, row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, dtype)], names=["query_id", "vec_id", "score"])

    score = "long" if dtype == pa.int64() else "double"
    return (
        candidates.unionByName(queries).repartition(max(1, groups), "group")
        .sortWithinPartitions("group", "kind", "key")
        .mapInArrow(run, f"query_id long, vec_id long, score {score}")
    )


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query: ``query_id``, ``rank``, ``vec_id``, ``score``; ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
