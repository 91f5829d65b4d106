"""Second moments of context vectors per key, summed where the rows are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of sums a task holds before it sends them on.
HELD_BYTES = 128 * 1024 * 1024


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """A column of arrays of ``dim`` numbers as a matrix."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and not (sizes == dim).all():
        raise ValueError(f"context has {int(sizes[sizes != dim][0])} entries, expected {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lists_of(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of arrays."""
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, width, dtype=np.int32)), pa.array(rows.ravel()))


def moment_sums(rows: DataFrame, keys: list[str], dim: int, weight: str = "w", response: str = "s", vector: str = "context") -> DataFrame:
    """``(keys..., xx, xs, w, n)``: sums of ``weight`` x x', of ``response`` x, of ``weight``, and the rows.

    ``response`` is already weighted.  Each task sums its own rows per key and
    sends one row per key; sums are added in the JVM.  A key holding most of the rows is
    summed in all tasks alike, and a task with very many keys sends sums early.
    """
    most = max(1, HELD_BYTES // (8 * (dim * dim + dim)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            sums = list(held.values())
            return pa.RecordBatch.from_arrays(
                [*(pa.array(k, batch.column(c).type) for c, k in zip(keys, zip(*held, strict=True), strict=True)),
                 lists_of(np.stack([s[0].ravel() for s in sums])), lists_of(np.stack([s[1] for s in sums])),
                 pa.array([float(s[2]) for s in sums]), pa.array([int(s[3]) for s in sums])], names=[*keys, "xx", "xs", "w", "n"])

        batch = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(held) > most:
                yield out()
                held = {}
            x = matrix_of(batch.column(vector), dim)
            w, s = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in (weight, response))
            names, group = np.unique(_codes(batch, keys), return_inverse=True)
            order = np.argsort(group, kind="stable")
            edges = np.searchsorted(group[order], np.arange(len(names) + 1))
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                mine = order[begin:end]
                key = tuple(batch.column(c)[int(mine[0])].as_py() for c in keys)
                xw = x[mine] * w[mine, None]
                add = [xw.T @ x[mine], s[mine] @ x[mine], w[mine].sum(), end - begin]
                held[key] = [a + b for a, b in zip(held[key], add, strict=True)] if key in held else add
        if held:
            yield out()

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "xx array<double>, xs array<double>, w double, n long"])
    parts = rows.select(*keys, F.col(weight).cast("double").alias(weight), F.col(response).cast("double").alias(response), vector).mapInArrow(partial, schema)
    return merge_moments(parts, keys)


def _codes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """One whole number for each row, the same for the same keys."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in keys:
        new = batch.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code * (int(new.max(initial=0)) + 1) + new, return_inverse=True)
    return code


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Add up sums of the same keys; summing in pieces equals summing at once."""
    return parts.groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector("xx"))).alias("xx"),
        vector_to_array(Summarizer.sum(array_to_vector("xs"))).alias("xs"), F.sum("w").alias("w"), F.sum("n").alias("n"))
