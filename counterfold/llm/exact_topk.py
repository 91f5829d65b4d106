"""Exact top-k inner products over norm-sorted vectors.

Vectors are range-partitioned by descending length and cut into groups of
blocks.  The group of the longest vectors is searched first and gives every
query a threshold.  Another group is only visited by query blocks that its
longest vector could help; within it, blocks come by descending length and are
left as soon as length alone rules them out.  In a block, partial sums over
the first coordinates of an SVD-rotated copy, plus the Cauchy-Schwarz bound of
the rest, leave the pairs whose exact integer product is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.llm.vectors import MEETING, matrix, meet, meeting_rows, one_per_id, ranked, usable
from counterfold.session import durable

#: Vectors in a block, blocks in a group, queries in a block.
BLOCK = 1_024
GROUP_BLOCKS = 8
QUERY_BLOCK = 512
#: Vectors the rotation is fitted on, at most (expected); any rotation gives the same results.
ROTATION_ROWS = 20_000
#: Coordinates in the partial sums, as a share of all.
PARTIAL = 0.5
#: Share of a block's pairs beyond which one matrix product is cheaper than single ones.
DENSE = 0.05


def _rotation(vectors: DataFrame, n: int, dims: int) -> np.ndarray:
    """Right singular vectors of a bounded sample, strongest first."""
    share = min(1.0, ROTATION_ROWS / max(1, n))
    picked = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * ROTATION_ROWS)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch, dims, np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["gram"])

    got = picked.repartition(1).mapInArrow(gram, "gram binary").collect()
    _, basis = np.linalg.eigh(np.frombuffer(got[0].gram).reshape(dims, dims))
    return basis[:, ::-1].copy()


def _blocks(dims: int, group_rows: int):
    """Sorted vectors to blocks; consecutive blocks of a partition make a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                x = matrix(piece, dims, np.int64)
                longest = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max()))
                yield meeting_rows([(
                    (part << 32) + done // group_rows, 0, done, piece.num_rows, piece.column("vec_id").to_numpy().astype(np.int64).tobytes(),
                    x.tobytes(), np.float64(longest).tobytes())])
                done += piece.num_rows
    return run


class _Kernel:
    score_type = pa.int64()

    def __init__(self, dims: int, k: int, basis: np.ndarray, thresholds_only_from: bool = False) -> None:
        self.dims, self.k, self.basis = dims, k, basis
        self.head = max(1, int(dims * PARTIAL))

    def _parse(self, row: dict) -> tuple:
        x = np.frombuffer(row["data"], np.int64).reshape(-1, self.dims)
        r = x.astype(np.float64) @ self.basis
        return (np.frombuffer(row["ids"], np.int64), x, r, np.sqrt((r[:, self.head:] ** 2).sum(1)), np.sqrt((r**2).sum(1)))

    def __call__(self, held: dict, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blocks = held.setdefault("blocks", [])
        blocks += [self._parse(r) for r in held["rows"][len(blocks):]]
        q_ids, q, q_r, q_rest, q_norm = self._parse(row)
        floor = np.frombuffer(row["extra"], np.float64).copy()  # a score below it can't be among the k best
        n = len(q_ids)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]
        big = max(1, np.abs(q).max(initial=0))
        for ids, x, r, rest, norm in blocks:
            slack = 1e-6 * (1 + q_norm * norm.max())
            live = np.flatnonzero(q_norm * norm.max() + slack >= floor)
            if not len(live):
                break  # blocks come by descending length
            bound = q_r[live, :self.head] @ r[:, :self.head].T + np.outer(q_rest[live], rest)
            at, to = np.nonzero(bound + slack[live, None] >= floor[live, None])
            own = q_ids[live[at]] == ids[to]
            at, to = at[~own], to[~own]
            if len(at) > DENSE * bound.size and self.dims * big * max(1, np.abs(x).max()) < 2**53:
                score = (q[live].astype(np.float64) @ x.T.astype(np.float64))[at, to].astype(np.int64)
            else:
                score = np.concatenate([np.zeros(0, np.int64), *(
                    (q[live[at[s:s + 65536]]] * x[to[s:s + 65536]]).sum(1) for s in range(0, len(at), 65536))])
            good = score >= floor[live[at]]
            at, to, score = at[good], to[good], score[good]
            starts = np.searchsorted(at, np.arange(len(live) + 1))
            for i, a, b in zip(live.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if a == b:
                    continue
                s, v = np.concatenate([best[i][0], score[a:b]]), np.concatenate([best[i][1], ids[to[a:b]]])
                if len(s) > self.k:
                    keep = np.lexsort((v, -s))[:self.k]
                    s, v = s[keep], v[keep]
                if len(s) == self.k:
                    floor[i] = max(floor[i], s.min())
                best[i] = (s, v)
        counts = [len(s) for s, _ in best]
        return (np.repeat(q_ids, counts), np.concatenate([v for _, v in best]), np.concatenate([s for s, _ in best]))


def exact_top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """The ``k`` largest integer inner products of each query with all other vectors.

    ``vectors`` has ``vec_id`` and ``vector`` (array of long); ``is_query`` is a
    condition on ``vec_id``.  Returns ``query_id``, ``rank`` from 1, ``vec_id``
    and ``score``; ties go to the smaller id, and a query gets all others if
    they are fewer.  Null vectors, vectors holding null and rows without an id
    take no part; rows with the same id count once (the least vector); vectors
    of different lengths are compared as if filled with zeros.  No vectors, or
    no queries, give no rows.
    """
    clean = durable(one_per_id(vectors.where(usable(F.col("vector"))), "vector").withColumn(
        "norm", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    n, dims = clean.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not n:
        return clean.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    basis = _rotation(clean, n, dims)
    spark = clean.sparkSession
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_rows = int(min(BLOCK * GROUP_BLOCKS, max(BLOCK, -(-n // at_once))))
    blocks = durable(
        clean.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
        .select("vec_id", "vector").mapInArrow(_blocks(dims, group_rows), MEETING))
    groups = durable(blocks.groupBy("group").agg(F.max(_as_double("extra")).alias("longest"), F.sum("n").alias("n")))
    first = groups.orderBy(F.desc("longest"), "group").first()["group"]
    asked = clean.where(is_query).select("vec_id", "vector")

    def blocked(with_floor: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, done = TaskContext.get().partitionId(), 0
            for batch in batches:
                for start in range(0, batch.num_rows, QUERY_BLOCK):
                    piece = batch.slice(start, QUERY_BLOCK)
                    x = matrix(piece, dims, np.int64)
                    floor = np.full(piece.num_rows, -np.inf)
                    if with_floor:
                        known = piece.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                        floor = np.where(np.isnan(known), -np.inf, known)
                    yield meeting_rows([(
                        0, 1, (part << 32) + done, piece.num_rows, piece.column("vec_id").to_numpy().astype(np.int64).tobytes(),
                        x.tobytes(), floor.tobytes())])
                    done += 1
        return run

    kernel = _Kernel(dims, k, basis)
    # the first group is copied for as many tasks as there are query blocks to deal among them
    asking = durable(asked.mapInArrow(blocked(False), MEETING))
    copies = max(1, min(at_once, asking.count()))
    seeds = durable(meet(
        blocks.where(F.col("group") == first).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))),
        asking.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(copies)).cast("long")), copies, kernel))
    floors = seeds.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("got")).select(
        F.col("query_id"), F.when(F.col("got") >= k, F.col("low").cast("double")).alias("floor"))
    with_floor = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select("vec_id", "vector", "floor")
    others = groups.where(F.col("group") != first)
    # one row per query block times one per group, only where lengths allow a better score
    query_blocks = durable(with_floor.mapInArrow(blocked(True), MEETING)).drop("group")
    reach = query_blocks.select("key", _reach_column(dims).alias("reach"))
    pairs = reach.crossJoin(others.select("group", "longest")).where(F.expr(
        "exists(reach, r -> r.norm * longest * (1 + 1e-9) + 1e-6 >= r.floor)")).select("key", "group")
    visits = pairs.join(query_blocks, "key").select(blocks.columns)
    rest = meet(blocks.where(F.col("group") != first), visits, max(1, groups.count() - 1), kernel)
    return ranked(seeds.unionByName(rest), k)


def _as_double(column: str):
    @F.pandas_udf("double")
    def read(values):
        return values.map(lambda b: float(np.frombuffer(b, np.float64)[0]))

    return read(F.col(column))


def _reach_column(dims: int):
    """Length and threshold of each query of a block."""
    @F.pandas_udf("array<struct<norm:double,floor:double>>")
    def read(data, extra):
        import pandas as pd

        out = []
        for d, e in zip(data, extra, strict=True):
            x = np.frombuffer(d, np.int64).reshape(-1, dims).astype(np.float64)
            out.append([{"norm": a, "floor": b} for a, b in zip(
                np.sqrt((x**2).sum(1)).tolist(), np.frombuffer(e, np.float64).tolist(), strict=True)])
        return pd.Series(out)

    return read(F.col("data"), F.col("extra"))
