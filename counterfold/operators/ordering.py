"""Global order at scale: dense indexes, prefix sums and exact order statistics.

A window without ``partitionBy`` sorts everything in one task.  Here the rows are
range-partitioned on a unique order key and sorted inside each partition.  Only
the first group of a partition can have begun in an earlier one, so one
offset per partition joins the partitions, whatever their number or size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterfold.functions.skew import spread_join
from counterfold.session import durable

#: Bits of the order key that one pass of a rank search decides.
_PASS_BITS = 11


def _ordering(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _sorted_slices(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` range-sorted, one slice per partition.

    Range boundaries come from sampling, so the layout is written out once; the
    offsets computed from it then always describe the same layout.
    """
    keys = _ordering(order)
    return durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys))


def _runs(batch: pa.RecordBatch, group: list[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a new group begins in sorted rows (null is a value like any other), and the last group."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for c in group:
        codes = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    first = repr([batch.column(c)[0].as_py() for c in group])
    new[0] = first != before
    return new, repr([batch.column(c)[n - 1].as_py() for c in group])


def _local(batches: Iterator[pa.RecordBatch], group: list[str], values: list[str]):
    """Each batch with the running count and sums within its group and partition."""
    before = None
    whole = [0] * (1 + len(values))  # exact for integers
    for batch in batches:
        if not batch.num_rows:
            continue
        new, last = _runs(batch, group, before)
        starts = np.flatnonzero(new)
        out = []
        for i, c in enumerate([None, *values]):
            x = np.ones(batch.num_rows, np.int64) if c is None else batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
            run = np.cumsum(x)
            shift = np.zeros(len(run), run.dtype)
            base = np.concatenate([[run.dtype.type(0)], run])[starts]
            if not len(starts) or starts[0] > 0:
                shift[:starts[0] if len(starts) else len(run)] = whole[i]
            if len(starts):
                shift[starts[0]:] = -np.repeat(base, np.diff(np.append(starts, len(run))))
            out.append(run + shift)
            whole[i] = out[-1][-1].item()
        before = last
        yield batch, new, last, out


def _running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str], index: str, group: Sequence[str]) -> DataFrame:
    groups = list(group)
    wide = {f.name: f.dataType for f in df.schema.fields}
    kinds = {new: T.LongType() if isinstance(wide[v], (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else T.DoubleType()
             for new, v in sums.items()}
    typed = df.withColumns({f"__v_{new}": F.col(v).cast(kinds[new]) for new, v in sums.items()}) if sums else df
    placed = _sorted_slices(typed, [*groups, *_ordering(order)])
    values = [f"__v_{new}" for new in sums]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = first_end = None
        last, end, several = None, None, False
        for _, new, last, out in _local(batches, groups, values):
            starts = np.flatnonzero(new)
            if first is None:
                first, begun = True, 1
            else:
                begun = 0
            if first_end is None and len(starts) > begun:
                at = starts[begun]
                first_end = [c[at - 1].item() for c in out] if at else end
                several = True
            end = [c[-1].item() for c in out]
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()]), pa.array([several]), pa.array([last]),
                 pa.array([[float(x) for x in (first_end or end)]]), pa.array([[float(x) for x in end]]),
                 pa.array([[int(x) for x in (first_end or end)]]), pa.array([[int(x) for x in end]])],
                names=["slice", "several", "last", "first_sums", "last_sums", "first_whole", "last_whole"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()]), pa.array([repr([batch.column(c)[0].as_py() for c in groups])])],
                    names=["slice", "key"])
                return

    # one row per partition
    found = placed.mapInArrow(
        edges, "slice long, several boolean, last string, first_sums array<double>, last_sums array<double>, "
        "first_whole array<long>, last_whole array<long>").collect()
    first_key = {r["slice"]: r["key"] for r in placed.select(*groups).mapInArrow(heads, "slice long, key string").collect()} if groups else {}
    exact = [True, *[isinstance(kinds[new], T.LongType) for new in sums]]
    pick = lambda r, side: [w if e else d for e, d, w in zip(exact, r[f"{side}_sums"], r[f"{side}_whole"], strict=True)]
    offsets: dict[int, list] = {}
    key, carried = None, [0] * len(exact)
    for r in sorted(found, key=lambda r: r["slice"]):
        goes_on = key is not None and first_key.get(r["slice"], "[]") == key
        offsets[r["slice"]] = carried if goes_on else [0] * len(exact)
        if r["several"]:
            carried = pick(r, "last")
        else:
            carried = [a + b for a, b in zip(offsets[r["slice"]], pick(r, "last"), strict=True)]
        key = r["last"]

    new_fields = [T.StructField(index, T.LongType()), *[T.StructField(n, kinds[n]) for n in sums]]
    kept = [f for f in df.schema.fields if f.name not in {n.name for n in new_fields}]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = offsets.get(TaskContext.get().partitionId(), [0] * len(exact))
        in_first, begun = True, 0
        for batch, new, _, out in _local(batches, groups, values):
            starts = np.flatnonzero(new)
            stop = 0
            if in_first:
                stop = batch.num_rows
                inner = starts[1 - begun:]
                if len(inner):
                    stop, in_first = int(inner[0]), False
                begun = 1
            columns = []
            for i, run in enumerate(out):
                run = run.copy()
                run[:stop] += run.dtype.type(before[i])
                columns.append(pa.array(run - 1 if i == 0 else run))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *(f.name for f in new_fields)])

    return placed.mapInArrow(add, T.StructType([*kept, *new_fields]))


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx", group: Sequence[str] = ()) -> DataFrame:
    """Add ``name`` = 0..n-1 in the given (unique) order, per ``group`` if any.

    A group larger than a task is split over several range slices and put
    together by offsets; no group is ever gathered.  Null is a group of its own.
    """
    return _running(df, order, {}, name, group)


def hashed_index(df: DataFrame, hashed: str, key: str, name: str = "idx", group: Sequence[str] = ()) -> DataFrame:
    """Add ``name`` = 0..n-1 per group in the order of a hash, then ``key``."""
    return dense_index(df, [hashed, key], name, group)


def prefix_sums(
    df: DataFrame, order: Sequence[str | Column], sums: dict[str, str], index: str = "idx", group: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums (``new column -> value column``) plus ``index``; a null value adds nothing."""
    return _running(df, order, sums, index, group)


# --------------------------------------------------------------------------- #
# exact order statistics without a sort


def _order_key(col: str, dtype: T.DataType) -> Column:
    """A long that orders as the value does; NaN comes last, as Spark has it."""
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.col(col).cast("long")

    @F.pandas_udf("long")
    def bits(values):
        import pandas as pd

        x = values.to_numpy(np.float64, na_value=np.nan) + 0.0  # -0.0 equals 0.0
        x = np.where(np.isnan(x), np.nan, x)  # one NaN
        i = x.view(np.int64)
        return pd.Series(i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))

    return F.when(F.col(col).isNotNull(), bits(F.col(col).cast("double")))


def _from_key(key: int, dtype: T.DataType):
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return key
    i = np.int64(key)
    return float((i ^ ((i >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def _values_at(df: DataFrame, col: str, ranks: Sequence[int], span: tuple | None = None) -> dict:
    """``rank -> (value, rows below it, rows equal to it)`` for 0-based ranks of non-null values.

    A rank beyond them is left out, with their number under ``None``.  All
    ranks are narrowed in the same scans; each decides the next bits of the
    order key, so any data take at most six scans, and fewer when a range
    holds one value.  ``span`` (:func:`extent` of a whole-number column) tells which
    leading bits all values share, and those take no scan.
    """
    dtype = df.schema[col].dataType
    keyed = df.select(_order_key(col, dtype).alias("__s")).where("__s IS NOT NULL")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        keyed = keyed.select("__s")
    u = F.col("__s").bitwiseXOR(F.lit(-(1 << 63)))
    depth = lead = 0
    if span is not None and isinstance(span[0], int) and isinstance(span[1], int):
        low, high = span[0] + (1 << 63), span[1] + (1 << 63)
        depth = min(63, 64 - (low ^ high).bit_length())
        lead = low >> (64 - depth)
    state = {rank: (lead, 0) for rank in ranks}  # leading bits, rows below
    done: dict = {}
    while state:
        after = min(64, depth + _PASS_BITS)
        rows = keyed
        if None in done:
            signed = sorted({p - (1 << depth) if depth == 64 and p >> 63 else p for p, _ in state.values()})
            rows = rows.where(F.shiftrightunsigned(u, 64 - depth).isin(signed))
        parts = rows.groupBy(F.shiftrightunsigned(u, 64 - after).alias("b")).agg(
            F.min("__s").alias("lo"), F.max("__s").alias("hi"), F.count("*").alias("n")).collect()
        parts = sorted((r["lo"], r["hi"], r["n"], r["b"] & ((1 << after) - 1)) for r in parts)
        done.setdefault(None, sum(p[2] for p in parts))  # the first scan reads all
        going = {}
        for rank, (lead, below) in state.items():
            for lo, hi, n, b in parts:
                if b >> (after - depth) != lead:
                    continue
                if rank < below + n:
                    if lo == hi:
                        done[rank] = (_from_key(lo, dtype), below, n)
                    else:
                        going[rank] = (b, below)
                    break
                below += n
        state, depth = going, after
    return done


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.DoubleType, T.FloatType))


def order_boundaries(df: DataFrame, order: Sequence[str], ranks: Sequence[int], span: tuple | None = None) -> list[tuple]:
    """The key at each 0-based rank of the lexicographic order, nulls last.

    Each pass is one scan with a map-side histogram; a few passes find the
    exact key in any number of rows with no shuffle of the data.  Ties on
    the first column are resolved on the next.  A key is cut short when its
    leading columns already separate the rows before it from the rest.
    ``span`` is :func:`extent` of the first column, if it is known.
    """
    keys = df.select(*order)
    types = {f.name: f.dataType for f in keys.schema.fields}
    if not _is_number(types[order[0]]):
        # not a number: a distributed sort tells the ranks
        by = [F.col(c).asc_nulls_last() for c in order]
        rows = dense_index(keys, by, "__i").filter(F.col("__i").isin(list(ranks))).collect()
        return [tuple(next(r for r in rows if r["__i"] == rank))[: len(order)] for rank in ranks]
    at = _values_at(keys, order[0], ranks, span)
    found = []
    for rank in ranks:
        value, below, ties = at.get(rank, (None, at[None], 2))
        key: tuple = (value,)
        if rank > below and ties > 1 and len(order) > 1:
            same = keys.filter(F.col(order[0]).eqNullSafe(F.lit(value)))
            key += order_boundaries(same, order[1:], [rank - below])[0]
        found.append(key)
    return found


def key_before(order: Sequence[str], boundary: tuple) -> Column:
    """Lexicographic ``(order columns) < boundary`` with nulls last, on the columns the boundary has."""
    expr = F.lit(False)
    for col, value in reversed(list(zip(order, boundary, strict=False))):
        if value is None:
            expr = F.col(col).isNotNull() | expr
        else:
            expr = F.coalesce((F.col(col) < F.lit(value)) | ((F.col(col) == F.lit(value)) & expr), F.lit(False))
    return expr


def extent(df: DataFrame, col: str) -> tuple:
    """Smallest and largest value of ``col`` and the row count, in one scan."""
    return tuple(df.agg(F.min(col), F.max(col), F.count("*")).first())


def cut_by_rank(
    df: DataFrame, order: Sequence[str], cuts: Sequence[int], labels: Sequence, name: str, span: tuple
) -> DataFrame:
    """Label rows by where their rank falls between ``cuts`` (first ranks of the later labels).

    ``span`` is :func:`extent` of the first order column.
    """
    rows = span[2]
    inner = [c for c in cuts if 0 < c < rows]
    bounds = dict(zip(inner, order_boundaries(df, order, inner, span), strict=True))
    expr = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels[:-1], strict=True))):
        if cut <= 0:
            continue
        expr = F.lit(label) if cut >= rows else F.when(
            key_before(order, bounds[cut]), F.lit(label)
        ).otherwise(expr)
    return df.withColumn(name, expr)


def micros(ts: str | Column) -> Column:
    """A timestamp column as a long that keeps its order."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def average_rank(df: DataFrame, value: str, name: str, key: Sequence[str]) -> DataFrame:
    """1-based rank with ties sharing their mean rank (as Spearman needs).

    Counts per distinct value are summed over the value order, so a value
    shared by a third of the rows costs one counter, not one group.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("__n"))
    cumulative = prefix_sums(counts, [value], {"__cum": "__n"}, "__i")
    ranks = cumulative.select(
        value, (F.col("__cum") - (F.col("__n") - 1) / 2.0).cast("double").alias(name)
    )
    return spread_join(df, ranks, [value], "inner", list(key))


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles of the non-null values of one column by the rank search.

    Unlike the exact percentile aggregate it holds no value list in memory, so
    it serves columns with as many distinct values as rows.  NaN is the largest value.
    """
    known = df.select(F.col(value).cast("double").alias("__q")).where("__q IS NOT NULL")
    n = known.count()
    if n == 0:
        return [None] * len(probabilities)
    places = [(n - 1) * p for p in probabilities]
    ranks = sorted({int(x) for x in places} | {min(int(x) + 1, n - 1) for x in places})
    at = {rank: found[0] for rank, found in _values_at(known, "__q", ranks).items() if rank is not None}
    out = []
    for x in places:
        low, high = at[int(x)], at[min(int(x) + 1, n - 1)]
        out.append(low if x == int(x) or low == high else low + (high - low) * (x - int(x)))
    return out


def median_row(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row holding the median."""
    (median,) = exact_quantiles(df, value, [0.5])
    return df.sparkSession.createDataFrame([(median,)], f"{name} double")
