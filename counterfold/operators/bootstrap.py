"""Percentile bootstrap over the independent unit.

Units are first reduced to sufficient statistics; a replicate then re-weights
units, it never copies rounds.  Every estimator is an expression over the sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfold.functions.hashing import hash32, hash32_sql

#: How a replicate weights the units; a choice of the caller, never of the size.
METHODS = ("percentile", "percentile_poisson")


def replicate_sums(
    unit_stats: DataFrame, sums: list[str], n_bootstrap: int, seed: int, unit: str = "unit_id",
    by: list[str] | None = None, method: str = METHODS[0],
) -> tuple[DataFrame, str, int]:
    """``(by..., rep, sums...)`` for every replicate, the method and the unit count.

    A row of ``unit_stats`` stands for ``mult`` alike units (1 without that
    column) and holds the sums over all of them.

    ``percentile`` draws exactly ``n`` units with replacement per replicate (``n`` is
    a group's own number of units); ``percentile_poisson`` gives each unit an
    independent Poisson(1) count.
    """
    if method not in METHODS:
        raise ValueError(f"unknown bootstrap method {method!r}; one of {METHODS}")
    by = by or ["agent"]
    if "mult" not in unit_stats.columns:
        unit_stats = unit_stats.withColumn("mult", F.lit(1).cast("long"))
    n_units = unit_stats.groupBy(*by).agg(F.sum("mult").alias("m")).agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]
    if method == "percentile":
        return _drawn(unit_stats, sums, n_bootstrap, seed, unit, by), method, int(n_units)
    return _poisson(unit_stats, sums, n_bootstrap, seed, unit, by), method, int(n_units)


#: Rows of a leaf of units; the driver holds one number per leaf and replicate.
LEAF_ROWS = 50_000
#: Draws that share a key.
_PIECE = 65_536
#: Draws that are in memory at once.
_AT_ONCE = 1 << 18
#: The stream that deals a replicate's draws to the leaves; a leaf's own stream has its number.
_TOP = -1
_LOW32 = 0xFFFFFFFF
#: Step and factors of the 32-bit mixing of a draw's number.
_STEP, _MIX = 0x9E3779B1, (0x85EBCA6B, 0xC2B2AE35)


def _mixed(keys: list[int], length: np.ndarray, offset: np.ndarray) -> np.ndarray:
    low = np.uint64(_LOW32)
    x = (np.repeat(np.array(keys, np.uint64), length) + offset * np.uint64(_STEP)) & low
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(_MIX[0])) & low
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(_MIX[1])) & low
    return x ^ (x >> np.uint64(16))


def _fall(seed: int, stream: int, rep: np.ndarray, piece: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """Where the draws of some pieces, one after the other, fall among ``size`` units: 53 hashed bits each.

    The key is a digest, the rest is integer arithmetic, so SQL can repeat it (:func:`drawn_sql`).
    """
    digests = [hashlib.md5(f"{seed}|{r}|{stream}|{p}".encode()).hexdigest() for r, p in zip(rep.tolist(), piece.tolist(), strict=True)]
    ends = np.cumsum(length)
    offset = (np.arange(ends[-1]) - np.repeat(ends - length, length)).astype(np.uint64)
    high, low = (_mixed([int(d[at:at + 8], 16) for d in digests], length, offset) for at in (0, 8))
    return ((high * np.uint64(1 << 21) + (low >> np.uint64(11))).astype(np.float64) / 2.0**53 * size).astype(np.int64)


def _pieces(draws: np.ndarray, of: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pieces of each replicate's draws, as many at a time as stay in memory: replicate, piece, length."""
    each = -(-draws // of)
    rep = np.repeat(np.arange(len(draws)), each)
    piece = np.arange(len(rep)) - np.repeat(np.cumsum(each) - each, each)
    length = np.minimum(of, draws[rep] - piece * of)
    for some in np.split(np.arange(len(rep)), np.flatnonzero(np.diff((np.cumsum(length) - 1) // _AT_ONCE)) + 1):
        if len(some):
            yield rep[some], piece[some], length[some]


def _leaf_draws(spark: SparkSession, below: np.ndarray, n_bootstrap: int, seed: int) -> np.ndarray:
    """How many of each replicate's n draws fall into each leaf; ``below`` holds the units before each, and all at the end."""
    n, leaves = int(below[-1]), len(below) - 1
    if leaves == 1:
        return np.full((n_bootstrap, 1), n, np.int64)
    pieces = -(-n // _PIECE)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            rep, piece = np.divmod(batch["id"].to_numpy(np.int64), pieces)
            length = np.minimum(_PIECE, n - piece * _PIECE)
            for r in np.unique(rep).tolist():
                mine = np.flatnonzero(rep == r)
                for some in np.split(mine, np.flatnonzero(np.diff((np.cumsum(length[mine]) - 1) // _AT_ONCE)) + 1):
                    at = _fall(seed, _TOP, rep[some], piece[some], length[some], n)
                    counts[r] = counts.get(r, 0) + np.bincount(np.searchsorted(below, at, "right") - 1, minlength=leaves)
        for r, c in counts.items():
            yield pd.DataFrame({"rep": r, "leaf": np.arange(leaves), "c": c})

    tasks = min(n_bootstrap * pieces, max(spark.sparkContext.defaultParallelism, n_bootstrap * n // 5_000_000))
    dealt = spark.range(0, n_bootstrap * pieces, 1, tasks).mapInPandas(deal, "rep long, leaf long, c long")
    out = np.zeros((n_bootstrap, leaves), np.int64)
    for r in dealt.groupBy("rep", "leaf").agg(F.sum("c").alias("c")).toLocalIterator():
        out[r["rep"], r["leaf"]] = r["c"]
    return out


def _drawn(unit_stats, sums, n_bootstrap, seed, unit, by) -> DataFrame:
    """Exactly n units with replacement per replicate: n hashed draws, dealt to leaves and then to the units of a leaf.

    A hash of the unit decides on its leaf.  Only counts per leaf and sums leave a task: draws are
    not shuffled or joined.  Groups with the same units get the same draws.
    """
    rows = unit_stats.groupBy(*by).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    leaves = max(1, min(65_536, -(-rows // LEAF_ROWS)))
    leaf = (hash32(seed, F.col(unit).cast("string")) % leaves).cast("int")
    typed = unit_stats.select(*by, F.col(unit).cast("string").alias("__unit"), F.col("mult").cast("long").alias("mult"),
                              *[F.col(s).cast("double").alias(s) for s in sums], leaf.alias("__leaf"))
    units: dict[tuple, np.ndarray] = {}
    for r in typed.groupBy(*by, "__leaf").agg(F.sum("mult").alias("m")).collect():  # a number per group and leaf
        units.setdefault(tuple(r[b] for b in by), np.zeros(leaves + 1, np.int64))[r["__leaf"] + 1] = r["m"]
    below = {k: tuple(np.cumsum(v).tolist()) for k, v in units.items()}
    dealt = {b: _leaf_draws(unit_stats.sparkSession, np.array(b), n_bootstrap, seed) for b in set(below.values())}

    def draw(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        group, at = key[:-1], int(key[-1])
        group = tuple(g.item() if isinstance(g, np.generic) else g for g in group)
        frame = frame.sort_values("__unit", kind="stable")
        mult, values = frame["mult"].to_numpy(np.int64), np.nan_to_num(frame[sums].to_numpy(np.float64))
        draws, last = dealt[below[group]][:, at], np.cumsum(mult)
        total, rows = np.zeros((n_bootstrap, len(sums))), len(frame)
        some = max(1, _AT_ONCE // max(rows, int(draws.max())))
        for first in range(0, n_bootstrap, some):
            for rep, piece, length in _pieces(draws[first:first + some], _PIECE):
                row = np.searchsorted(last, _fall(seed, at, rep + first, piece, length, int(last[-1])), "right")
                here = int(rep[-1]) - int(rep[0]) + 1
                counts = np.bincount(np.repeat(rep - rep[0], length) * rows + row, minlength=here * rows).reshape(here, rows)
                total[first + rep[0]:first + rep[-1] + 1] += counts / mult @ values
        out = pd.DataFrame(total, columns=sums)
        out.insert(0, "rep", np.arange(n_bootstrap, dtype=np.int32))
        for name, value in zip(by, group, strict=True):
            out[name] = value
        return out[[*by, "rep", *sums]]

    types = {f.name: f.dataType.simpleString() for f in unit_stats.schema.fields}
    schema = ", ".join([*[f"{b} {types[b]}" for b in by], "rep int", *[f"{s} double" for s in sums]])
    return typed.groupBy(*by, "__leaf").applyInPandas(draw, schema).groupBy(*by, "rep").agg(*[F.sum(s).alias(s) for s in sums])


def drawn_sql(seed: int, n_bootstrap: int) -> str:
    """The draws of ``percentile`` as common tables: from un (unit, id), a row per unit and ``unit`` the
    name of its row, to dr (rep, id), a row per draw."""

    def mixed(a: str, at: int) -> str:
        return f"""(('0x' || substr(h, {at}, 8))::UBIGINT + (o * {_STEP})::UBIGINT) & {_LOW32}::UBIGINT AS {a}0,
  (xor({a}0, {a}0 >> 16) * {_MIX[0]}::UBIGINT) & {_LOW32}::UBIGINT AS {a}1, (xor({a}1, {a}1 >> 13) * {_MIX[1]}::UBIGINT) & {_LOW32}::UBIGINT AS {a}2, xor({a}2, {a}2 >> 16) AS {a}3"""

    def fall(source: str) -> str:
        return f"""(SELECT rep, leaf, floor((a3 * 2097152::UBIGINT + (b3 >> 11))::DOUBLE / 9007199254740992.0::DOUBLE * size)::BIGINT AS pos FROM
  (SELECT rep, leaf, size, md5(concat_ws('|', '{seed}', rep, leaf, j // {_PIECE})) AS h, j % {_PIECE} AS o, {mixed('a', 1)}, {mixed('b', 9)} FROM ({source})))"""

    return f"""ul AS MATERIALIZED (SELECT *, {hash32_sql(seed, 'unit')} % (SELECT greatest(1, least(65536, (count(DISTINCT unit) + {LEAF_ROWS - 1}) // {LEAF_ROWS})) FROM un) AS leaf FROM un),
ui AS MATERIALIZED (SELECT id, leaf, row_number() OVER (PARTITION BY leaf ORDER BY unit, id) - 1 AS pos FROM ul),
lf AS MATERIALIZED (SELECT leaf, size, (sum(size) OVER (ORDER BY leaf) - size)::BIGINT AS below FROM (SELECT leaf, count(*) AS size FROM ul GROUP BY leaf)),
td AS {fall(f"SELECT rep, {_TOP} AS leaf, j, (SELECT count(*) FROM un) AS size FROM (SELECT unnest(range({n_bootstrap})) AS rep), (SELECT unnest(range((SELECT count(*) FROM un))) AS j)")},
tq AS MATERIALIZED (SELECT rep, lf.leaf, count(*) AS c FROM td JOIN lf ON td.pos >= below AND td.pos < below + lf.size GROUP BY ALL),
ld AS {fall("SELECT rep, leaf, unnest(range(c)) AS j, size FROM tq JOIN lf USING (leaf)")},
dr AS MATERIALIZED (SELECT rep, id FROM ld JOIN ui USING (leaf, pos))"""


def _poisson_cdf(mean: int) -> tuple[int, np.ndarray]:
    """A count and the cumulative probabilities from it on; what lies outside is below 1e-20."""
    reach = 12 * math.sqrt(mean) + 30
    k = np.arange(max(0, int(mean - reach)), int(mean + reach))
    log_p = k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k.tolist()])
    return int(k[0]), np.cumsum(np.exp(log_p))


def _poisson(unit_stats, sums, n_bootstrap, seed, unit, by) -> DataFrame:
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        base = np.arange(n_bootstrap, dtype=np.uint64)[:, None]
        for batch in batches:
            for start in range(0, len(batch), 8192):
                piece = batch.iloc[start : start + 8192]
                key = piece["__h"].to_numpy(np.int64).view(np.uint64)[None, :]
                with np.errstate(over="ignore"):
                    z = key + (base + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    z = z ^ (z >> np.uint64(31))
                mult = piece["mult"].to_numpy(np.int64)
                counts = np.zeros(z.shape)
                for m in np.unique(mult).tolist():
                    # the sum of m Poisson(1) counts is one Poisson(m) count
                    least, cdf = _poisson_cdf(m)
                    alike = mult == m
                    counts[:, alike] = (least + np.searchsorted(cdf, (z[:, alike] >> np.uint64(11)) * 2.0**-53)) / m
                values = piece[sums].to_numpy(np.float64)
                for group, rows in piece.reset_index(drop=True).groupby(by, sort=False).indices.items():
                    group = group if isinstance(group, tuple) else (group,)
                    part = counts[:, rows] @ np.nan_to_num(values[rows])
                    total[group] = total.get(group, 0.0) + part
        for group, part in total.items():
            frame = pd.DataFrame(part, columns=sums)
            frame.insert(0, "rep", np.arange(n_bootstrap, dtype=np.int32))
            for name, value in zip(by, group, strict=True):
                frame[name] = value
            yield frame[[*by, "rep", *sums]]

    types = {f.name: f.dataType.simpleString() for f in unit_stats.schema.fields}
    schema = ", ".join([*[f"{b} {types[b]}" for b in by], "rep int", *[f"{s} double" for s in sums]])
    keyed = unit_stats.select(*by, F.xxhash64(unit).alias("__h"), "mult",
                              *[F.col(s).cast("double").alias(s) for s in sums])
    return keyed.mapInPandas(partial, schema).groupBy(*by, "rep").agg(*[F.sum(s).alias(s) for s in sums])


def percentile_interval(
    replicates: DataFrame, value: Column, level: float, by: list[str] | None = None
) -> DataFrame:
    """``ci_lower``/``ci_upper`` per group; one undefined replicate drops the interval.

    A group has one value per replicate, so the percentile's memory is bounded.
    """
    by = by or ["agent"]
    alpha = (1.0 - level) / 2.0
    out = replicates.withColumn("__v", value).groupBy(*by).agg(
        F.percentile("__v", F.lit(alpha)).alias("lo"), F.percentile("__v", F.lit(1.0 - alpha)).alias("hi"),
        F.count_if(F.col("__v").isNull()).alias("undefined"),
    )
    keep = F.col("undefined") == 0
    return out.select(*by, F.when(keep, F.col("lo")).alias("ci_lower"),
                      F.when(keep, F.col("hi")).alias("ci_upper"), "undefined")
