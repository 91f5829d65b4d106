"""Mixing sources to target weights by pivotal dependent rounding.

Each document is to be taken ``target / size`` of its source times on average:
a whole number of copies and a fractional probability of one more.  The
probabilities of a source are rounded together.  Two units meet: mass (words)
moves from one to the other, in a random direction chosen so that no expected
value changes, until one of the two is 0 or 1.  The other meets the next unit.
As the mass that moves is counted in words, the sum of words stays at
its target at every step; only the last unit of a source is rounded alone.

Units meet in buckets of a bounded number, largest documents first; each
bucket leaves at most one fractional unit, and these meet in the buckets of the
next level, a tree of a few levels whatever the number of documents.  All of
it is DataFrame operations; random numbers are hashes, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterfold.session import durable

#: Weights of the sources in order of their names, repeating.
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
#: Units per bucket that a level aims at; hashing spreads them evenly around it.
BUCKET = 96
_WORD = "[^\\x20\\x09-\\x0D]+"
_NEAR = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = SOURCE_WEIGHTS, total_share: float = 1.5, most_copies: float = 2.0,
) -> DataFrame:
    """``source``, ``source_size``, ``n_units``, ``target`` from rows of ``source``, ``size``.

    Sources in order of code points, null last, weigh ``weights``, repeating.
    They share ``total_share`` of all sizes by weight; a target stops at
    ``most_copies`` times its source's size and the excess goes to the others.
    That is one level of target per weight: sources are capped in order of
    size per weight as long as their cap lies below the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_units"))
    # one row per source: the windows below run over sums, not over documents
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    named = per.withColumn("w", F.element_at(table, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    named = named.withColumn("cap", F.lit(most_copies) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = named.select(
        "*",
        F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("capped"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))).alias("open"),
        (F.sum("source_size").over(everything) * F.lit(float(total_share))).alias("total"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # the level rises as long as sources are capped below it and falls afterwards: its top is the one that holds
    level = F.max("level").over(everything)
    return levels.select(
        "source", "source_size", "n_units", F.least(F.col("cap"), level * F.col("w")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def _meet(carried: Column, unit: Column) -> Column:
    """Two fractional units meet: one leaves as 0 or 1, the other is carried on.

    ``up`` is the most mass (words) that the carried unit can give to the other,
    ``down`` the most it can take; it gives with probability
    down / (up + down), which keeps both expected values.
    """
    a, b = carried["p"], unit["p"]
    up = F.least(a * carried["size"], (1 - b) * unit["size"])
    down = F.least((1 - a) * carried["size"], b * unit["size"])
    gives = unit["draw"] * (up + down) < down
    new_a = F.when(gives, a - up / carried["size"]).otherwise(a + down / carried["size"])
    new_b = F.when(gives, b + up / unit["size"]).otherwise(b - down / unit["size"])
    a_done = (new_a < _NEAR) | (new_a > 1 - _NEAR)
    done = F.when(a_done, F.struct(carried["key"].alias("key"), F.round(new_a).cast("int").alias("take"))).otherwise(
        F.struct(unit["key"].alias("key"), F.round(new_b).cast("int").alias("take")))
    kept = F.when(a_done, _unit(unit, new_b)).otherwise(_unit(carried, new_a))
    return F.struct(done.alias("done"), kept.alias("kept"))


def _unit(of: Column, p: Column) -> Column:
    return F.struct(of["key"].alias("key"), of["size"].alias("size"), p.alias("p"), of["draw"].alias("draw"))


def _fold(units: Column, empty_done: Column) -> Column:
    """All units of a bucket meet in turn: the decided ones, and the one left over."""
    start = F.struct(empty_done.alias("done"), F.element_at(units, 1).alias("kept"))

    def step(state: Column, unit: Column) -> Column:
        met = _meet(state["kept"], unit)
        return F.struct(F.array_append(state["done"], met["done"]).alias("done"), met["kept"].alias("kept"))

    return F.aggregate(F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(1))), start, step)


def round_copies(units: DataFrame, seed: int = 0, bucket: int = BUCKET) -> DataFrame:
    """``key``, ``take`` (0 or 1) of fractional units ``group``, ``key``, ``size``, ``p``.

    ``0 < p < 1`` and ``size > 0``; ``key`` is a struct that is unique within its
    group.  The sum of ``take * size`` of a group differs from that of
    ``p * size`` by less than the size of one unit.
    """
    counts = durable(units.groupBy("group").agg(F.count("*").alias("n")).withColumnRenamed("group", "of"))
    most = counts.agg(F.max("n")).first()[0] or 0
    key_type = units.schema["key"].dataType.simpleString()
    empty_done = F.array().cast(f"array<struct<key:{key_type},take:int>>")
    level, left, decided = 0, units, []
    while True:
        share = bucket ** (level + 1)
        buckets = F.ceil(F.col("n") / F.lit(share)).cast("long")
        # group sizes are one small row per source
        drawn = left.join(counts, F.col("group").eqNullSafe(F.col("of")), "inner").select(
            "group", "key", "size", "p", buckets.alias("buckets"))
        placed = drawn.select(
            "group", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "key"), F.col("buckets")).alias("bucket"),
            F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(seed), "key").alias("tie"), "key", "size", "p",
                     _uniform(F.lit(seed), F.lit(level + 1000), F.col("key")).alias("draw")).alias("unit"))
        met = placed.groupBy("group", "bucket").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        plain = F.transform("units", lambda u: F.struct(
            u["key"].alias("key"), u["size"].alias("size"), u["p"].alias("p"), u["draw"].alias("draw")))
        met = durable(met.select("group", _fold(plain, empty_done).alias("f")))
        decided.append(met.select(F.explode("f.done").alias("d")).select("d.key", "d.take"))
        left = met.select("group", F.col("f.kept.key").alias("key"), F.col("f.kept.size").alias("size"),
                          F.col("f.kept.p").alias("p"))
        level += 1
        if most <= share:
            break
    # the last unit of each source is alone: the nearer whole number
    decided.append(left.select("key", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("take")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix_units(
    docs: DataFrame, weights: tuple[float, ...] = SOURCE_WEIGHTS, total_share: float = 1.5, most_copies: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """How many copies of each document the mix takes.

    One row per row of ``docs`` (``doc_id``, ``source``, ``text``): ``doc_id``,
    ``source``, ``row_hash`` (of all columns), ``copy_no`` (numbers identical rows from 1), ``size``,
    ``source_size``, ``target`` and ``copies``.  Documents without words
    are taken ``floor(target / source_size)`` times.  Null sources are one
    source, the last; null ids and texts are values like any other.  A
    source without words has the target 0 and no copies.
    """
    sized = docs.select("doc_id", "source", F.xxhash64(*docs.columns).alias("row_hash"), n_words(F.col("text")).alias("size"))
    sized = durable(sized)
    targets = durable(source_targets(sized, weights, total_share, most_copies))
    # identical rows are numbered from a count of them, which adds up before the shuffle
    rows = sized.groupBy("doc_id", "source", "row_hash", "size").agg(F.count("*").alias("m")).withColumn(
        "copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("m")
    # one row per source; Spark broadcasts it by its measured size or shuffles, and splits a hot source then
    with_target = rows.join(
        targets.withColumnRenamed("source", "s"), rows["source"].eqNullSafe(F.col("s")), "left").drop("s", "n_units")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(times + _NEAR).cast("int")
    units = durable(with_target.withColumns({"whole": whole, "p": F.greatest(times - whole, F.lit(0.0))}))
    open_units = units.where((F.col("p") > _NEAR) & (F.col("size") > 0)).select(
        F.col("source").alias("group"),
        F.struct("doc_id", "source", "row_hash", "copy_no").alias("key"), F.col("size").cast("double").alias("size"), "p")
    taken = round_copies(open_units, seed).select(
        F.col("key.doc_id").alias("k_doc"), F.col("key.row_hash").alias("k_hash"), F.col("key.copy_no").alias("k_copy"), "take")
    return units.join(
        taken, units["doc_id"].eqNullSafe(F.col("k_doc")) & (units["row_hash"] == F.col("k_hash"))
        & (units["copy_no"] == F.col("k_copy")), "left",
    ).select(
        "doc_id", "source", "row_hash", "copy_no", "size", "source_size", "target",
        (F.col("whole") + F.coalesce("take", F.lit(0))).alias("copies"))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, with all its columns."""
    copies = mix_units(docs, **settings).where(F.col("copies") > 0).groupBy("doc_id", "row_hash").agg(
        F.sum("copies").alias("__copies")).select(
        F.col("doc_id").alias("__doc"), F.col("row_hash").alias("__hash"), "__copies")
    mine = docs.withColumn("__row_hash", F.xxhash64(*docs.columns))
    # of identical rows one stands for all; their copies are added up
    once = mine.dropDuplicates()
    taken = once.join(
        copies, once["doc_id"].eqNullSafe(F.col("__doc")) & (once["__row_hash"] == F.col("__hash")), "inner")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[docs[c] for c in docs.columns])
