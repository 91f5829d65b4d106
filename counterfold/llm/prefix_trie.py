"""A trie of all prefixes of conversations, built by cutting sequences in halves.

A prefix is named by a 128-bit hash, the exclusive or of the hashes of its turns with
their places.  So a sequence can be cut anywhere: the name of a prefix is
that of the cut prefix combined with that of what follows it.  Sequences are cut
at half depth, the halves again, down to pieces of ``PIECE`` turns.  Going up,
each cut piece gets one name out of those of its halves; going down, the upper
half keeps what it was given and the lower half, a forest that hangs from
the cut, is given the name of the upper half too.  All pieces of one level, of
the upper tries and the lower forests of all conversations, are one Spark job, so
there are as many jobs as the logarithm of the longest conversation.

Totals of subtrees go the other way.  Each node lends its own value to the
path of its smallest member.  A conversation's values from some depth on are
summed by the same cuts, with the totals of the lower half grafted onto the upper
one, and a node's total is the sum over its members.

No conversation, however long, and no node, however common, is ever in one
task: keys of joins are (conversation, piece), and groups are summed where
they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterfold.functions.rows import one_row
from counterfold.functions.skew import spread_join
from counterfold.operators.ordering import dense_index
from counterfold.session import durable

#: Turns of the pieces that are not cut any more.
PIECE = 16
#: Conversation ids joined into one string before a node's hash is computed.
_IDS = 4096

_NODE = ["depth", "a", "b"]
_UP = ["depth", "up_a", "up_b"]


def shared_start_lengths(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its hundred."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(6))


def rebuild(conversations: DataFrame) -> DataFrame:
    """Turns of rebuilt conversations, ``depth`` from 1, and one row of depth 0 for each of them.

    Conversation ``c`` gets the first ``h`` turns of ``c - c % 100`` (fewer, if there
    are fewer), then its own after its first ``h``, with ``h`` =
    :func:`shared_start_lengths`.  Turns are ordered by ``turn``, null first,
    turns of one number by a hash of role and text.  Null roles and
    texts are empty; rows without a ``conv_id`` belong to no conversation.
    Returns ``conv_id``, ``depth``, ``n`` (turns of the conversation), ``h1``, ``h2``
    (the turn's name) and ``size`` (code points of its text).
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.length(text).cast("long").alias("size"))
    own = dense_index(turns, ["turn", "h1", "h2"], "place", ["conv_id"]).drop("turn")
    found = durable(own.groupBy("conv_id").agg(F.count("*").alias("own")))
    first = found.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    # a hundred conversations at most share a base, and at most five turns of it
    convs = durable(
        found.select("conv_id", "own", shared_start_lengths(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
        .join(first, "base", "left").withColumn("taken", taken)
        .withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "taken", "n"))
    starts = own.where("place < 5").withColumnRenamed("conv_id", "base")
    shared = convs.where("taken > 0").join(starts, "base").where("place < taken")
    rest = spread_join(own, convs, ["conv_id"], "inner", ["place"]).where("place >= h")
    out = ["conv_id", "n", "h1", "h2", "size"]
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "n", *(F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "size")))
    return (root.unionByName(shared.select((F.col("place") + 1).alias("depth"), *out))
            .unionByName(rest.select((F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), *out)))


def _by_halves(
    pieces: DataFrame, values: list[str], longest: int, width: int, whole: Callable[[str], Column],
    both: Callable[[Column, Column], Column], rest: Callable[[Column, Column], Column], from_upper: bool,
) -> DataFrame:
    """For every piece, what its conversation holds before it (``from_upper``) or after it.

    ``pieces`` has ``conv_id``, ``n``, ``piece`` and ``values``; a piece has ``width``
    rows of the ``n`` + 1 of its conversation.  ``whole`` sums a value over rows, ``both``
    sums two, ``rest`` takes the second from the first.  Adds ``given_<value>``.
    """
    nothing = [F.lit(0).cast("long").alias(f"given_{v}") for v in values]
    if longest <= width:
        return pieces.select("conv_id", "piece", "n", *values, *nothing)
    cut = durable(
        pieces.where(F.col("n") + 1 > width).groupBy("conv_id", "n", F.shiftright("piece", 1).alias("piece"))
        .agg(*(whole(v).alias(v) for v in values)))
    given = _by_halves(cut, values, longest, 2 * width, whole, both, rest, from_upper).select(
        F.col("conv_id").alias("c"), F.col("piece").alias("above"), *(F.col(v).alias(f"all_{v}") for v in values), *(f"given_{v}" for v in values))
    takes = F.col("piece") % 2 == (1 if from_upper else 0)

    def handed(v: str) -> Column:
        outside = F.coalesce(f"given_{v}", F.lit(0))
        return F.when(takes, both(outside, rest(F.coalesce(f"all_{v}", F.col(v)), F.col(v)))).otherwise(outside).alias(f"given_{v}")

    return pieces.join(given, (F.col("conv_id") == F.col("c")) & (F.shiftright("piece", 1) == F.col("above")), "left").select(
        "conv_id", "piece", "n", *values, *(handed(v) for v in values))


def _along(rows: DataFrame, values: list[str], longest: int, from_upper: bool, whole, both, rest) -> DataFrame:
    """``rows`` with each of ``values`` combined from the root to the row, or from the row to the end."""
    rows = rows.withColumn("piece", F.floor(F.col("depth") / PIECE))
    depth = F.col("depth")
    inside = Window.partitionBy("conv_id", "piece").orderBy(depth if from_upper else depth.desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    given = _by_halves(
        rows.groupBy("conv_id", "n", "piece").agg(*(whole(v).alias(v) for v in values)), values, longest, PIECE, whole, both, rest, from_upper)
    running = rows.select(*rows.columns, *(whole(v).over(inside).alias(f"__{v}") for v in values))
    joined = running.join(given.select("conv_id", "piece", *(f"given_{v}" for v in values)), ["conv_id", "piece"])
    return joined.select(*(c for c in rows.columns if c not in (*values, "piece")), *(both(F.col(f"__{v}"), F.col(f"given_{v}")).alias(v) for v in values))


def _named(rows: DataFrame, longest: int) -> DataFrame:
    """Rows with the node they are at (``a``, ``b``) and the one above (``up_a``, ``up_b``)."""
    turn = {f"g{i}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "h1", "h2")).otherwise(F.lit(0)) for i in (1, 2)}
    rows = rows.withColumns(turn).withColumns({"a": F.col("g1"), "b": F.col("g2")}).drop("h1", "h2")
    xor = lambda x, y: x.bitwiseXOR(y)
    out = _along(rows, ["a", "b"], longest, True, F.bit_xor, xor, xor)
    return out.withColumns({"up_a": xor(F.col("a"), F.col("g1")), "up_b": xor(F.col("b"), F.col("g2"))}).drop("g1", "g2")


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (node, conversation) as strings of up to ``_IDS`` ids."""
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(4)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])) + 1
        edges = np.unique(np.concatenate([[0, len(cols[0])], change, np.arange(0, len(cols[0]), _IDS)])) if len(cols[0]) else [0]
        starts = np.asarray(edges[:-1], np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c[starts]) for c in cols), pa.array([",".join(map(str, cols[3][s:e])) for s, e in zip(edges[:-1], edges[1:], strict=True)], pa.string())],
            names=[*_NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node out of its strings, which come in order."""
    now, sha, done = None, None, []
    for batch in (*_nodes_of(batches), None):
        for node, ids in batch or [(None, "")]:
            if node != now:
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            depth, a, b, digest = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(depth), pa.array(a), pa.array(b), pa.array(digest)], names=[*_NODE, "ends_sha256"])
            done = []


def _nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        nodes = zip(*(batch.column(c).to_pylist() for c in _NODE), strict=True)
        yield list(zip(nodes, batch.column("ids").to_pylist(), strict=True))


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids of each node's conversations, ascending.

    Ids are sorted and joined by many tasks, however many one node has.  The
    hash itself takes its bytes one after another, so a node's few long
    strings, never its rows, pass one task as a stream.
    """
    by = [*_NODE, "conv_id"]
    lists = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        _id_lists, "depth long, a long, b long, first long, ids string")
    return lists.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(
        _digests, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (:func:`rebuild`).

    A node is a distinct sequence of first turns (role and text), the root is
    the empty one; its members are the rebuilt conversations that start with
    it.  Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null
    for the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the
    subtree, its top included), ``saved_tokens`` (over the subtree, members less one
    times the code points of the last text) and ``ends_sha256`` (SHA-256
    of the decimal ids of the conversations that end there, ascending, comma-joined).

    Repeated rows are turns like any other.  Rows without ``conv_id`` take no part;
    without conversations there is no root and no row.  Other columns are not read.
    """
    turns = durable(rebuild(conversations))
    longest = (turns.agg(F.max("n")).first()[0] or 0) + 1
    rows = durable(_named(turns, longest))
    nodes = durable(rows.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"),
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(
        F.count("*").alias("n_children"))
    nodes = durable(nodes.join(children, _NODE, "left").fillna(0, ["n_children"]))

    # each node's own values lie on the path of its smallest member
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    lent = rows.join(own, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaves"]).select("conv_id", "n", *_NODE, "saved", "leaves")
    totals = _along(durable(lent), ["saved", "leaves"], longest, False, F.sum, lambda x, y: x + y, lambda x, y: x - y).groupBy(*_NODE).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    root = nodes.where("depth = 0").select(F.col("conv_id").alias("parent_conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    placed = (
        nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
        .unionByName(nodes.where("depth = 1").join(one_row(root), F.lit(True)))
        .unionByName(spread_join(nodes.where("depth > 1"), parents, _UP, "inner", ["a", "b"])))
    out = placed.join(totals, _NODE).join(end_digests(rows.where("depth = n")), _NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
