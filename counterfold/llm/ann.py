"""Approximate nearest neighbours by a forest of random-projection trees.

Vectors are centred and get one more coordinate, so that all have the same
length: what is near a query then has a large inner product with it, whatever
the lengths and the mean.  The trees are fitted on a bounded sample: each node takes, of some random
directions, the one in which its vectors spread most, and splits them at the
median.  Every vector is filed under one leaf of every tree.  A query walks
all trees with one priority queue: the branch not taken waits under the squared
distances to the planes that were crossed to it, and the nearest waiting branch
of any tree is next, until the leaves seen hold a set share of the sample,
or more where queries from the sample itself need more.
All vectors in these leaves are candidates and are scored exactly.
"""

from __future__ import annotations

import dataclasses as dc
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.llm.vectors import MEETING, matrix, meet, meeting_rows, one_per_id, ranked, usable
from counterfold.session import durable


@dc.dataclass(frozen=True)
class ForestParams:
    trees: int = 8
    #: Vectors the trees are fitted on, at most (expected).
    sample_rows: int = 16_384
    #: Vectors of the sample in a leaf, at most (and at most 1/100 of the sample,
    #: at least 4), and directions tried per node.
    leaf_rows: int = 64
    directions: int = 16
    #: The search goes on until the leaves seen hold this many times the sample
    #: (each tree holds it once, so at most ``trees``).  On vectors without structure 1.1
    #: means two thirds of all as candidates and a recall of 0.92 (500 vectors) to 0.99 (51,000).
    search_share: float = 1.1
    #: Where more is needed to find this share of the sample's own neighbours (of so many
    #: queries from it), the search goes on for longer.
    least_recall: float = 0.93
    trial_queries: int = 128
    #: Rows of the index in a group, at most about; queries in a block.
    group_rows: int = 32_768
    query_block: int = 512
    seed: int = 7


@dc.dataclass(frozen=True)
class Forest:
    """Planes, thresholds and children of all nodes (children below 0 are leaves, ``-1 - leaf``)."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaf_share: np.ndarray
    tree_of: np.ndarray
    centre: np.ndarray
    radius: float

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of ``x`` in every tree."""
        x = _lifted(x, self.centre, self.radius)
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (on := np.flatnonzero(at >= 0)).size:
                node = at[on]
                side = (x[on] * self.planes[node]).sum(1) >= self.cuts[node]
                at[on] = self.children[node, side.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, share: float) -> list[int]:
        """Leaves to look into, in order of the shared queue."""
        # a query's length is free: that of the lifted vectors puts it among them
        q = q / (_lengths(q[None])[0] or 1.0) * self.radius
        margin = (self.planes[:, :-1] @ q - self.cuts).tolist()
        children = self.children_list
        queue = [(0.0, root) for root in self.roots.tolist()]
        heapq.heapify(queue)
        seen, out = 0.0, []
        while queue and seen < share:
            cost, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[node]
                near, far = (children[node][1], children[node][0]) if m >= 0 else children[node]
                heapq.heappush(queue, (cost + m * m, far))
                node = near
            out.append(-1 - node)
            seen += self.leaf_share_list[-1 - node]
        return out

    def __post_init__(self) -> None:
        object.__setattr__(self, "children_list", self.children.tolist())
        object.__setattr__(self, "leaf_share_list", self.leaf_share.tolist())


def _lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, initial=0.0)
    return top * np.linalg.norm(x / np.where(top > 0, top, 1.0)[:, None], axis=1)


def _lifted(x: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """Centred, with one more coordinate that makes every row ``radius`` long.

    Queries have 0 there, so the squared distance is a constant of the query less
    twice the inner product.
    """
    x = x - centre
    part = np.minimum(1.0, _lengths(x) / (radius or 1.0))
    return np.column_stack([x, radius * np.sqrt(1.0 - part * part)])


def _share_needed(forest: Forest, x: np.ndarray, k: int, p: ForestParams) -> float:
    """``search_share``, or what finds ``least_recall`` of the ``k`` best within ``x``, if that is more."""
    leaf, reach = forest.leaves_of(x), []
    k = min(k, len(x) - 1)
    for i in np.unique(np.linspace(0, len(x) - 1, min(len(x), p.trial_queries)).astype(int)) if k > 0 else []:
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(-score, k - 1)[:k]
        order = forest.search(x[i], np.inf)
        seen = np.cumsum(forest.leaf_share[order])
        before = np.empty(len(forest.leaf_share))
        before[order] = np.concatenate([[0.0], seen[:-1]])
        reach.append(before[leaf[best]].min(1))  # a leaf is looked into if less than the share was seen before
    if not reach:
        return p.search_share
    return max(p.search_share, float(np.nextafter(np.quantile(np.concatenate(reach), p.least_recall, method="higher"), np.inf)))


def _grow(x: np.ndarray, p: ForestParams, seed: int) -> list[tuple]:
    """Nodes of one tree: (plane, cut, left, right), children below 0 are leaves; then leaf sizes."""
    rng = np.random.default_rng([p.seed, seed])
    nodes: list[list] = []
    sizes: list[int] = []
    most = min(p.leaf_rows, max(4, len(x) // 100))
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        here = None
        if len(rows) > most:
            w = rng.standard_normal((p.directions, x.shape[1]))
            w /= np.linalg.norm(w, axis=1)[:, None]
            along = x[rows] @ w.T
            j = int(along.var(0).argmax())
            cut = float(np.median(along[:, j]))
            right = along[:, j] >= cut
            if right.all():  # many equal values: the median is the least of them
                right = along[:, j] > cut
                cut = float(np.nextafter(cut, np.inf))
            if right.any() and not right.all():
                here = len(nodes)
                nodes.append([w[j], cut, 0, 0])
                todo += [(rows[~right], here, 2), (rows[right], here, 3)]
        if here is None:
            sizes.append(len(rows))
            here = -len(sizes)
        if parent >= 0:
            nodes[parent][side] = here
    return nodes, sizes


def fit_forest(vectors: DataFrame, n: int, dims: int, k: int, p: ForestParams) -> tuple[Forest, float]:
    """The forest and the share to search.

    Trees are grown one per task on a sample of at most about ``sample_rows`` vectors.
    """
    spark = vectors.sparkSession
    share = min(1.0, p.sample_rows / max(1, n))
    picked = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(p.seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = picked.limit(2 * p.sample_rows).toPandas().sort_values("vec_id")  # bounded
    x = np.zeros((len(rows), dims))
    for i, v in enumerate(rows["vector"]):
        x[i, :len(v)] = v
    centre = (x / max(1, len(x))).sum(0)

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = _lengths(matrix(batch, dims, np.float64) - centre).max(initial=0.0)
            yield pa.RecordBatch.from_arrays([pa.array([top], pa.float64())], names=["length"])

    radius = vectors.mapInArrow(longest, "length double").agg(F.max("length")).first()[0]
    shared = spark.sparkContext.broadcast(_lifted(x, centre, radius))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("id").to_pylist():
                nodes, sizes = _grow(shared.value, p, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int64()), pa.array([np.array([m[0] for m in nodes]).tobytes()], pa.binary()),
                     pa.array([np.array([m[1] for m in nodes]).tobytes()], pa.binary()),
                     pa.array([np.array([m[2:] for m in nodes], np.int64).tobytes()], pa.binary()),
                     pa.array([np.array(sizes, np.int64).tobytes()], pa.binary())],
                    names=["id", "planes", "cuts", "children", "sizes"])

    trees = spark.range(0, p.trees, 1, p.trees).mapInArrow(
        grow, "id long, planes binary, cuts binary, children binary, sizes binary").collect()
    planes, cuts, children, roots, leaves, tree_of = [], [], [], [], [], []
    node_base = leaf_base = 0
    for t in sorted(trees, key=lambda r: r.id):
        own = np.frombuffer(t.children, np.int64).reshape(-1, 2)
        sizes = np.frombuffer(t.sizes, np.int64)
        roots.append(node_base if len(own) else -1 - leaf_base)
        children.append(np.where(own >= 0, own + node_base, own - leaf_base))
        planes.append(np.frombuffer(t.planes).reshape(len(own), -1) if len(own) else np.zeros((0, dims + 1)))
        cuts.append(np.frombuffer(t.cuts))
        leaves.append(sizes / max(1, len(x)))
        tree_of.append(np.full(len(sizes), t.id))
        node_base += len(own)
        leaf_base += len(sizes)
    forest = Forest(
        np.concatenate(planes), np.concatenate(cuts), np.concatenate(children), np.array(roots), np.concatenate(leaves),
        np.concatenate(tree_of), centre, radius)
    return forest, _share_needed(forest, x, k, p)


class _Kernel:
    score_type = pa.float64()

    def __init__(self, dims: int, k: int) -> None:
        self.dims, self.k = dims, k

    def __call__(self, held: dict, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if "leaves" not in held:
            leaf = np.concatenate([np.frombuffer(r["extra"], np.int64) for r in held["rows"]] or [np.zeros(0, np.int64)])
            order = np.argsort(leaf, kind="stable")
            ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in held["rows"]] or [np.zeros(0, np.int64)])[order]
            x = np.concatenate([np.frombuffer(r["data"]).reshape(-1, self.dims) for r in held["rows"]]
                               or [np.zeros((0, self.dims))])[order]
            names, starts = np.unique(leaf[order], return_index=True)
            held["leaves"] = {int(a): (ids[s:e], x[s:e]) for a, s, e in zip(names, starts, [*starts[1:], len(ids)], strict=True)}
            held["rows"] = []
        q_ids = np.frombuffer(row["ids"], np.int64)
        q = np.frombuffer(row["data"]).reshape(-1, self.dims)
        probes = np.frombuffer(row["extra"], np.int64).reshape(-1, 2)  # leaf, query; by leaf
        n = len(q_ids)
        best: list[list[tuple]] = [[] for _ in range(n)]
        low = np.full(n, -np.inf)
        names, starts = np.unique(probes[:, 0], return_index=True)
        for leaf, s, e in zip(names.tolist(), starts, [*starts[1:], len(probes)], strict=True):
            if leaf not in held["leaves"]:
                continue
            ids, x = held["leaves"][leaf]
            who = probes[s:e, 1]
            about = q[who] @ x.T
            at, to = np.nonzero(about >= low[who][:, None] - 1e-9)
            cut = np.searchsorted(at, np.arange(len(who) + 1))
            for j, i in enumerate(who.tolist()):
                here = to[cut[j]:cut[j + 1]]
                if not len(here):
                    continue
                exact = (x[here] * q[i]).sum(1)  # the same order of sums for every pair
                best[i].append((exact, ids[here]))
                if len(best[i]) > 4 or len(here) > 4 * self.k:
                    self._cut(best, low, i, q_ids[i])
        out_q, out_v, out_s = [], [], []
        for i in range(n):
            if best[i]:
                self._cut(best, low, i, q_ids[i])
                s, v = best[i][0]
                out_q.append(np.full(len(v), q_ids[i]))
                out_v.append(v)
                out_s.append(s)
        nothing = np.zeros(0, np.int64)
        return np.concatenate([nothing, *out_q]), np.concatenate([nothing, *out_v]), np.concatenate([np.zeros(0), *out_s])

    def _cut(self, best: list, low: np.ndarray, i: int, own: int) -> None:
        s, v = np.concatenate([b[0] for b in best[i]]), np.concatenate([b[1] for b in best[i]])
        v, first = np.unique(v, return_index=True)  # a vector comes once from each tree
        s, v = s[first][v != own], v[v != own]
        order = np.lexsort((v, -s))[:self.k]
        best[i] = [(s[order], v[order])]
        if len(order) == self.k:
            low[i] = s[order[-1]]


def approximate_top_k(vectors: DataFrame, is_query, k: int = 20, params: ForestParams | None = None) -> DataFrame:
    """The ``k`` largest inner products found for each query, as ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``vectors`` has ``vec_id`` and ``vector`` (array of double); ``is_query`` is a
    condition on ``vec_id``.  ``score`` is the exact inner product; ties go to
    the smaller id.  A query whose leaves may hold fewer than ``k`` others, or not all
    where there are fewer, looks into all leaves.  Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without an id; rows with
    the same id count once (the least vector).  No vectors or queries give no rows.
    """
    p = params or ForestParams()
    nonzero = F.exists("vector", lambda x: x != 0)
    clean = durable(one_per_id(vectors.where(usable(F.col("vector")) & nonzero), "vector"))
    n, dims = clean.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not n:
        return clean.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    spark = clean.sparkSession
    fitted, share = fit_forest(clean, n, dims, k, p)
    forest = spark.sparkContext.broadcast(fitted)
    n_leaves = len(forest.value.leaf_share)
    tree_of = forest.value.tree_of

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_leaves, np.int64)
        for batch in batches:
            total += np.bincount(forest.value.leaves_of(matrix(batch, dims, np.float64)).ravel(), minlength=n_leaves)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["leaf", "n"])

    held = np.zeros(n_leaves, np.int64)
    for r in clean.mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        held[r.leaf] = r.n  # one row per leaf of the model
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_rows = int(min(p.group_rows, max(1_024, -(-held.sum() // at_once))))
    upto = np.cumsum(held)
    # leaves fill groups in order; one that is larger than a group is spread over several
    first_group, last_group = (upto - held) // group_rows, np.maximum(upto - 1, upto - held) // group_rows
    spread = (last_group - first_group + 1).astype(np.int64)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, dims, np.float64)
            ids = batch.column("vec_id").to_numpy().astype(np.int64)
            leaf = forest.value.leaves_of(x)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            group = first_group[leaf] + (mixed[:, None] % spread[leaf].astype(np.uint64)).astype(np.int64)
            flat = group.ravel()
            order = np.argsort(flat, kind="stable")
            names, starts = np.unique(flat[order], return_index=True)
            rows = []
            for g, s, e in zip(names.tolist(), starts, [*starts[1:], len(flat)], strict=True):
                who = order[s:e] // leaf.shape[1]
                rows.append((g, 0, 0, len(who), ids[who].tobytes(), x[who].tobytes(), leaf.ravel()[order[s:e]].tobytes()))
                if len(rows) == 16:
                    yield meeting_rows(rows)
                    rows = []
            yield meeting_rows(rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, p.query_block):
                piece = batch.slice(start, p.query_block)
                q = matrix(piece, dims, np.float64)
                ids = piece.column("vec_id").to_numpy().astype(np.int64)
                found = []
                for i, v in enumerate(q):
                    leaves = forest.value.search(v, share)
                    # a tree's leaves share no vectors, so these hold as many as in any one tree; the query may be one
                    if np.bincount(tree_of[leaves], held[leaves]).max(initial=0) - 1 < min(k, n - 1):
                        leaves = range(n_leaves)
                    found.append(np.stack([np.fromiter(leaves, np.int64), np.full(len(leaves), i)], 1))
                probes = np.concatenate(found)
                probes = probes[np.lexsort((probes[:, 1], probes[:, 0]))]
                for g in range(int(last_group.max()) + 1):
                    mine = probes[(first_group[probes[:, 0]] <= g) & (g <= last_group[probes[:, 0]])]
                    if len(mine):
                        who, place = np.unique(mine[:, 1], return_inverse=True)
                        yield meeting_rows([(
                            g, 1, (part << 32) + done, len(who), ids[who].tobytes(), q[who].tobytes(),
                            np.stack([mine[:, 0], place], 1).tobytes())])
                done += 1

    index = clean.mapInArrow(file, MEETING)
    asked = clean.where(is_query).mapInArrow(ask, MEETING)
    found = meet(index, asked, int(last_group.max()) + 1, _Kernel(dims, k))
    return ranked(found.dropDuplicates(["query_id", "vec_id"]), k)
