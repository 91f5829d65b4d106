"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are split over tasks, and in each task into blocks of a bounded
number of postings, so that any number of documents can be searched and a term that
all of them hold is many short lists.  In a block each term has a list of
documents by descending impact, and access by document.  The lists
of an item's terms are read in parallel; a document that turns up is looked
up in all of them, and its positions there are marked as seen.  The best
position of a list is the last one up to which all are seen, which lies deeper
than what was read in order.  No unseen document can score more than the impacts at
the best positions together, and reading stops once that sum is strictly below the
kth score so far, so that equal scores are never cut off.  The kth score is carried
from block to block of a task; each task gives at most k documents an item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterfold.llm.common import in_slices, texts
from counterfold.session import scratch_path

#: Different terms of the items that are searched in one go; more items take more goes.
BLOCK_TERMS = 200_000
#: Postings whose lists a task holds at once (one document may exceed it).
BLOCK_POSTINGS = 2_000_000
#: Entries of each list that are read in order before the first look at the bound; then twice as many, and so on.
FIRST_READ = 64

_IS_TERM = [b >= 0x80 or chr(b).isalnum() for b in range(256)]
_TO_TERMS = bytes((b + 32 if 65 <= b <= 90 else b) if _IS_TERM[b] else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and anything beyond ASCII, only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 256):
        terms = [sorted(set(terms_of(t))) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])


def _lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def _postings(known):
    """Of each document with terms: its length, and number and count of those terms that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in in_slices(batches, 512):
            lengths, terms, counts = [], [], []
            for text in texts(batch):
                words = terms_of(text)
                found = Counter(map(number, words))
                found.pop(None, None)
                lengths.append(len(words))
                terms.append(list(found.keys()))
                counts.append(list(found.values()))
            keep = pa.array(np.flatnonzero(np.asarray(lengths) > 0))
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [c.take(keep) for c in (ids.is_valid(), ids.fill_null(0), pa.array(lengths, pa.int64()), _lists(terms), _lists(counts))],
                names=["has_id", "doc_id", "n", "terms", "counts"])
    return run


class _Best:
    """The k best documents of one item so far; of equal scores the smaller ids, null last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.no_id, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, no_id: np.ndarray, doc: np.ndarray) -> None:
        at = score > 0
        if len(self.score) == self.k:
            at &= score >= self.score[-1]
        score, no_id, doc = (np.concatenate([a, b[at]]) for a, b in ((self.score, score), (self.no_id, no_id), (self.doc, doc)))
        best = np.lexsort([doc, no_id, -score])[:self.k]
        self.score, self.no_id, self.doc = score[best], no_id[best], doc[best]

    @property
    def kth(self) -> int:
        """The score that a document must reach to be among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 0


class _ImpactList:
    """Documents of one term by descending impact, and their impact and position by document."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray) -> None:
        order = np.argsort(-impacts, kind="stable")
        self.docs, self.impact = docs, impacts  # by document
        self.sorted_docs, self.sorted_impact = docs[order], impacts[order]
        self.position = np.empty(len(docs), np.int64)
        self.position[order] = np.arange(len(docs))


def best_positions(lists: list[_ImpactList], best: _Best, no_id: np.ndarray, doc: np.ndarray) -> int:
    """Search the lists of one item's terms; returns how many documents were looked up."""
    lists = [x for x in lists if x.sorted_impact[0] > 0]
    met = np.zeros(len(doc), bool)
    seen = [np.zeros(len(x.docs) + 1, bool) for x in lists]  # one more, never seen, ends every list
    at = [0] * len(lists)  # positions before it are all seen
    bound = sum(int(x.sorted_impact[0]) for x in lists)
    read, step = 0, FIRST_READ
    while lists and bound > 0 and bound >= best.kth:
        here = np.unique(np.concatenate([x.sorted_docs[read:read + step] for x in lists]))
        here = here[~met[here]]
        met[here] = True
        score = np.zeros(len(here), np.int64)
        for x, s in zip(lists, seen, strict=True):
            place = np.minimum(np.searchsorted(x.docs, here), len(x.docs) - 1)
            holds = x.docs[place] == here
            score[holds] += x.impact[place[holds]]
            s[x.position[place[holds]]] = True
        best.add(score, no_id[here], doc[here])
        read, step = read + step, 2 * step
        bound = 0
        for i, (x, s) in enumerate(zip(lists, seen, strict=True)):
            at[i] += int(np.argmin(s[at[i]:]))
            bound += int(x.sorted_impact[at[i] - 1]) if at[i] < len(x.docs) else 0
    return int(met.sum())


def _search(plan, k: int):
    """The k best documents of each item among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items, n_docs, length = plan.value
        best = [_Best(k) for _ in items]
        for block in _blocks(batches):
            no_id, doc = ~block["has_id"].to_numpy(zero_copy_only=False), block["doc_id"].to_numpy()
            of_doc = np.repeat(np.arange(len(doc)), block["terms"].value_lengths().to_numpy())
            term, tf = (block[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
            m = 100 - 90 + (90 * block["n"].to_numpy() * n_docs) // length
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[of_doc]))
            order = np.argsort(term, kind="stable")  # by term, then by document
            term = term[order]
            edges = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]])) if len(term) else np.zeros(1, int)
            lists = {int(term[s]): _ImpactList(of_doc[order[s:e]], impact[order[s:e]]) for s, e in zip(edges[:-1], edges[1:], strict=True)}
            for mine, wanted in zip(best, items, strict=True):
                best_positions([lists[t] for t in wanted if t in lists], mine, no_id, doc)
        item = np.repeat(np.arange(len(items)), [len(b.score) for b in best])
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), *(pa.array(np.concatenate([getattr(b, c) for b in best])) for c in ("no_id", "doc", "score"))],
                names=["item", "no_id", "doc_id", "score"])
    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Documents of about ``BLOCK_POSTINGS`` postings at a time."""
    held, size = [], 0
    for batch in in_slices(batches, 512):
        held.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= BLOCK_POSTINGS:
            yield _columns(held)
            held, size = [], 0
    if held:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> dict:
    table = pa.Table.from_batches(batches).combine_chunks()
    return {c: table.column(c).combine_chunks() for c in table.column_names}


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Terms are those of :func:`terms_of`, a null text has none.  With N documents
    that have terms, L terms in them all, and n in one of them, a
    document's m is 10 + 90 n N div L, a term's weight w that of :func:`term_weight`, and a score
    sums w ((10^9 tf) div (1000 tf + 8 m)) over an item's terms.  Only scores
    above 0 count; equal ones go by ascending ``doc_id``, null last.  Each row of
    ``docs`` is a document, repeated ones too.  Rows of one ``item_id``, which may be
    null, are one item with the terms of all of them.  No documents, no items or no
    common term give no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, terms array<binary>")
    goes = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    found = []
    for go in range(goes):
        mine: dict[int | None, set[bytes]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(goes)) == go).toLocalIterator():  # about BLOCK_TERMS terms
            mine.setdefault(r.item_id, set()).update(bytes(t) for t in r.terms)
        found.append(_searched(spark, docs, mine, k))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _searched(spark, docs: DataFrame, items: dict[int | None, set[bytes]], k: int) -> DataFrame:
    ids = sorted(items, key=lambda i: (i is None, i or 0))
    number = {t: i for i, t in enumerate(sorted(set().union(*items.values())))}
    path = scratch_path(spark, "postings")
    known = spark.sparkContext.broadcast(number)
    docs.select("doc_id", "text").mapInArrow(
        _postings(known), "has_id boolean, doc_id long, n long, terms array<int>, counts array<int>").write.parquet(path)
    known.unpersist()
    postings = spark.read.parquet(path)
    n_docs, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    weights = np.zeros(len(number), np.int64)
    # at most one row for each term of the items
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[r.t] = term_weight(n_docs, r["count"])
    plan = spark.sparkContext.broadcast((weights, [sorted(number[t] for t in items[i]) for i in ids], n_docs, length))
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    best = postings.mapInArrow(_search(plan, k), "item long, no_id boolean, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "no_id", "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select(  # one row for each item of this go
        "item_id", "rank", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score")
