"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes ratios.

A text is the log counts of its hashed character n-grams.  From a bounded
sample of labelled texts, the log-count ratio of every n-gram (its smoothed
mean in toxic texts against that in others) is taken; the n-grams whose means
differ most, in standard errors, are the features, each scaled by its ratio,
and a logistic model is fitted on them.  Scoring is one map over the documents.
"""

from __future__ import annotations

import dataclasses as dc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfold.llm.common import in_slices, texts
from counterfold.session import durable


@dc.dataclass(frozen=True)
class ToxicityParams:
    #: Labelled rows the model is fitted on, at most (expected; never over twice as many).
    train_rows: int = 8_000
    #: Lengths of n-grams, in bytes of lower-cased UTF-8.
    shortest: int = 3
    longest: int = 6
    #: n-grams are hashed to this many bits.
    bits: int = 19
    #: Features kept at most, and the standard errors their means differ by at least.
    features: int = 2_000
    least_errors: float = 5.0
    smoothing: float = 1.0
    #: Weight of the squared norm in the loss, and steps of its descent.
    penalty: float = 1e-3
    steps: int = 400
    threshold: float = 0.7


def _grams(text: str, p: ToxicityParams) -> np.ndarray:
    """Hashed n-grams of a text, with repeats."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    parts, h = [], np.zeros(len(data), np.uint32)
    for k in range(min(p.longest, len(data))):
        h = h[:len(data) - k] * np.uint32(0x01000193) + data[k:] + np.uint32(1)
        if k + 1 >= p.shortest:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            parts.append((mixed ^ (mixed >> np.uint32(12))) & np.uint32((1 << p.bits) - 1))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _placed(text: str, place: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their log counts."""
    at = place[_grams(text, p)]
    at, n = np.unique(at[at >= 0], return_counts=True)
    return at, np.log1p(n)


@dc.dataclass(frozen=True)
class ToxicityModel:
    """Place of each hashed n-gram among the features (-1: none), their weights and the intercept; about 2 MB."""

    place: np.ndarray
    weight: np.ndarray
    intercept: float
    params: ToxicityParams


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> DataFrame:
    usable = labels.select("doc_id", "toxic").where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
            (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    share = min(1.0, p.train_rows / max(1, usable.count()))
    drawn = F.xxhash64("doc_id", F.lit(5))
    picked = usable.where(F.pmod(drawn, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(drawn, "doc_id").limit(2 * p.train_rows)
    # at most 2 * train_rows pairs of numbers, so broadcasting them is bounded; one text for each id bounds the rows
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> ToxicityModel:
    """Fit on at most about ``train_rows`` labelled documents that aren't held out.

    A document counts once, with the label that most of its rows in ``labels`` have (toxic in a
    tie) and, of several texts, the one of the least hash.  Without usable labels, or with one class only, the model scores every text
    as its one class (0 without any).
    """
    p = params or ToxicityParams()
    rows = durable(_sample(docs, labels, p).repartition(8))
    size = 1 << p.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((3, size), np.float32), [0, 0]  # by class, and of squares
        for batch in batches:
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                at, times = np.unique(_grams(text, p), return_counts=True)
                value = np.log1p(times)
                sums[toxic, at] += value
                sums[2, at] += value * value
                n[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64()), pa.array([sums.tobytes()], pa.binary())],
            names=["n0", "n1", "sums"])

    sums, n = np.zeros((3, size)), np.zeros(2)
    for r in rows.mapInArrow(count, "n0 long, n1 long, sums binary").toLocalIterator():  # 8 rows of fixed size
        sums += np.frombuffer(r.sums, np.float32).reshape(3, size)
        n += (r.n0, r.n1)
    if not n.all():
        share = n[1] / max(1, n.sum())
        return ToxicityModel(np.full(size, -1, np.int32), np.zeros(0), 50 * (2 * share - 1), p)
    mean, overall = sums[:2] / n[:, None], sums[:2].sum(0) / n.sum()
    spread = np.maximum(sums[2] / n.sum() - overall**2, 0)
    errors = np.abs(mean[1] - mean[0]) / np.sqrt(spread * (1 / n[0] + 1 / n[1]) + 1e-9)
    chosen = np.argsort(-errors, kind="stable")[:p.features]
    chosen = np.sort(chosen[errors[chosen] > p.least_errors])
    ratio = np.log((mean[1, chosen] + p.smoothing / n.sum()) / (mean[0, chosen] + p.smoothing / n.sum()))
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_placed(t, place, p) for t in texts(batch)]
            columns = [batch.column("doc_id").to_numpy().astype(np.int64), batch.column("toxic").to_numpy().astype(np.int64),
                       np.array([len(a) for a, _ in got], np.int64), np.concatenate([np.zeros(0, np.int32), *(a for a, _ in got)]),
                       np.concatenate([np.zeros(0), *(v for _, v in got)])]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["doc_id", "toxic", "length", "at", "value"])

    # a row for each batch: of many small values the driver's memory would stay in pieces
    got = rows.mapInArrow(features, "doc_id binary, toxic binary, length binary, at binary, value binary").collect()
    doc_id, toxic, length, at, value = (
        np.frombuffer(b"".join([r[c] for r in got]), kind) for c, kind in enumerate((np.int64, np.int64, np.int64, np.int32, np.float64)))
    ends = np.cumsum(length)[:-1]
    at, value, order = np.split(at, ends), np.split(value, ends), np.argsort(doc_id, kind="stable")
    weight, intercept = _logistic([at[i] for i in order], [value[i] for i in order], toxic[order].astype(float), ratio, p)
    return ToxicityModel(place, weight * ratio, intercept, p)


def _logistic(
    at: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, p: ToxicityParams,
) -> tuple[np.ndarray, float]:
    """Descent with momentum and a step for each weight on the log loss; both classes weigh the same."""
    where, owner = np.concatenate(at), np.repeat(np.arange(len(at)), [len(a) for a in at])
    value = ratio[where] * np.concatenate(values)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, pull, size = np.zeros(len(ratio) + 1), 0.0, 0.0
    for step in range(1, p.steps + 1):
        z = np.bincount(owner, value * w[where], len(at)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * share
        slope = np.append(np.bincount(where, value * error[owner], len(ratio)) + p.penalty * w[:-1], error.sum())
        pull = 0.9 * pull + 0.1 * slope
        size = 0.99 * size + 0.01 * slope * slope
        w = w - 0.05 * (pull / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` in 0 to 1 and ``predicted`` (score at least the threshold).

    Whole texts are read; a null text is the empty text, whose score is that of
    the intercept.  Rows that repeat are scored each, no rows give none, and
    columns of ``docs`` called ``score`` or ``predicted`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    threshold = model.params.threshold
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in in_slices(batches, 1024):
            found = [_placed(t, m.place, m.params) for t in texts(batch)]
            z = np.array([float(m.weight[at] @ n) for at, n in found]) + m.intercept
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())],
                names=[*batch.schema.names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double", "predicted int"])
    return docs.mapInArrow(run, schema)
