"""Dropping repeated lines through range-partitioned line hashes.

Each line becomes (128-bit hash of its key, document, position).  The rows are
range-partitioned by hash and document, so that a line that half of all
documents share spreads over as many tasks as its rows need, and sorted
within each task.  A stream over the sorted rows sees all documents of a line
one after another.  Only lines at the edges of a partition can go on in the
next one: their counts, two per partition, are summed first.  What comes out
is one compressed bitmap of kept lines per document that loses any, never text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.llm.common import ASCII_SPACE, in_slices, texts
from counterfold.session import durable

_STRIP = ASCII_SPACE.encode()
_LINE_SCHEMA = "hi long, lo long, has_id boolean, doc_id long, text_hash long, position int"


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1024):
            digests, owner, position = [], [], []
            for row, text in enumerate(texts(batch)):
                for at, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line.strip(_STRIP).lower()
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        owner.append(row)
                        position.append(at)
            halves = np.frombuffer(b"".join(digests), ">i8").astype("<i8").reshape(-1, 2)
            ids = batch.column("doc_id").take(pa.array(owner, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), ids.is_valid(), ids.fill_null(0),
                 batch.column("text_hash").take(pa.array(owner, pa.int32())), pa.array(position, pa.int32())],
                names=["hi", "lo", "has_id", "doc_id", "text_hash", "position"])
    return run


def _sorted_runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by line and document: where lines start, where documents start, the columns."""
    cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
    table = np.stack(cols, 1)
    change = table[1:] != table[:-1]
    line = np.concatenate([[True], change[:, :2].any(1)])
    doc = np.concatenate([[True], change.any(1)])
    return line, doc, table


def _edge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the first and the last line of a partition, in how many documents it is there."""
    first: tuple | None = None
    first_docs = docs = 0
    key: tuple | None = None
    before: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        line, doc, table = _sorted_runs(batch)
        if before is not None and before == tuple(table[0]):
            doc[0] = False
        before = tuple(table[-1])
        starts = np.flatnonzero(line)
        counts = np.add.reduceat(doc.astype(np.int64), starts)
        for s, c in zip(starts[[0, -1]] if len(starts) > 1 else starts, counts[[0, -1]] if len(starts) > 1 else counts, strict=True):
            here = tuple(table[s, :2])
            if here == key:
                docs += int(c)
            else:
                if key is not None and first is None:
                    first, first_docs = key, docs
                key, docs = here, int(c)
    if key is not None:
        rows = [(key, docs)] if first is None else [(first, first_docs), (key, docs)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(k[0]) for k, _ in rows]), pa.array([int(k[1]) for k, _ in rows]),
             pa.array([d for _, d in rows], pa.int64()), pa.array([part] * len(rows), pa.int32())],
            names=["hi", "lo", "docs", "part"])


def _dropped(min_docs: int, keep_first: bool, edges):
    """Positions that go, out of sorted rows; holds back at most ``min_docs`` documents of one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = edges.value, TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        going: tuple | None = None  # the line that goes and whose rows still come
        for batch in _then_end(batches):
            last = batch is None
            rows = [b for b in (held, batch) if b is not None]
            if not rows:
                return
            table = pa.Table.from_batches(rows).combine_chunks()
            held = None
            if not table.num_rows:
                continue
            now = table.to_batches()[0]
            line, doc, cols = _sorted_runs(now)
            starts = np.flatnonzero(line)
            counts = np.add.reduceat(doc.astype(np.int64), starts)
            goes = counts >= min_docs
            for run_at in {0, len(starts) - 1}:
                here = (int(cols[starts[run_at], 0]), int(cols[starts[run_at], 1]))
                goes[run_at] |= here == going or known.get(here, (0, 0))[0] >= min_docs
            continues = going == (int(cols[0, 0]), int(cols[0, 1]))
            stop = len(cols)
            if not last and not goes[-1]:
                stop = starts[-1]
                held = now.slice(stop)
            gone = np.repeat(goes, np.diff(np.append(starts, len(cols))))[:stop]
            if keep_first:
                gone = gone.copy()
                for run_at, s in enumerate(starts[starts < stop]):
                    here = (int(cols[s, 0]), int(cols[s, 1])) if run_at in (0, len(starts) - 1) else None
                    if not (run_at == 0 and continues) and (here not in known or known[here][1] == part):
                        gone[s] = False
            going = (int(cols[-1, 0]), int(cols[-1, 1])) if goes[-1] else None
            keep = np.flatnonzero(gone)
            yield pa.RecordBatch.from_arrays(
                [now.column(c).take(pa.array(keep)) for c in (2, 3, 4, 5)],
                names=["has_id", "doc_id", "text_hash", "position"])
    return run


def _then_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for gone in batch.column("gone").to_pylist():
            keep = np.ones((max(gone) // 8 + 1) * 8, bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("has_id"), batch.column("doc_id"), batch.column("text_hash"),
             pc.list_value_length(batch.column("gone")).cast(pa.int64()), pa.array(maps, pa.binary())],
            names=["has_id", "doc_id", "text_hash", "n_dropped", "keep"])


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Bitmaps of kept lines of the documents that lose any.

    A line's key is the line stripped of ASCII white space with A-Z
    lower-cased.  Lines whose key has at least ``min_chars`` code points and is
    found in at least ``min_docs`` documents go: all of them, or with
    ``keep_first`` all but the first in order of document and position.
    Documents are distinct pairs of ``doc_id`` and text; repeated rows are one
    document and share a bitmap, a null ``doc_id`` is an id like any other, a
    null text is one empty line.  Empty keys never go.  Returns ``has_id``
    (false for a null id, then ``doc_id`` is 0), ``doc_id``, ``text_hash``,
    ``n_dropped`` and ``keep``: zlib-compressed bits, most significant first,
    1 for a kept line; lines beyond its end are kept.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    order = ["hi", "lo", "has_id", "doc_id", "text_hash"]
    rows = durable(
        keyed.mapInArrow(_line_rows(min_chars), _LINE_SCHEMA)
        .repartitionByRange(*order).sortWithinPartitions(*order, "position")
    )
    edges: dict[tuple[int, int], tuple[int, int]] = {}
    for r in rows.mapInArrow(_edge_counts, "hi long, lo long, docs long, part int").collect():  # two rows a partition
        docs_so_far, part = edges.get((r.hi, r.lo), (0, r.part))
        edges[r.hi, r.lo] = (docs_so_far + r.docs, min(part, r.part))
    known = spark.sparkContext.broadcast(edges)
    gone = rows.mapInArrow(
        _dropped(min_docs, keep_first, known), "has_id boolean, doc_id long, text_hash long, position int")
    per_doc = gone.groupBy("has_id", "doc_id", "text_hash").agg(F.collect_set("position").alias("gone"))
    return per_doc.mapInArrow(
        _bitmaps, "has_id boolean, doc_id long, text_hash long, n_dropped long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 1024):
        n_lines, n_dropped, sums, kept_texts = [], [], [], []
        for text, keep in zip(texts(batch), batch.column("__keep").to_pylist(), strict=True):
            lines = text.split("\n")
            kept = lines
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:len(lines)]
                kept = list(compress(lines, bits.tolist() + [1] * (len(lines) - len(bits))))
            joined = "\n".join(kept) if len(kept) < len(lines) else text
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            sums.append(hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest())
            kept_texts.append(joined)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names if c not in ("text", "__keep")), pa.array(kept_texts, pa.string()),
             pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sums, pa.string())],
            names=[*(c for c in batch.schema.names if c not in ("text", "__keep")), "text", "n_lines", "n_dropped", "kept_sha256"])


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, by :func:`line_keep_bitmaps`.

    All rows and other columns stay; ``n_lines`` (before), ``n_dropped`` and
    ``kept_sha256`` of the new text are added (columns of these names are
    replaced).  A null text becomes the empty text.  No rows give no rows.
    """
    added = ("n_lines", "n_dropped", "kept_sha256")
    docs = docs.drop(*added)
    maps = line_keep_bitmaps(docs, min_docs, min_chars, keep_first).select(
        F.col("has_id").alias("__has_id"), F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"),
        F.col("keep").alias("__keep"))
    joined = docs.join(
        maps, (docs["doc_id"].isNotNull() == F.col("__has_id"))
        & (F.coalesce(docs["doc_id"], F.lit(0)) == F.col("__doc_id")) & (F.xxhash64(docs["text"]) == F.col("__text_hash")), "left",
    ).select(*[docs[c] for c in docs.columns], "__keep")
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept),
                        "text string", "n_lines long", "n_dropped long", "kept_sha256 string"])
    return joined.mapInArrow(_apply, schema)
