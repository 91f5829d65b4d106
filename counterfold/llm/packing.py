"""Packing token sequences by minimum bin slack.

Documents are cut into full windows of ``capacity`` ids; what is left of each
waits in a pool, counted by length.  For each window the longest waiting
rest is taken, and a subset-sum table kept as one bitset per length (bounded
multiset, counts by doubling) tells which total of other rests comes closest
to the capacity; walking the bitsets backwards gives the count of each length.
A window that can't be filled exactly is completed by cutting one more rest.

The work is one map over the documents: no shuffle, so neither a hot source
nor a group of copies gathers anywhere.  Each task holds a bounded pool.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from counterfold.llm.common import in_slices, texts
from counterfold.llm.word_codec import WordCodec

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset within ``counts`` whose sum comes closest to ``capacity`` from below.

    ``counts`` has how many there are of each length; the longest one that fits
    is always part of the answer.
    """
    fitting = sorted((n for n, c in counts.items() if c > 0 and n <= capacity), reverse=True)
    if not fitting:
        return {}
    first = fitting[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in fitting:
        left = counts[n] - (n == first)
        most = min(left, room // n)
        if most <= 0:
            continue
        steps.append((n, most, reach))
        dose = 1
        while most > 0:  # 1, 2, 4, ... copies reach every count up to the number there are
            now = min(dose, most)
            reach |= (reach << (n * now)) & mask
            most -= now
            dose *= 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    chosen = {first: 1}
    for n, most, before in reversed(steps):
        took = next(k for k in range(most + 1) if total >= k * n and before >> (total - k * n) & 1)
        if took:
            chosen[n] = chosen.get(n, 0) + took
            total -= took * n
    return chosen


class Packer:
    """Packs the documents of one task; emits rows of ``_COLUMNS``."""

    def __init__(self, capacity: int, pool_ids: int, first_sequence: int) -> None:
        self.capacity, self.pool_ids = capacity, pool_ids
        self.sequence = first_sequence
        self.rests: dict[int, deque] = {}
        self.counts: dict[int, int] = {}
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        at = 0
        while n - at >= self.capacity:
            self._emit(doc_id, at, ids[4 * at:4 * (at + self.capacity)], n, 0)
            self.sequence += 1
            at += self.capacity
        if n > at:
            self._wait((doc_id, at, ids[4 * at:], n))
        if self.held > self.pool_ids:
            while self.held > self.pool_ids // 2:
                self._window()

    def finish(self) -> None:
        while self.held >= self.capacity:
            self._window()
        pieces = [self._take(n) for n in sorted(self.counts, reverse=True) for _ in range(self.counts[n])]
        left = sum(len(p[2]) // 4 for p in pieces)
        # The task's last, partial window is cut at powers of two, which need no padding.
        for size in (1 << k for k in range(left.bit_length() - 1, -1, -1)):
            if left & size:
                self._fill(pieces, size)

    def _fill(self, pieces: list[tuple], size: int) -> None:
        offset = 0
        while offset < size:
            doc_id, at, ids, n = pieces.pop()
            here = min(len(ids) // 4, size - offset)
            self._emit(doc_id, at, ids[:4 * here], n, offset)
            offset += here
            if len(ids) > 4 * here:
                pieces.append((doc_id, at + here, ids[4 * here:], n))
        self.sequence += 1

    def _window(self) -> None:
        chosen = closest_fill(self.counts, self.capacity)
        full = sum(n * k for n, k in chosen.items()) == self.capacity
        # an exact filling stays the best one as long as its lengths last
        times = min(self.counts[n] // k for n, k in chosen.items()) if full else 1
        for _ in range(max(1, times)):
            offset = 0
            for n, k in chosen.items():
                for _ in range(k):
                    doc_id, at, ids, total = self._take(n)
                    self._emit(doc_id, at, ids, total, offset)
                    offset += n
            if offset < self.capacity and self.counts:
                n = max(self.counts)
                doc_id, at, ids, total = self._take(n)
                here = self.capacity - offset
                self._emit(doc_id, at, ids[:4 * here], total, offset)
                if n > here:
                    self._wait((doc_id, at + here, ids[4 * here:], total))
            self.sequence += 1

    def _wait(self, rest: tuple) -> None:
        n = len(rest[2]) // 4
        self.rests.setdefault(n, deque()).append(rest)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.held += n

    def _take(self, n: int) -> tuple:
        rest = self.rests[n].popleft()
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n], self.rests[n]
        self.held -= n
        return rest

    def _emit(self, doc_id: int | None, at: int, ids: bytes, total: int, offset: int) -> None:
        self.rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset))

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in _COLUMNS]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(_COLUMNS))


def pack_documents(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 1,
    pool_ids: int = 4_000_000,
) -> DataFrame:
    """Pieces of all ``docs`` (``doc_id``, ``text``) in sequences of ``capacity`` ids.

    A document is its token ids followed by ``end_id``; a null or empty text is
    that id alone.  Every id lies in exactly one piece.  Rows with the same or
    a null ``doc_id`` are documents of their own.  No documents give no rows;
    other columns are ignored.  ``pool_ids`` bounds the ids a task holds.
    Sequences are full, but for at most one partial window per task, which is
    cut into sequences whose lengths are powers of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordCodec(vocabulary)
        packer = Packer(capacity, pool_ids, TaskContext.get().partitionId() << 32)
        last = np.array([end_id], "<u4").tobytes()
        for batch in in_slices(batches, 256):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), codec.encode(texts(batch)), strict=True):
                packer.add(doc_id, ids + last)
            if len(packer.rows) > 20_000:
                yield packer.drain()
        packer.finish()
        yield packer.drain()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
