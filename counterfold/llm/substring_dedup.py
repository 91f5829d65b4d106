"""Removing passages that were there before, by Rabin-Karp hashes of word windows.

Every window of ``window`` consecutive words has a rolling hash.  Windows that
start earlier in the corpus stay, later ones with the same words go, and what
the later ones cover is merged into maximal intervals of words.

Shuffling a row for every window would cost many times the text, so windows are
counted in two steps, both exact.  The anchor of a window is the place of the
least hash among its short grams.  Equal windows have equal anchors, so a window
whose anchor gram is found once in the whole corpus is not repeated.  About one
place in seven is an anchor; only they are counted first.  Then only the windows
whose anchors repeat are counted, by their own 64-bit hash and 32 bits of the anchor's.

Later copies of a whole text take no part: the first copy stands for them, and all
they lose is known beforehand.

Within a slice of a task equal grams and windows meet before the shuffle: one
row for each goes on, the others are decided at once, so a passage that a third
of all documents hold is a row per slice and not a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterfold.functions.skew import spread_join
from counterfold.llm.common import texts

#: Bytes of text that are hashed at once; a longer text is hashed piece by piece.
SLICE_BYTES = 4 << 20
#: Words of the grams that anchor windows (shorter for short windows).
GRAM_WORDS = 8

#: As a number of windows: all that the text has.
_ALL = 2**30

_KEY = ["has_id", "doc_id", "text_hash"]
_KEY_SCHEMA = "has_id boolean, doc_id long, text_hash long"
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE_VALUES = np.random.default_rng(20_13).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self._base, self._inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self._up = self._down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            self._up, self._down = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (self._base, self._inverse))
        return self._up[:n], self._down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Rabin-Karp hashes of ``values[start:end]``, from differences of one running sum."""
    up, down = powers(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it is in, for texts laid end to end."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | edge[1:])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):  # whole words of about SLICE_BYTES
        begin = starts[done]
        stop = max(done + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, "right")))
        part = slice(done, stop)
        values = _BYTE_VALUES[data[begin:ends[stop - 1]]]
        hashes[part] = _spans(values, starts[part] - begin, ends[part] - begin, _BYTE_POWERS)
        done = stop
    return hashes, owner


def _first_words(owner: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(rows))


def _windows(hashes: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside one text, the place of each one's anchor, and the hashes of all grams."""
    gram = min(GRAM_WORDS, window)
    places = np.arange(len(hashes) - gram + 1)
    grams = _spans(hashes, places, places + gram, _WORD_POWERS)
    starts = np.flatnonzero(owner[:len(owner) - window + 1] == owner[window - 1:])
    # the leftmost least of ``reach`` grams, from the leftmost least of ever more of them
    reach, least, width = window - gram + 1, places, 1
    while width < reach:
        step = min(width, reach - width)
        left, right = least[:len(least) - step], least[step:]
        least = np.where(grams[left] <= grams[right], left, right)
        width += step
    return starts, least[starts], grams


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``SLICE_BYTES`` of text, with the hashes of their words and the words' rows."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
        row = 0
        while row < len(text):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
            here = offsets[row:stop + 1] - offsets[row]
            hashes, owner = _word_hashes(data[offsets[row]:offsets[stop]], here)
            yield batch.slice(row, stop - row), hashes, owner
            row = stop


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keys(rows: pa.RecordBatch, owner: np.ndarray) -> list[pa.Array]:
    at = pa.array(owner)
    return [rows.column(c).take(at) for c in _KEY]


def _anchor_rows(window: int):
    """A row per anchor: what its gram is dealt by, and its place with a last bit that says that the gram is known to repeat.

    Columns that differ from row to row come first and what a text's rows share comes
    last, which takes far less to shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, owner in _slices(batches):
            if len(hashes) < window:
                continue
            _, anchors, grams = _windows(hashes, owner, window)
            anchors = np.flatnonzero(np.bincount(anchors, minlength=1))
            value = grams[anchors]
            order = np.argsort(value, kind="stable")
            ordered = value[order]
            head = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:len(ordered)]
            begins = np.flatnonzero(head)
            known = np.ones(len(order), np.int64)  # of later ones it is known that they repeat
            known[begins] = np.diff(np.append(begins, len(order))) > 1
            deal = np.where(head, ordered, _mixed(ordered ^ (order.astype(np.uint64) << np.uint64(20)) ^ np.uint64(len(hashes))))
            back = np.argsort(order)
            at = owner[anchors]
            place = anchors - _first_words(owner, rows.num_rows)[at]
            yield pa.RecordBatch.from_arrays(
                [_signed(deal[back]), pa.array(place << 1 | known[back]), *_keys(rows, at)], names=["deal", "place", *_KEY])
    return run


def _window_rows(window: int):
    """Windows whose anchors repeat.

    The earliest of each in a slice goes on by its hash with ``n`` = 0; runs of
    ``n`` later ones, which are already decided, are dealt out by their place.
    ``second`` holds 32 bits of the anchor's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, owner in _slices(batches):
            if len(hashes) < window:
                continue
            starts, anchors, grams = _windows(hashes, owner, window)
            first = _first_words(owner, rows.num_rows)
            repeats = np.zeros(len(hashes), bool)
            for row, places in enumerate(rows.column("__places")):
                repeats[first[row] + places.values.to_numpy()] = True
            wanted = repeats[anchors]
            starts, second = starts[wanted], grams[anchors[wanted]]
            if not len(starts):
                continue
            value = _spans(hashes, starts, starts + window, _WORD_POWERS)
            at = owner[starts]
            has_id, doc_id, text_hash = (rows.column(c).to_numpy(zero_copy_only=False) for c in _KEY)
            rank = np.empty(rows.num_rows, np.int64)  # rows in the order of documents; repeated rows are one document
            by = np.lexsort([text_hash, doc_id, ~has_id])
            same = [c[by][1:] == c[by][:-1] for c in (has_id, doc_id, text_hash)]
            rank[by] = np.cumsum(np.concatenate([[0], ~np.logical_and.reduce(same)]))
            place = starts - first[at]
            order = np.lexsort([place, rank[at], second, value])
            v, s, r, p = value[order], second[order], rank[at][order], place[order]
            new = np.concatenate([[True], (v[1:] != v[:-1]) | (s[1:] != s[:-1])])
            begins = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            earliest = (r == r[begins][group]) & (p == p[begins][group])
            goes = np.zeros(len(starts), bool)
            goes[order[~earliest]] = True
            late = np.flatnonzero(goes)
            joined = (np.diff(starts[late]) == 1) & (np.diff(at[late]) == 0)
            run_begin = np.flatnonzero(np.concatenate([[True], ~joined])[:len(late)])
            length = np.diff(np.append(run_begin, len(late)))
            out = np.concatenate([np.flatnonzero(~goes), late[run_begin]])
            n = np.concatenate([np.zeros(len(starts) - len(late), np.int32), length.astype(np.int32)])
            out, n = (c[np.argsort(out)] for c in (out, n))
            spread = _mixed(value[out] + (place[out].astype(np.uint64) << np.uint64(20)) + text_hash[at[out]].view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [_signed(np.where(n > 0, spread, value[out])), pa.array((second[out] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                 pa.array(place[out].astype(np.int32)), *_keys(rows, at[out]), pa.array(n)],
                names=["value", "second", "place", *_KEY, "n"])
    return run


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` with what makes a document: its id (null or not) and its text."""
    return docs.withColumns({
        "__has_id": F.col("doc_id").isNotNull(), "__doc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__text_hash": F.xxhash64("text")})


def _with(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with a table by document; the shuffle of ``docs`` is the same whenever it is done."""
    renamed = found.withColumnsRenamed({c: f"__r_{c}" for c in _KEY})
    on = [F.col(f"__{c}") == F.col(f"__r_{c}") for c in _KEY]
    return docs.join(renamed, on, how).drop(*[f"__r_{c}" for c in _KEY])


def _later_copies(docs: DataFrame) -> DataFrame:
    """Keys of documents whose whole text is that of an earlier one."""
    rows = docs.select(*[F.col(f"__{c}").alias(c) for c in _KEY], F.xxhash64(F.lit(1), "text").alias("again"), (~F.col("__has_id")).alias("no_id")).distinct()
    first = rows.groupBy("text_hash", "again").agg(F.min(F.struct("no_id", "doc_id")).alias("first"))
    # of the copies of one text, only the id tells which is first
    return spread_join(rows, first, ["text_hash", "again"], "inner", ["doc_id"]).where(
        F.struct("no_id", "doc_id") != F.col("first")).select(*_KEY)


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """Windows of ``window`` words that were there before, as runs.

    ``docs`` comes from :func:`_marked`.  Returns ``has_id``, ``doc_id``,
    ``text_hash``, ``place`` (first word of the first window, from 0) and ``n``
    (number of windows in a row; more than the text has for a later copy of a whole text).
    """
    copies = _later_copies(docs)
    fresh = _with(docs, copies.withColumn("__copy", F.lit(True)), "left").where("__copy IS NULL").drop("__copy")

    # all columns go to the task, so that the documents are shuffled but once for the three joins with them
    def narrow(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(f"__{c}") for c in _KEY), *(b.column(c) for c in more)], names=[*_KEY, *more])

    anchor, find = _anchor_rows(window), _window_rows(window)
    anchors = fresh.mapInArrow(lambda batches: anchor(narrow(batches, "text")), f"deal long, place long, {_KEY_SCHEMA}")
    often = anchors.withColumn("__all", F.sum(1 + F.col("place") % 2).over(Window.partitionBy("deal"))).where("__all > 1")
    places = often.groupBy(*_KEY).agg(F.collect_set(F.shiftright("place", 1)).alias("places"))
    windows = _with(docs, places.withColumnRenamed("places", "__places"), "inner").mapInArrow(
        lambda batches: find(narrow(batches, "text", "__places")), f"value long, second int, place int, {_KEY_SCHEMA}, n int")
    order = Window.partitionBy("value", "second").orderBy(F.col("has_id").desc(), "doc_id", "text_hash", "place")
    later = windows.withColumn("__rank", F.rank().over(order)).where("n > 0 OR __rank > 1")
    return later.select(*_KEY, "place", F.greatest("n", F.lit(1)).alias("n")).unionByName(
        copies.select(*_KEY, F.lit(0).alias("place"), F.lit(_ALL).alias("n")))


def _merged(runs: list[dict], window: int, n_words: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that runs of windows cover; ends are exclusive."""
    out: list[tuple[int, int]] = []
    if n_words < window:
        return out
    for begin, end in sorted((r["place"], min(n_words, r["place"] + r["n"] - 1 + window)) for r in runs):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((begin, end))
    return out


def _without(window: int, kept_columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sums, kept_texts, intervals = [], [], [], [], []
            for text, runs in zip(texts(batch), batch.column("__runs").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                gone = _merged(runs or [], window, len(words))
                kept, done = [], 0
                for begin, end in gone:
                    kept += words[done:begin]
                    done = end
                kept += words[done:]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sums.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined.decode("utf-8", "surrogatepass"))
                intervals.append([{"begin": b, "end": e} for b, e in gone])
            span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept_columns), pa.array(kept_texts, pa.string()), pa.array(n_words, pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array(sums, pa.string()), pa.array(intervals, span)],
                names=[*kept_columns, "text", "n_words", "n_removed", "kept_sha256", "removed"])
    return run


def drop_repeated_passages(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` without the words that a repeated window of ``window`` words covers.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A window is repeated if the same
    words also start earlier: in a document of smaller ``doc_id``, or earlier in
    the same document.  All windows are judged on the input.  A null ``doc_id``
    comes after all ids.  Documents are distinct pairs of ``doc_id`` and text:
    repeated rows are one document and come out alike, different texts of one
    id are ordered by a hash of the text.  A null text, like an empty one,
    has no words; texts of fewer than ``window`` words lose nothing; no rows
    give no rows.

    All rows and other columns stay.  ``text`` becomes the kept words joined by
    one space; ``n_words`` (before), ``n_removed``, ``kept_sha256`` and
    ``removed`` (maximal intervals of word numbers, end exclusive) are added and
    replace columns of these names.
    """
    if window < 1:
        raise ValueError(f"a window has at least one word, not {window}")
    marked = _marked(docs.drop("n_words", "n_removed", "kept_sha256", "removed"))
    runs = repeated_windows(marked, window).groupBy(*_KEY).agg(F.collect_set(F.struct("place", "n")).alias("__runs"))
    kept = [f for f in docs.schema.fields if f.name not in ("text", "n_words", "n_removed", "kept_sha256", "removed")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string", "n_words long", "n_removed long",
                        "kept_sha256 string", "removed array<struct<begin:int,end:int>>"])
    return _with(marked, runs, "left").mapInArrow(_without(window, [f.name for f in kept]), schema)
