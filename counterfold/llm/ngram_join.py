"""Near-duplicate documents by the Jaccard similarity of their word n-grams, exactly.

The join follows set relations.  Equal sets are one class.  Of each class, the
rarest n-grams form a prefix that any similar set must meet (at similarity
3/4: a quarter of the set), filed in index lists by n-gram.  Lists are
sorted by set size and position and cut into blocks; a pair of blocks, and
then a pair of entries, is skipped when sizes and positions leave too small an
overlap.  Long lists are not joined pair by pair: first each set is compared with a
few leaders of its list, and what the answers already say is not asked again.
Sets in the component of a leader need no further comparison with each other,
and a set's distance to a leader bounds its distance to that leader's other
neighbours (the symmetric difference obeys the triangle inequality).  Of
two components that still meet in a list, the closest pair is asked first, which
joins most of a large group.  What remains is compared exactly, so no link
between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfold.llm.common import in_slices, small_batches, texts, words_of
from counterfold.llm.components import connected_components
from counterfold.session import durable

#: Two sets link when ``DEN * intersection >= NUM * union``.
NUM, DEN = 3, 4
#: n-grams known to be frequent, at most: they only come last in the order of a prefix.
FREQUENT = 262_144
#: An n-gram is reported by a task that meets it so often in this many n-grams.
LOCAL_TIMES, LOCAL_GRAMS = 3, 2_000_000
#: Lists up to this length are joined pair by pair; entries in a block of longer ones.
SHORT_LIST, BLOCK = 24, 1_024
#: Leaders of each block that all its sets are compared with first.
LEADERS = 6
#: Bits of the sketch of a set (parity of the n-grams in each cell).
SKETCH_BITS = 4_096
#: Bits of a filter of ids: so many for each id, and at least and at most so many in all.
ID_BITS, FILTER_BITS = 16, (1 << 16, 1 << 26)

_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class Shingler:
    """Distinct hashed word n-grams of a text, as sorted unsigned 64-bit numbers."""

    def __init__(self, words: int = 5, limit: int = 200_000) -> None:
        self.words, self.limit = words, limit
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        ws = words_of(text)
        n = len(ws)
        if not n:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.limit:
            self.known = {}
        known, digest = self.known, xxhash.xxh3_64_intdigest
        for w in {w for w in ws if w not in known}:
            known[w] = digest(w)
        a = np.fromiter(map(known.__getitem__, ws), np.uint64, n)
        k = min(self.words, n)
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ a[i:n - k + 1 + i]) * _MULTIPLIERS[i % 5]
            h ^= h >> np.uint64(29)
        return np.unique(h)


def prefix_length(n: int) -> int:
    """n-grams of which a set of ``n`` shares at least one with every linked set."""
    return n - -(-NUM * n // DEN) + 1


def may_link(n_a: np.ndarray, at_a: np.ndarray, n_b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Whether sets that first meet at these positions can overlap enough.

    They link when the overlap is at least 3/7 of both sizes together; it is at
    most what is left of either set from the position on.
    """
    left = np.minimum(n_a - at_a, n_b - at_b)
    return (left * (NUM + DEN) >= NUM * (n_a + n_b)) & (DEN * np.minimum(n_a, n_b) >= NUM * np.maximum(n_a, n_b))


def _linked(overlap: int, n_a: int, n_b: int) -> bool:
    return DEN * overlap >= NUM * (n_a + n_b - overlap)


def _repeated(grams: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that ``grams`` holds so often at least, ascending, and how often; sorts it in place, copies nothing of its size."""
    grams.sort()
    again = grams[times - 1:] == grams[:max(0, len(grams) - times + 1)]
    again[1:] &= grams[1:len(again)] != grams[:max(0, len(again) - 1)]  # the first of each value
    found = grams[:len(again)][again]
    return found, np.searchsorted(grams, found, "right") - np.searchsorted(grams, found, "left")


def frequent_grams(docs: DataFrame, words: int) -> np.ndarray:
    """Frequent n-grams of all documents, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, size = Shingler(words), [], 0

        def often() -> pa.RecordBatch:
            grams, n = _repeated(np.concatenate([np.zeros(0, np.uint64), *held]), LOCAL_TIMES)
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in in_slices(batches, 512):
            for text in texts(batch):
                held.append(shingle(text))
                size += len(held[-1])
                if size > LOCAL_GRAMS:
                    yield often()
                    held, size = [], 0
        yield often()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in ("gram", "n")], names=["gram", "n"])

    top = (
        docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "gram").limit(FREQUENT).mapInArrow(joined, "gram binary, n binary").collect()
    )
    gram, n = (np.frombuffer(b"".join([r[c] for r in top]), np.int64) for c in (0, 1))
    return gram[np.lexsort((~gram, n))].view(np.uint64)


def _sketch(grams: np.ndarray) -> bytes:
    cells = np.bincount((grams >> np.uint64(20)).astype(np.int64) & (SKETCH_BITS - 1), minlength=SKETCH_BITS)
    return np.packbits((cells & 1).astype(bool)).tobytes()


def _summaries(words: int, frequent):
    """Size, fingerprint and prefix of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        grams = frequent.value
        by_value = np.argsort(grams)
        values = grams[by_value]
        maybe = np.zeros(1 << 22, bool)  # most n-grams aren't frequent: these bits spare their search
        maybe[(values & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in in_slices(batches, 512):
            n, hi, lo, prefix = [], [], [], []
            for text in texts(batch):
                s = shingle(text)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                hi.append(int.from_bytes(digest[:8], "big", signed=True))
                lo.append(int.from_bytes(digest[8:], "big", signed=True))
                if not len(s):
                    prefix.append(b"")
                    continue
                p = prefix_length(len(s))
                rank = np.zeros(len(s), np.int64)
                found = np.flatnonzero(maybe[(s & np.uint64((1 << 22) - 1)).astype(np.int64)])
                if len(found):
                    at = np.minimum(np.searchsorted(values, s[found]), len(values) - 1)
                    rank[found] = np.where(values[at] == s[found], by_value[at] + 1, 0)
                if (rank == 0).sum() >= p:
                    chosen = np.flatnonzero(rank == 0)[:p]  # by value, as the set is sorted
                else:
                    chosen = np.argsort(rank, kind="stable")[:p]
                prefix.append(s[chosen].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                 pa.array(prefix, pa.binary())],
                names=["doc_id", "n", "hi", "lo", "prefix"])
    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries: n-gram, size and position in one number, set."""
    for batch in in_slices(batches, 2048):
        grams = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
        count = [len(g) for g in grams]
        size = np.repeat(batch.column("n").to_numpy(), count)
        at = np.concatenate([np.arange(c) for c in count] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(grams or [np.zeros(0, np.int64)])), pa.array((size << 32 | at).astype(np.int64)),
             pa.array(np.repeat(batch.column("doc_id").to_numpy(), count).astype(np.int64))],
            names=["gram", "place", "id"])


_LISTED = "a long, b long, gram long, places binary, ids binary, place0 long, id0 long"


def _listed(pairs: np.ndarray, blocks: list[tuple]) -> pa.RecordBatch:
    """Rows with a pair, then rows with a block."""
    k, none = len(pairs), [None] * len(blocks)
    columns = list(zip(*blocks, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([*pairs[:, 0].tolist(), *none], pa.int64()), pa.array([*pairs[:, 1].tolist(), *none], pa.int64()),
         *(pa.array([*[None] * k, *c], t) for c, t in zip(columns, kinds, strict=True))],
        names=["a", "b", "gram", "places", "ids", "place0", "id0"])


def _as_blocks(gram: int, place: np.ndarray, ids: np.ndarray, block: int) -> list[tuple]:
    return [(gram, place[s:s + block].tobytes(), ids[s:s + block].tobytes(), int(place[s]), int(ids[s]))
            for s in range(0, len(ids), block)]


def _pairs_of_runs(place: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pairs that may link within short lists; lists of one length are handled together."""
    out = [np.zeros((0, 2), np.int64)]
    for n in np.unique(lengths[lengths >= 2]).tolist():
        rows = starts[lengths == n][:, None] + np.arange(n)[None, :]
        i, j = np.triu_indices(n, 1)
        for s in range(0, len(rows), 4096):
            a, b = rows[s:s + 4096][:, i].ravel(), rows[s:s + 4096][:, j].ravel()
            ok = (ids[a] != ids[b]) & may_link(place[a] >> 32, place[a] & 0xFFFFFFFF, place[b] >> 32, place[b] & 0xFFFFFFFF)
            a, b = ids[a[ok]], ids[b[ok]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    found = np.concatenate(out)
    return np.unique(found, axis=0) if len(found) else found


def _lists(short_list: int, block: int):
    """Sorted entries to pairs of short lists and blocks of long ones.

    The first and the last list of a partition may go on in the next, so they
    become blocks whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last list so far, which may go on
        first = True
        for batch in batches:
            gram, place, ids = (batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "place", "id"))
            if not len(gram):
                continue
            if held is not None:
                if held[0][0] == gram[0] and len(held[0]) >= block:  # a long list goes on: pass on what is full
                    yield _listed(np.zeros((0, 2), np.int64), _as_blocks(int(held[0][0]), held[1], held[2], block))
                    held, first = None, True
                else:
                    gram, place, ids = np.concatenate([held[0], gram]), np.concatenate([held[1], place]), np.concatenate([held[2], ids])
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            lengths = np.diff(np.append(starts, len(gram)))
            blocks: list[tuple] = []
            last = starts[-1]
            held = (gram[last:], place[last:], ids[last:])
            starts, lengths = starts[:-1], lengths[:-1]
            if first and len(starts):
                blocks += _as_blocks(int(gram[0]), place[:lengths[0]], ids[:lengths[0]], block)
                starts, lengths, first = starts[1:], lengths[1:], False
            for s, n in zip(starts[lengths > short_list].tolist(), lengths[lengths > short_list].tolist(), strict=True):
                blocks += _as_blocks(int(gram[s]), place[s:s + n], ids[s:s + n], block)
            short = lengths <= short_list
            pairs = _pairs_of_runs(place, ids, starts[short], lengths[short])
            if len(pairs) or blocks:
                yield _listed(pairs, blocks)
        if held is not None:
            yield _listed(np.zeros((0, 2), np.int64), _as_blocks(int(held[0][0]), held[1], held[2], block))
    return run


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A fixed random order of sets, so that lists of the same sets choose the same leaders."""
    h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(31))


def _parsed(row_places: bytes, row_ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = np.frombuffer(row_places, np.int64)
    return place >> 32, place & 0xFFFFFFFF, np.frombuffer(row_ids, np.int64)


def _with_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set of a block with the block's leaders, the leader of the whole list, and the set before it."""
    for batch in batches:
        out = [np.zeros((0, 2), np.int64)]
        for places, ids, place0, id0 in zip(*(batch.column(c).to_pylist() for c in ("places", "ids", "place0", "id0")), strict=True):
            n, at, who = _parsed(places, ids)
            lead = np.argsort(_mixed(who), kind="stable")[:LEADERS]
            for n_l, at_l, who_l in [*zip(n[lead], at[lead], who[lead], strict=True), (place0 >> 32, place0 & 0xFFFFFFFF, id0)]:
                ok = may_link(n, at, n_l, at_l) & (who != who_l)
                out.append(np.stack([np.minimum(who[ok], who_l), np.maximum(who[ok], who_l)], 1))
            ok = may_link(n[1:], at[1:], n[:-1], at[:-1]) & (who[1:] != who[:-1])
            a, b = who[1:][ok], who[:-1][ok]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


_NEAREST = "block long, block2 long, label long, label2 long, a long, b long"


def _across(nearest: bool):
    """Pairs of different components in two blocks of one list (or within one).

    Left out are those that a known distance or their sketches forbid.  With
    ``nearest`` two components have one pair here, of the closest sketches, told
    with the blocks and labels; without, only those of ``open`` have pairs, and all.
    """
    of_block = ("block", "places", "ids", "labels", "leaders", "far", "sketches")
    names = [*of_block, *(f"{c}2" for c in of_block), *["open"] * (not nearest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 4):  # a row has up to 1 MB
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                one, p1, i1, l1, d1, f1, s1, two, p2, i2, l2, d2, f2, s2, *left = row
                s1, s2 = (np.frombuffer(x, np.uint64).reshape(-1, SKETCH_BITS // 64) for x in (s1, s2))
                n1, at1, w1 = _parsed(p1, i1)
                n2, at2, w2 = _parsed(p2, i2)
                l1, d1, f1, l2, d2, f2 = (np.frombuffer(x, np.int64) for x in (l1, d1, f1, l2, d2, f2))
                wanted: dict[int, list[int]] = {}
                for x in left[0] if left else ():
                    wanted.setdefault(x["label"], []).append(x["label2"])
                    wanted.setdefault(x["label2"], []).append(x["label"])
                found = [np.zeros((0, 5), np.int64)]
                for i in range(len(w1)):
                    other = l2 != l1[i] if nearest else np.isin(l2, wanted.get(int(l1[i]), []))
                    js = np.flatnonzero(other & may_link(n1[i], at1[i], n2, at2) & ((w2 > w1[i]) if one == two else True))
                    if len(js):
                        # both know their distance to the same leader: theirs is at least the difference
                        same = (d1[i] == d2[js]) & (f1[i] >= 0) & (f2[js] >= 0)
                        js = js[~same | (np.abs(f1[i] - f2[js]) * (NUM + DEN) <= (DEN - NUM) * (n1[i] + n2[js]))]
                        differ = np.bitwise_count(s1[i] ^ s2[js]).sum(1).astype(np.int64)
                        ok = (differ * (NUM + DEN) <= (DEN - NUM) * (n1[i] + n2[js])) | (f1[i] == -2) | (f2[js] == -2)
                        js, differ = js[ok], differ[ok]
                        if nearest:
                            by = np.argsort(differ, kind="stable")
                            by = by[np.unique(l2[js[by]], return_index=True)[1]]
                            js, differ = js[by], differ[by]
                        found.append(np.stack([np.minimum(l1[i], l2[js]), np.maximum(l1[i], l2[js]), differ,
                                               np.minimum(w1[i], w2[js]), np.maximum(w1[i], w2[js])], 1))
                pairs = np.concatenate(found)
                if nearest:
                    pairs = pairs[np.lexsort(pairs.T[::-1])]
                    pairs = pairs[np.unique(pairs[:, :2], axis=0, return_index=True)[1]]
                    out = [np.full(len(pairs), one), np.full(len(pairs), two), *pairs[:, [0, 1, 3, 4]].T]
                else:
                    out = [*np.unique(pairs[:, 3:], axis=0).T]
                for s in range(0, len(pairs), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[s:s + 100_000]) for c in out], names=["block", "block2", "label", "label2", "a", "b"][-len(out):])
    return run


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, unpack = Shingler(words), zstandard.ZstdDecompressor().decompress
        for batch in in_slices(batches, 256):
            got = [shingle(unpack(t).decode("utf-8", "surrogatepass")) for t in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in got], pa.int64()), pa.array([_sketch(s) for s in got], pa.binary())],
                names=["id", "n", "sketch"])
    return run


def _sketches_allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of different parity are at most the symmetric difference, which links bound by 1/7 of both sizes."""
    for batch in batches:
        a = np.frombuffer(b"".join(batch.column("sketch_a").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        b = np.frombuffer(b"".join(batch.column("sketch_b").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        differ = np.bitwise_count(a ^ b).sum(1).astype(np.int64)
        size = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        keep = pa.array(differ * (NUM + DEN) <= (DEN - NUM) * size)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _overlaps(words: int):
    """Exact symmetric differences of pairs of texts; rows come sorted by ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, unpack = Shingler(words), zstandard.ZstdDecompressor().decompress
        last, b = None, np.zeros(0, np.uint64)
        for batch in in_slices(batches, 256):
            differ, linked = [], []
            for x, y in zip(batch.column("packed_a").to_pylist(), batch.column("packed_b").to_pylist(), strict=True):
                if y != last:
                    last, b = y, shingle(unpack(y).decode("utf-8", "surrogatepass"))
                a = shingle(unpack(x).decode("utf-8", "surrogatepass"))
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                overlap = int((both[1:] == both[:-1]).sum())
                differ.append(len(a) + len(b) - 2 * overlap)
                linked.append(_linked(overlap, len(a), len(b)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(differ, pa.int64()), pa.array(linked, pa.bool_())],
                names=["a", "b", "differ", "linked"])
    return run


def _allowed(pairs: DataFrame, light: DataFrame) -> DataFrame:
    """The pairs that their sketches allow."""
    one = light.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = light.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(_sketches_allow, "a long, b long")


def _compare(pairs: DataFrame, full: DataFrame, words: int) -> DataFrame:
    """``a``, ``b``, ``differ`` (symmetric difference) and ``linked`` of pairs.

    Packed texts travel to the comparison rather than sets of hashes, which are longer and don't compress.
    """
    left = durable(pairs)
    needed = full.mapInArrow(
        _only(_possible(left.select(F.explode(F.array("a", "b")).alias("id")))), "doc_id long, packed binary")
    full_one = needed.select(F.col("doc_id").alias("a"), F.col("packed").alias("packed_a"))
    full_two = needed.select(F.col("doc_id").alias("b"), F.col("packed").alias("packed_b"))
    return durable(left.join(full_one, "a").join(full_two, "b").mapInArrow(
        _overlaps(words), "a long, b long, differ long, linked boolean"))


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    h, mask = _mixed(ids), np.uint64(size - 1)
    return np.concatenate([h & mask, (h >> np.uint64(33)) & mask]).reshape(2, -1)


def _possible(ids: DataFrame):
    """A filter of 16 bits an id, 8 MB at most: what it refuses is not among them.

    The driver joins what four tasks return, so for few ids it must not be large.
    """
    size = min(max(1 << (ID_BITS * ids.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = _bits(batch.column("id").to_numpy().astype(np.int64), size).ravel().astype(np.int64)
            np.bitwise_or.at(have, at >> 3, (1 << (7 - (at & 7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([have.tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(size // 8, np.uint8)
    for r in ids.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(total)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in in_slices(batches, 1024):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in texts(batch)], pa.binary())],
            names=["doc_id", "packed"])


def _only(possible):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(batch.column("doc_id").fill_null(0).to_numpy().astype(np.int64), 8 * len(possible.value)).astype(np.int64)
            yield batch.filter(pa.array(((possible.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)))
    return run


def near_duplicates(docs: DataFrame, words: int = 5, short_list: int = SHORT_LIST, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Words are runs of other than ASCII white space with A-Z lower-cased; a
    set is the distinct ``words``-grams of a text, or the whole sequence where
    it is shorter.  Documents link when their Jaccard similarity is at least
    3/4; ``component_id`` is the least ``doc_id`` that links reach.  Texts that
    are null, empty or without words have an empty set and link with nothing.  A row without an id
    links with nothing and has a null ``component_id``.  Rows that repeat are
    returned each; rows of one id with several texts are one document that
    links by any of them.  No rows give none; other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs.select("doc_id", "text"), words, short_list, block)


def _only_packed(possible):
    """:func:`_only` and :func:`_pack` in one Python worker: two in a row would be twice the workers that an executor keeps."""
    only = _only(possible)
    return lambda batches: _pack(only(batches))


def _near_duplicates(docs: DataFrame, words: int, short_list: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(docs, words))
    summary = durable(docs.mapInArrow(_summaries(words, frequent), "doc_id long, n long, hi long, lo long, prefix binary"))
    usable = summary.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = durable(usable.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")))
    firsts = usable.join(classes, ["hi", "lo"]).where(F.col("doc_id") == F.col("rep")).select("doc_id", "n", "prefix")
    order = ["gram", "place", "id"]
    listed = durable(
        firsts.mapInArrow(_entries, "gram long, place long, id long").repartitionByRange(*order)
        .sortWithinPartitions(*order).mapInArrow(_lists(short_list, block), _LISTED))
    pairs = durable(listed.where(F.col("a").isNotNull()).select("a", "b").distinct())
    blocks = listed.where(F.col("ids").isNotNull()).drop("a", "b")
    heads = blocks.groupBy("gram").agg(
        F.sum(F.length("ids")).alias("bytes"), F.min(F.struct(F.xxhash64("id0").alias("h"), "place0", "id0")).alias("head"))
    # lists with one entry in all link nothing
    blocks = durable(blocks.drop("place0", "id0").join(heads.where(F.col("bytes") > 8), "gram").select(
        "gram", "places", "ids", "head.place0", "head.id0", F.monotonically_increasing_id().alias("block")))
    to_leaders = blocks.mapInArrow(_with_leaders, "a long, b long")
    neighbours = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = neighbours.groupBy("a").agg(F.min("b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    star = durable(to_leaders.unionByName(nearest).distinct())

    in_blocks = blocks.mapInArrow(_members, "block long, seat int, id long")
    active = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(in_blocks.select("id")).distinct())
    possible = _possible(active)
    picked = docs.mapInArrow(_only_packed(possible), "doc_id long, packed binary")
    full = durable(picked.join(active, F.col("doc_id") == F.col("id"), "left_semi"))
    light = durable(full.mapInArrow(_sketches(words), "id long, n long, sketch binary"))

    answers = _compare(_allowed(star, light), full, words)
    labels = connected_components(answers.where("linked").select("a", "b"))
    label_of = active.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    label_of = durable(label_of)
    # of each set, the leader it was compared with that is least by id, and its distance
    known = answers.select(F.col("a").alias("id"), F.struct("b", "differ").alias("k")).unionByName(
        answers.select(F.col("b").alias("id"), F.struct(F.col("a").alias("b"), "differ").alias("k"))).groupBy("id").agg(F.min("k").alias("k"))
    # an id with several texts has no one sketch: -2 in place of a distance says so
    sketch_of = light.groupBy("id").agg(F.max("sketch").alias("sketch"), (F.min("sketch") != F.max("sketch")).alias("several"))
    seated = in_blocks.join(label_of, "id").join(known, "id", "left").join(sketch_of, "id").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("seat", "label", F.coalesce("k.b", F.lit(-1)).alias("leader"),
                                             F.when(F.col("several"), -2).otherwise(F.coalesce("k.differ", F.lit(-1))).alias("far"), "sketch"))).alias("seats"),
        F.min("label").alias("least"), F.max("label").alias("most"))
    labelled = durable(blocks.join(seated, "block").mapInArrow(
        _packed, "gram long, block long, places binary, ids binary, labels binary, leaders binary, far binary, sketches binary, least long, most long"))
    other = labelled.select(F.col("gram"), *[F.col(c).alias(f"{c}2") for c in labelled.columns if c != "gram"])
    meeting = labelled.join(other, "gram").where(
        (F.col("block") <= F.col("block2"))
        & ~((F.col("least") == F.col("most")) & (F.col("least2") == F.col("most2")) & (F.col("least") == F.col("least2"))))

    # First one pair for any two components that meet in blocks, as links mostly join all of a group.
    nearest = durable(meeting.mapInArrow(_across(True), _NEAREST))
    asked = answers.select("a", "b")
    first = _compare(nearest.select("a", "b").distinct().join(asked, ["a", "b"], "left_anti"), full, words)
    label_of, now = _relabelled(label_of, first)
    # Then all pairs of the components that this has left apart.
    now_of, now_of2 = (now.select(F.col("id").alias(c), F.col("component").alias(f"now_{c}")) for c in ("label", "label2"))
    still = nearest.join(now_of, "label", "left").join(now_of2, "label2", "left").where(
        F.coalesce("now_label", "label") != F.coalesce("now_label2", "label2")).groupBy("block", "block2").agg(
        F.collect_list(F.struct("label", "label2")).alias("open"))
    across = labelled.join(still, "block").join(other.drop("gram"), "block2").mapInArrow(_across(False), "a long, b long")
    of_a, of_b = (label_of.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
    apart = pairs.join(of_a, "a").join(of_b, "b").where("label_a <> label_b").select("a", "b")
    asked = asked.unionByName(first.select("a", "b"))
    rest = across.unionByName(_allowed(apart, light)).distinct().join(asked, ["a", "b"], "left_anti")
    component, _ = _relabelled(label_of, _compare(rest, full, words))
    component = component.withColumnRenamed("label", "component")
    of_class = classes.join(component, classes["rep"] == component["id"], "left").select(
        "hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    return summary.join(of_class, ["hi", "lo"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _relabelled(label_of: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels after new links joined components, and the components of the labels that these touched."""
    of_a, of_b = (label_of.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
    now = connected_components(answers.where("linked").join(of_a, "a").join(of_b, "b").select(
        F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
    return durable(label_of.join(now.withColumnRenamed("id", "label"), "label", "left").select(
        "id", F.coalesce("component", "label").alias("label"))), now


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(i, np.int64) for i in batch.column("ids").to_pylist()]
        count = [len(i) for i in ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("block").to_numpy(), count)),
             pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in count] or [np.zeros(0, np.int32)])),
             pa.array(np.concatenate(ids or [np.zeros(0, np.int64)]))], names=["block", "seat", "id"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 16):
        packed = {c: [] for c in ("label", "leader", "far")}
        sketches = []
        for seats in batch.column("seats").to_pylist():
            sketches.append(b"".join([s["sketch"] for s in seats]))
            for c, out in packed.items():
                out.append(np.array([s[c] for s in seats], np.int64).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("gram"), batch.column("block"), batch.column("places"), batch.column("ids"),
             *(pa.array(v, pa.binary()) for v in packed.values()), pa.array(sketches, pa.binary()), batch.column("least"), batch.column("most")],
            names=["gram", "block", "places", "ids", "labels", "leaders", "far", "sketches", "least", "most"])
