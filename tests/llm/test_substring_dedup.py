"""Repeated passages against a plain scan of all windows."""

from __future__ import annotations

import hashlib
import random

import pytest

from counterfold.llm import substring_dedup
from tests.llm.conftest import AWKWARD


def by_hand(rows, window):
    """Removed words and kept text of each distinct document, from a dictionary of windows."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = set(), {}
    for i, text in docs:
        words, gone = text.encode().split(), set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if w in seen:
                gone |= set(range(s, s + window))
            seen.add(w)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, text] = (len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def check(spark, rows, window, partitions=5):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_words long").repartition(partitions)
    got = substring_dedup.drop_repeated_passages(docs.withColumnRenamed("n_words", "row"), window).collect()
    want = by_hand(rows, window)
    assert len(got) == len(rows)
    for r in got:
        i, t = rows[r.row]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.text) == want[i, t or ""], (i, r)
        spans = [(x.begin, x.end) for x in r.removed]
        assert sum(e - b for b, e in spans) == r.n_removed and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize(("seed", "window"), [(1, 20), (2, 20), (3, 5), (4, 1), (5, 9)])
def test_against_all_windows(spark, monkeypatch, seed, window):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 600)
    rng = random.Random(seed)
    words = ["a", "b", "é", "the", "x1", "Ü z", "word"]
    passages = [" ".join(rng.choices(words, k=rng.choice([4, 19, 20, 21, 60]))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randrange(25))) for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(10**6) - 500_000, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [(10**7 + i, rows[i % 3][1]) for i in range(40)]  # a group of copies
    rows += [(None, passages[0] + " " + passages[1]), (None, "")]
    check(spark, rows, window)


def test_awkward_and_repeated_rows(spark):
    long = " ".join(str(k % 977) for k in range(30_000))
    rows = [(i, t) for i, t, _ in AWKWARD] + [(20, long), (21, long + " end"), (22, "w " * 5000)]
    rows += [(30, " ".join(f"v{k}" for k in range(40)))] * 50  # one document on many rows keeps its words
    check(spark, rows, 20)


def test_word_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 64)
    tail = " ".join(f"t{k}" for k in range(30))
    check(spark, [(1, "x" * 1000 + " " + tail), (2, tail + " " + "x" * 1000), (3, "y " + "x" * 999 + " " + tail)], 20)


def test_clashing_columns_and_empty_tables(awkward, nothing):
    out = substring_dedup.drop_repeated_passages(awkward.withColumnsRenamed({"n": "place", "keep": "n_removed", "score": "value"}))
    assert out.columns == ["doc_id", "source", "place", "toxic", "value", "text", "n_words", "n_removed", "kept_sha256", "removed"]
    assert out.count() == len(AWKWARD) and {r.place for r in out.collect()} == {7}
    assert substring_dedup.drop_repeated_passages(nothing).count() == 0
    with pytest.raises(ValueError, match="at least one word"):
        substring_dedup.drop_repeated_passages(awkward, 0)
