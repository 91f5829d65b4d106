"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from counterfold.llm import lexical_search as search
from tests.llm.conftest import AWKWARD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted & set(c))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, k=10):
    frame = spark.createDataFrame([(*d, 3, "x") for d in docs], "doc_id long, text string, n long, score string").repartition(5)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    assert sorted((tuple(r) for r in search.search_documents(frame, asked, k).collect()), key=str) == by_hand(docs, items, k)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_scores(spark, monkeypatch, seed):
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 300)
    monkeypatch.setattr(search, "FIRST_READ", 2)
    if seed == 2:
        monkeypatch.setattr(search, "BLOCK_TERMS", 15)  # several goes
    rng = random.Random(seed)
    words = [*"abcdefghij", "É", "éa", "x-y", "Zz", "İ", "don't"]
    weights = [2.0 ** -(i % 9) for i in range(len(words))]
    docs = [(rng.randrange(-50, 400), " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 2, 5, 30, 200])))) for _ in range(400)]
    docs += [(1000 + i, "a b c c") for i in range(60)] + [(None, "a b c c"), (None, "zz")]  # many equal scores
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 6, 12])))) for i in range(25)]
    check(spark, docs, [*items, (3, "zz zz ZZ"), (None, "c É"), (77, None), (78, "--"), (79, "unknown")])
    check(spark, docs, items, 3)


def test_awkward_documents(spark):
    docs = [(i, t) for i, t, _ in AWKWARD]
    check(spark, docs, [(1, "one two seven"), (2, "LONG words"), (3, "über straße"), (4, docs[4][1]), (5, "")])
    check(spark, docs, [(1, "nowhere")])
    check(spark, [(1, None), (2, "  ")], [(1, "a")])
    check(spark, [], [(1, "a")])
    check(spark, docs, [])


def test_reading_stops_early_and_never_before_ties_are_seen():
    n = 20_000
    rare, common = np.arange(50) * 7, np.arange(n)
    lists = [search._ImpactList(rare, np.full(50, 1000)), search._ImpactList(common, np.where(common < 5, 900, 10))]
    best = search._Best(10)
    looked_up = search.best_positions(lists, best, np.zeros(n, bool), common)
    assert looked_up < n / 50 and best.doc.tolist() == [0, *(7 * i for i in range(1, 10))]
    best = search._Best(10)
    search.best_positions([search._ImpactList(common, np.full(n, 10))], best, np.zeros(n, bool), common[::-1].copy())
    assert best.doc.tolist() == list(range(10))
