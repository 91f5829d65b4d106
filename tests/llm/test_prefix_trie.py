"""The prefix trie against one built node by node."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest

from counterfold.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n string, a double"


def by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) - abs(c) % 100
        whole[c] = own.get(base if c >= 0 else -base, [])[:h] + own[c][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return collections.Counter(
        (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, cs in members.items())


def check(spark, rows):
    table = spark.createDataFrame([(*r, "mine", "x", 0.5) for r in rows], SCHEMA).repartition(5)
    out = trie.prefix_trie(table)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert collections.Counter(tuple(r) for r in out.collect()) == by_hand(rows)


@pytest.mark.parametrize(("seed", "piece"), [(1, 16), (2, 2), (3, 1)])
def test_against_a_trie_built_by_hand(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "_IDS", 3)
    rng = random.Random(seed)
    turns = [("user", "hi"), ("assistant", "hi"), ("user", "é\U0001f600"), (None, "x" * 50), ("user", None), ("", "")]
    rows = []
    for c in [*range(100, 150), *range(300, 310), 501, 502, -7, -120, -100]:  # 300's hundred is there, 500 isn't
        path = [rng.choice(turns[: 2 + d % 4]) for d in range(rng.choice([0, 1, 2, 3, 7, 20]))] or [turns[0]]
        rows += [(c, d if d else rng.choice([0, None]), *t) for d, t in enumerate(path)]
    long = [rng.choice(turns) for _ in range(75)]  # two that part late, beside short ones
    rows += [(c, d, *(("user", "other") if d == cut else t)) for c, cut in ((200, -1), (210, 70), (211, 70)) for d, t in enumerate(long)]
    check(spark, rows)


def test_common_conversation_and_copies(spark):
    rows = [(1000 + i, d, "user", f"t{d}") for i in range(60) for d in range(7)] + [(1200 + i, 0, "user", "one") for i in range(40)]
    check(spark, rows)


def test_nulls_ties_and_empty_tables(spark):
    check(spark, [(None, 1, "user", "nobody's"), (5, None, None, None), (5, 2, "user", "b"), (7, 1, "user", "same"), (7, 1, "user", "same")])
    check(spark, [(None, 1, "user", "nobody's")])
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_ties_of_turns_do_not_depend_on_the_layout(spark):
    rows = [(400 + i % 3, 1, "user", f"t{i // 3}") for i in range(30)]
    runs = [sorted(map(str, trie.prefix_trie(spark.createDataFrame(r, "conv_id long, turn long, role string, text string").repartition(k)).collect()))
            for r, k in ((rows, 1), (rows[::-1], 4))]
    assert runs[0] == runs[1]
