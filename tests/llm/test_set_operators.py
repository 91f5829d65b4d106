"""Mixing, toxicity, near duplicates, vector searches and the pipeline on small fixtures."""

from __future__ import annotations

import collections
import dataclasses as dc
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from counterfold.llm import ann, common, components, exact_topk, mixing, ngram_join, toxicity
from tests.llm.conftest import AWKWARD

# ------------------------------------------------------------------ mixing


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_ = [s for s in names if s not in capped]
        now = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if now[s] > most * sizes[s]]
        if not over:
            return {**capped, **now}
        capped |= {s: most * sizes[s] for s in over}


def mixed(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return mixing.mix_units(docs, **kw)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken_words(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "B", "é", "zz", None, "src10", "src9"][: 3 + seed]
    share = [0.4] + [0.6 / (len(sources) - 1)] * (len(sources) - 1)  # a hot source
    rows = [(i, rng.choices(sources, share)[0], " ".join(["w"] * rng.choice([0, 1, 3, 10, 40, 300]))) for i in range(900)]
    out = mixed(spark, rows).collect()
    size = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in {r[1] for r in rows}}
    want = targets_by_hand(size)
    taken = collections.Counter()
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert len(out) == len(rows)
    for s in size:  # but for one unit of the source
        assert abs(taken[s] - want[s]) <= 300
    again = mixing.mix_units(spark.createDataFrame(rows[::-1], "doc_id long, source string, text string").repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.copies)
    assert sorted(map(key, again)) == sorted(map(key, out))
    other = mixed(spark, rows, seed=9).collect()
    assert sorted(map(key, other)) != sorted(map(key, out))


def test_rounding_is_unbiased(spark):
    """Over many seeds, units are taken with their own probability."""
    p = [0.1, 0.35, 0.5, 0.8, 0.6, 0.25, 0.9, 0.5]
    sizes = [5.0, 1.0, 8.0, 2.0, 3.0, 3.0, 1.0, 7.0]
    units = spark.createDataFrame(
        [(g, (g, i), sizes[i], p[i]) for g in range(400) for i in range(8)], "group long, key struct<g:long,i:long>, size double, p double")
    taken = mixing.round_copies(units, bucket=4).toPandas()
    assert len(taken) == 3200
    share = taken.groupby(taken["key"].map(lambda k: k["i"]))["take"].mean()
    # the last unit of a group goes to the nearer number, so the shares are close, not exact
    assert np.abs(share.to_numpy() - np.array(p)).max() < 0.15
    per_group = taken.assign(w=taken["key"].map(lambda k: sizes[k["i"]]) * taken["take"]).groupby(taken["key"].map(lambda k: k["g"]))["w"].sum()
    assert (per_group - np.dot(p, sizes)).abs().max() <= 8 / 2 + 1e-6


def test_mixing_awkward_rows(awkward, nothing):
    out = mixing.mix_units(awkward).collect()
    assert len(out) == len(AWKWARD) and sum(r.doc_id == 6 for r in out) == 2
    assert {r.size for r in out if r.doc_id in (2, 3, 4)} == {0}
    docs = mixing.mix_documents(awkward)
    assert docs.columns == awkward.columns
    assert docs.count() == sum(r.copies for r in out)
    assert mixing.mix_units(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0


# ------------------------------------------------------------------ toxicity


def test_toxicity_learns_and_holds_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    words = ["foul", "wretch", "vermin"]
    marked = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left").withColumn(
        "text", F.when(F.col("toxic") == 1, F.concat("text", F.lit(" you " + " ".join(words * 3)))).otherwise(F.col("text"))).drop("toxic")
    model = toxicity.fit_toxicity(marked, labels)
    out = toxicity.score_toxicity(marked, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert out["score"].between(0, 1).all()
    assert (out["predicted"] == (out["score"] >= 0.7)).all()
    assert out[out.toxic == 1]["predicted"].mean() > 0.9 and out[out.toxic == 0]["predicted"].mean() < 0.05
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.fit_toxicity(marked, flipped)  # labels of held-out rows change nothing
    assert np.array_equal(same.weight, model.weight) and same.intercept == model.intercept


def test_held_out_rows_are_those_of_the_checksum(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), -7, None]], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_toxicity_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (10, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(awkward.drop("toxic"), labels)
    out = toxicity.score_toxicity(awkward, model)
    assert out.count() == len(AWKWARD) and out.where("score is null or score < 0 or score > 1").count() == 0
    one_class = toxicity.fit_toxicity(awkward.drop("toxic"), labels.where("toxic = 0"))
    assert toxicity.score_toxicity(awkward, one_class).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.score_toxicity(nothing, toxicity.fit_toxicity(nothing.drop("toxic"), labels.limit(0))).count() == 0


# ------------------------------------------------------------------ near duplicates


def groups_by_hand(docs):
    sets = []
    for _, t in docs:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[k:k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            b, both = docs[j][0], len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(s), find(i)) for (i, _), s in zip(docs, sets, strict=True))


def copies(rng, n, long=False):
    """Families of copies with a few words changed, some on the edge of a link, and shared passages."""
    passage = " ".join(f"p{k}" for k in range(25))
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 6, 20, 60, 90]))]
        for _ in range(rng.choice([1, 1, 2, 3, 40] if long else [1, 2, 5])):
            ws = list(base)
            for _ in range(rng.randrange(0, max(1, len(ws) // 14) + 1)):
                ws[rng.randrange(len(ws))] = f"v{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                ws.append(passage)
            out.append((rng.randrange(10**9), " ".join(ws).title() if rng.random() < 0.2 else "\n ".join(ws)))
    return list({i: (i, t) for i, t in out}.values())[:n]


@pytest.mark.parametrize("short, block, parts", [(24, 1024, "4"), (2, 8, "3"), (1, 4, "7")])
def test_near_duplicates_against_brute_force(spark, short, block, parts):
    """Also with lists so short and blocks so small that all of the long-list steps run."""
    docs = copies(random.Random(short), 420, long=True)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ngram_join.near_duplicates(
            spark.createDataFrame(docs, "doc_id long, text string").repartition(3), short_list=short, block=block).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups_by_hand(docs)


def test_two_components_that_meet_are_first_asked_by_one_pair():
    """The pairs of a group that leaders left open must not be compared all, as their number grows with its square."""
    n = 200
    sketches = np.zeros((2 * n, ngram_join.SKETCH_BITS // 8), np.uint8)
    sketches[:, 0] = 255
    sketches[:n, 1] = 1
    sketches[n:, 2] = 1
    sketches[n + 9, 2] = 0
    sketches[7] = sketches[n + 9]  # the closest pair of the two components
    columns = {
        "block": [0], "places": [np.full(2 * n, 100 << 32, np.int64).tobytes()], "ids": [np.arange(2 * n).tobytes()],
        "labels": [np.repeat([0, n], n).tobytes()], "leaders": [np.full(2 * n, -1).tobytes()], "far": [np.full(2 * n, -1).tobytes()],
        "sketches": [sketches.tobytes()]}
    batch = pa.RecordBatch.from_pydict(columns | {f"{c}2": v for c, v in columns.items()})
    first, = ngram_join._across(True)(iter([batch]))
    assert first.to_pylist() == [{"block": 0, "block2": 0, "label": 0, "label2": n, "a": 7, "b": n + 9}]
    for left, rows in (([], 0), ([{"label": 0, "label2": n}], n * n)):  # all pairs of what is still apart
        still = batch.append_column("open", pa.array([left], pa.list_(pa.struct([("label", pa.int64()), ("label2", pa.int64())]))))
        assert sum(b.num_rows for b in ngram_join._across(False)(iter([still]))) == rows


def test_the_filter_of_few_ids_is_small_and_refuses_none_of_them(spark):
    """The driver takes it from four tasks: 8 MB for any number of ids was too much for a small one."""
    ids = spark.range(0, 3_000_000, 1_000).select((F.col("id") * 7_919).alias("id"))
    bits = ngram_join._possible(ids)
    assert len(bits.value) <= 1 << 14
    rows = spark.range(0, 3_000_000, 500).select((F.col("id") * 7_919).alias("doc_id"))
    left = {r.doc_id for r in rows.mapInArrow(ngram_join._only(bits), "doc_id long").collect()}
    assert {r.id for r in ids.collect()} <= left and len(left) < 3_600


def test_batches_on_their_way_to_python_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    before = spark.conf.get(common._BATCH)
    with common.small_batches(spark):
        rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
        got = [r.bytes for r in rows.mapInArrow(sizes, "bytes long").collect()]
    assert sum(got) >= 400 * 50_000 and max(got) < 1.1 * common.BATCH_BYTES
    assert spark.conf.get(common._BATCH) == before


@pytest.mark.parametrize("n, values", [(0, 1), (1, 1), (2, 1), (3, 1), (9, 2), (5_000, 1_700), (5_000, 9_000)])
def test_repeated_values_are_counted_as_by_unique(n, values):
    grams = np.random.default_rng(n).integers(0, values, n).astype(np.uint64)
    want, times = np.unique(grams, return_counts=True)
    got, counted = ngram_join._repeated(grams, 3)
    assert got.tolist() == want[times >= 3].tolist() and counted.tolist() == times[times >= 3].tolist()


def test_the_driver_takes_fits_in_few_values(spark, monkeypatch, sf_dir):
    """Thousands of small values, or pandas, cost the driver memory that it doesn't give back."""
    frame, rows = type(spark.range(1)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: rows.append(got := collect(self)) or got)
    monkeypatch.setattr(frame, "toPandas", lambda self: pytest.fail("pandas in the driver"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    some = [(i, " ".join(f"w{k}" for k in range(i % 3, 7))) for i in range(40)]
    grams = ngram_join.frequent_grams(spark.createDataFrame(some, "doc_id long, text string").coalesce(1), 5)
    assert max(map(len, rows)) <= 8 and len(model.weight)
    shingle, often = ngram_join.Shingler(5), collections.Counter()
    for _, t in some:
        often.update(shingle(t).tolist())
    signed = {g: g - (1 << 64 if g >> 63 else 0) for g in often}
    assert grams.tolist() == sorted(often, key=lambda g: (often[g], -signed[g]))


def test_a_task_needs_one_python_worker(spark, monkeypatch):
    """Of two Python steps in one stage each has its own worker, and an executor keeps them all."""
    plans = []
    written = ngram_join.durable
    monkeypatch.setattr(ngram_join, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    docs = spark.createDataFrame(copies(random.Random(3), 60), "doc_id long, text string")
    assert ngram_join.near_duplicates(docs).count() == 60
    assert any("MapInArrow" in p for p in plans)
    for plan in plans:
        steps = [x for x in plan.splitlines() if any(k in x for k in ("MapInArrow", "Exchange", "Join", "Union", "Scan"))]
        assert not any("MapInArrow" in a and "MapInArrow" in b for a, b in zip(steps, steps[1:], strict=False)), plan


def test_the_prefix_of_a_set_meets_every_link():
    for n in range(1, 200):
        for m in range(n, 200):
            need = -(-3 * (n + m) // 7)  # least overlap of a link
            if need > n:
                continue
            assert need > n - ngram_join.prefix_length(n) and need > m - ngram_join.prefix_length(m)
            one = np.array([n]), np.array([0]), np.array([m]), np.array([0])
            assert ngram_join.may_link(*one).all()


def test_near_duplicates_awkward_rows(awkward, nothing):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(awkward).collect())
    assert len(got) == len(AWKWARD)
    by_id = {i: (n, c) for i, n, c in got}
    assert by_id["1"] == (3, 1) and by_id["6"] == (3, 1) and by_id["2"] == (0, 2) == by_id["2"] and by_id["4"] == (0, 4)
    assert by_id["None"][1] is None and by_id["11"] == (1, 11) and by_id["5"] == (3, 5)
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(20, 60)] + [(3, 3), (900, 1), (900, 2), (2, 900)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[x] == 7 for x in range(20, 60))
    assert got[3] == 3 and got[900] == got[2] == 1


def test_few_links_take_few_tasks_in_every_round(spark, monkeypatch):
    """The driver remembers every task, so rounds over few links must not each have all shuffle partitions."""
    parts = []
    written = components.durable
    monkeypatch.setattr(components, "durable", lambda df: parts.append((out := written(df)).rdd.getNumPartitions()) or out)
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(5, 5)], "a long, b long")
        got = {r["id"]: r["component"] for r in components.connected_components(links).collect()}
        assert components.connected_components(links.limit(0)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 100 for i in range(100, 141)} | {5: 5}
    assert sorted(parts)[-3] <= spark.sparkContext.defaultParallelism < 60  # all but the links themselves


# ------------------------------------------------------------------ vectors


def vector_rows(rng, n, dims, hot=0.3):
    rows = []
    common = rng.normal(size=dims)
    for i in range(n):
        v = common if rng.random() < hot else rng.normal(size=dims) * rng.choice([0.2, 1, 3])
        rows.append((i, [float(x) for x in v]))
    return rows


BAD = [(40_000, None), (40_020, [1.0, None]), (40_040, [float("nan"), 1.0]), (40_060, [float("inf"), 0.0]), (None, [1.0, 2.0]), (40_080, [])]


def best_by_hand(vectors, k, score):
    out = {}
    for q, x in vectors.items():
        if q % 20 == 0:
            ranked = sorted((-score(x, y), v) for v, y in vectors.items() if v != q)[:k]
            out[q] = [(i + 1, v, -s) for i, (s, v) in enumerate(ranked)]
    return out


def answers(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("n, k", [(300, 20), (15, 20), (700, 5)])
def test_exact_top_k_against_brute_force(spark, monkeypatch, n, k):
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(n)
    rows = [(i, [int(x * 64) for x in v]) for i, v in vector_rows(rng, n, 12)]
    bad = [(i, None if v is None else [None if x is None or x != x or x in (float("inf"),) else int(x) for x in v]) for i, v in BAD]
    frame = spark.createDataFrame(rows + rows[:3] + bad, "vec_id long, vector array<long>")
    want = best_by_hand({i: np.array(v) for i, v in rows}, k, lambda x, y: int(x @ y))
    assert answers(exact_topk.exact_top_k(frame, F.col("vec_id") % 20 == 0, k)) == want
    assert exact_topk.exact_top_k(frame.limit(0), F.col("vec_id") % 20 == 0, k).count() == 0


def test_first_group_is_searched_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 2)
    calls, meet = [], exact_topk.meet

    def noted(candidates, queries, groups, kernel):
        calls.append((groups, {r.group for r in candidates.select("group").collect()}, {r.group for r in queries.select("group").collect()}))
        return meet(candidates, queries, groups, kernel)

    monkeypatch.setattr(exact_topk, "meet", noted)
    rng = np.random.default_rng(9)
    rows = [(i, [int(x * 64) for x in v]) for i, v in vector_rows(rng, 700, 12)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = answers(exact_topk.exact_top_k(frame, F.col("vec_id") % 20 == 0, 5))
    assert got == best_by_hand({i: np.array(v) for i, v in rows}, 5, lambda x, y: int(x @ y))
    groups, held, asking = calls[0]
    assert groups == 4 and held == {0, 1, 2, 3} and len(asking) > 1


def test_neighbours_found_and_scored(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, vector array<double>")
    got = answers(ann.approximate_top_k(frame, F.col("vec_id") % 20 == 0, 20))
    want = best_by_hand(vectors, 20, lambda x, y: float((x * y).sum()))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, found in got.items():
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(s == pytest.approx(float(vectors[q] @ vectors[v]), abs=1e-12) for _, v, s in found)


@pytest.mark.parametrize("n", [500, 2000])
@pytest.mark.parametrize("shape", ["uneven", "shifted"])
def test_neighbours_of_uneven_lengths_and_shifted_means(spark, shape, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x = x + 1.5 if shape == "shifted" else x / np.linalg.norm(x, axis=1, keepdims=True) * rng.lognormal(size=(n, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    got = answers(ann.approximate_top_k(frame, F.col("vec_id") % 20 == 0, 20))
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    want = {i: set(np.argsort(-score[i])[:20].tolist()) for i in range(0, n, 20)}
    assert got.keys() == want.keys()
    recall = np.mean([len({v for _, v, _ in got[q]} & want[q]) / 20 for q in want])
    print(f"recall {shape} {n}: {recall:.3f}")
    assert recall >= 0.9


def test_all_candidates_of_few_vectors(spark):
    rng = np.random.default_rng(3)
    for n in (2, 3, 8, 15, 20, 21):
        rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
        frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").coalesce(1)
        got = answers(ann.approximate_top_k(frame, F.lit(True), 20))
        assert {q: {v for _, v, _ in found} for q, found in got.items()} == {q: set(range(n)) - {q} for q in range(n)}, n


@pytest.mark.parametrize("n", [6, 400])
def test_neighbours_of_awkward_vectors(spark, n):
    rng = np.random.default_rng(n)
    rows = vector_rows(rng, n, 8, hot=0.4)
    frame = spark.createDataFrame([*rows, *rows[:2], *BAD, (40_100, [0.0, 0.0])], "vec_id long, vector array<double>")
    p = dc.replace(ann.ForestParams(), trees=4, group_rows=64, search_share=4.0)  # all leaves: exact
    want = best_by_hand({i: np.array(v) for i, v in rows}, 20, lambda x, y: float((x * y).sum()))
    got = answers(ann.approximate_top_k(frame, F.col("vec_id") % 20 == 0, 20, p))
    assert {q: [v for _, v, _ in x] for q, x in got.items()} == {q: [v for _, v, _ in x] for q, x in want.items()}
    assert ann.approximate_top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_stage_by_stage(spark, tmp_path, sf_dir):
    """Each stage against a plain version of what it promises, on its own input."""
    import corpus_pipeline
    from tests.llm.test_text_operators import kept_by_hand

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        before, after = docs.toPandas(), spark.read.parquet(str(tmp_path / str(k)))
        out = after.toPandas()
        if name != "packing":
            assert tuple(after.columns) == corpus_pipeline.COLUMNS
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
            clean = set(labels[labels.toxic == 0].doc_id) & set(before.doc_id)
            assert len(clean & set(out.doc_id)) >= 0.95 * len(clean) and set(out.doc_id) <= set(before.doc_id)
        elif name == "line_dedup":
            want = {i: t for i, t, *_ in kept_by_hand(list(zip(before.doc_id, before.text, strict=True)), 10)}
            assert dict(zip(out.doc_id, out.text, strict=True)) == want and (out.n_chars == out.text.str.len()).all()
        elif name == "ngram_join":
            groups = groups_by_hand(list(zip(before.doc_id, before.text, strict=True)))
            assert set(out.doc_id) == {i for i, _, c in groups if i == c}
        elif name == "mixing":
            size = before.assign(n=before.text.str.findall("[^\x20\x09-\x0d]+").str.len()).groupby("source")["n"].sum().to_dict()
            want, taken = targets_by_hand(size), collections.Counter()
            for s, t in zip(out.source, out.text, strict=True):
                taken[s] += len(t.split())
            longest = before.text.str.split().str.len().max()
            assert all(abs(taken[s] - want[s]) <= longest for s in size)
            assert out.doc_id.value_counts().max() <= 2
        else:
            total = out.drop_duplicates(["doc_id", "doc_tokens"]).set_index("doc_id")["doc_tokens"]
            times = before.doc_id.value_counts()
            assert out.groupby("doc_id")["length"].sum().to_dict() == (total * times).to_dict()
        docs = after


def test_a_document_on_many_rows_is_learned_from_once(spark):
    """Ten thousand copies of one labelled row, and labels that contradict each other, leave one training row an id."""
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"text {i}") for i in ids] + [(ids[0], f"text {ids[0]}")] * 10_000 + [(ids[1], "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[2], 1 - ids[2] % 2)] * 2 + [(ids[3], None)], "doc_id long, toxic int")
    sample = toxicity._sample(docs, labels, toxicity.ToxicityParams()).collect()
    assert sorted(r.doc_id for r in sample) == ids
    assert {r.doc_id: r.toxic for r in sample}[ids[2]] == 1 - ids[2] % 2
    few = toxicity._sample(docs, labels, dc.replace(toxicity.ToxicityParams(), train_rows=2)).collect()
    assert len(few) <= 4
