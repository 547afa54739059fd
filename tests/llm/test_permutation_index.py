import numpy as np
import pytest
from pyspark.sql import functions as F

from taleloom.llm import permutation_index as index


def brute(rows, queries, k):
    out = {}
    for q in queries:
        own = min((v for i, v in rows if i == q))
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float((np.array(v, dtype=float) * np.array(own, dtype=float)).sum()))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def test_agreement_orders_by_footrule():
    rng = np.random.default_rng(0)
    pivots = index.choose_pivots(rng.normal(size=(50, 8)), 20)
    x = rng.normal(size=(40, 8))
    near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    rank = np.minimum(np.argsort(near, axis=1), 7)
    footrule = np.abs(rank[:5, None, :] - rank[None, :, :]).sum(axis=2)
    w = index.weights(x, pivots, 7, 7)
    assert (footrule == 7 * 8 - 2 * index.agreement(w[:5], w).astype(int)).all()


@pytest.mark.parametrize("n", [1, 2, 15, 300])
def test_small_tables_are_exact(spark, monkeypatch, n):
    monkeypatch.setattr(index, "BLOCK", 64)
    monkeypatch.setattr(index, "CHUNK", 5)
    monkeypatch.setattr(index, "FAN", 2)
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(n)]
    rows += rows[:3] + [(0, rows[0][1][::-1])]
    bad = [(None, [1.0] * 6), (1000, None), (1020, [0.0] * 6), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (1080, [1.0] * 5), (1100, [None] * 6), (1120, [])]
    table = spark.createDataFrame([(i, v, 1, "b") for i, v in rows + bad], "vec_id long, embedding array<float>, block int, chunk string")
    rows = [(i, np.array(v, dtype=np.float32).astype(float).tolist()) for i, v in rows]
    got = {}
    for r in index.search(table, F.col("vec_id") % 20 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    want = brute(rows, [i for i in range(0, n, 20)], 20)
    assert got == {q: w for q, w in want.items() if w}


def test_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32))
    x[:1500] = x[0] + 0.1 * rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in index.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -9
        assert len(got[q]) == 20
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * 300) >= 0.95


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in index.usable(table).collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in index.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for at in np.flatnonzero(ids % 20 == 0):
        s = (x * x[at]).sum(axis=1)
        s[ids == ids[at]] = -np.inf
        recall.append(len(got[ids[at]] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.95 and np.mean(np.sort(recall)[: max(1, len(recall) // 10)]) >= 0.9


def test_ids_of_any_size(spark):
    rows = [(i, [1.0, float(n)]) for n, i in enumerate([0, -(2**63), 2**63 - 1, -1, 9_221_120_237_041_090_560])]
    got = index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in sorted(i for i, _ in rows if i)]  # ties go by id


def test_many_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.permutation(4000)[:1400]] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    group = np.flatnonzero((x == x[0]).all(axis=1))
    asked = group[::50].tolist()
    got = {}
    for r in index.search(table, F.col("vec_id").isin(asked)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: group[group != q][:20].tolist() for q in asked}


def test_recall_of_unequal_norms(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 32))
    x *= rng.lognormal(0, 1, size=(6000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits, queries = 0, range(0, 6000, 60)
    got = {}
    for r in index.search(table, F.col("vec_id") % 60 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * len(queries)) >= 0.95


def test_no_vectors(spark):
    assert index.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_borders_cut_as_stable_sorts_do():
    rng = np.random.default_rng(11)
    for count in (1, 5, 17, 29, 30, 40):
        near = rng.integers(0, 6, size=(9, 30)).astype(np.float32)  # with many ties
        for row, taken in zip(near, index.shortlist(near, count), strict=True):
            assert np.flatnonzero(taken).tolist() == sorted(np.argsort(-row, kind="stable")[:count].tolist())
        vectors, pivots = rng.integers(-2, 3, size=(20, 3)).astype(float), rng.integers(-2, 3, size=(25, 3)).astype(float)
        order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
        posted = index.weights(vectors, pivots, count, 3).reshape(20, 3, 25)
        prefix = min(count, 25)
        for level in range(3):
            size = max(0, prefix - -(-prefix // 3) * level)
            for row, ranks in zip(posted[:, level], order, strict=True):
                assert np.flatnonzero(row).tolist() == sorted(ranks[:size].tolist())
