"""Search along curves against brute force."""

import itertools

import numpy as np
import pytest

from roadspark.llm import neighbours
from roadspark.llm.neighbours import best, hilbert, nearest


def brute(ids, x, k=20, every=20):
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [int(ids[j]) for j in order]
    return out


def test_hilbert_visits_neighbouring_cells():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
        assert (steps == 1).all()


@pytest.mark.parametrize("kind", ["isotropic", "clusters"])
def test_recall(spark, monkeypatch, kind):
    draw = np.random.default_rng(4)
    n, d = 3000, 24
    x = draw.standard_normal((n, d)) if kind == "isotropic" else 5 * draw.standard_normal((60, d))[draw.integers(0, 60, n)] + 0.3 * draw.standard_normal((n, d))
    x[:900] = x[0]  # one vector holds a third of the rows
    x *= draw.uniform(0.5, 2, n)[:, None] if kind == "clusters" else 1
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, id int, v int").repartition(4)
    monkeypatch.setattr(neighbours, "CELL", 200)
    got = nearest(df, block=100).toPandas()
    want = brute(np.arange(n), x)
    assert set(got.query_id) == set(want) and (got.groupby("query_id").size() == 20).all()
    hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9
    assert np.allclose([x[a] @ x[b] for a, b in zip(got.query_id, got.vec_id)], got.score, rtol=1e-12)
    for _, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21))
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.5, -0.5]), (8, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in nearest(df).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 7, 0.5), (0, 3, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 7, -0.5), (20, 3, 0, -1.0)]
    assert nearest(df.limit(0)).collect() == []
    assert nearest(df.where("vec_id in (1, 7)")).collect() == []


def test_best_breaks_ties_by_id():
    x = np.ones((50, 2))
    q, i, s = next(best(x[:1], np.array([99]), x, np.arange(50)[::-1], 3))
    assert i.tolist() == [0, 1, 2] and s.tolist() == [2.0] * 3


def test_repeated_rows_take_no_place(spark, monkeypatch):
    draw = np.random.default_rng(9)
    n = 1500
    x = draw.standard_normal((n, 8))
    for ids in (np.repeat(np.arange(n), 3), np.concatenate((np.arange(n), np.full(n, 7)))):
        q, i, s = next(best(x[:20], np.arange(20), x[ids], ids, 20))
        want = brute(np.arange(n), x, every=1)
        assert all(i[q == at].tolist() == want[at] for at in range(20))
    ids = np.repeat(np.arange(n), 3)
    df = spark.createDataFrame([(int(i), [float(c) for c in x[i]]) for i in ids], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(neighbours, "CELL", 600)
    got = nearest(df, block=200).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and not got.duplicated(["query_id", "vec_id"]).any()
    want = brute(np.arange(n), x)
    assert set(got.query_id) == set(want)
    hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9


def test_rows_of_one_id_count_by_the_best():
    x = np.concatenate((np.arange(100.0), np.arange(100.0) - 1000))[:, None]
    q, i, s = next(best(np.ones((1, 1)), np.array([-1]), x, np.tile(np.arange(100), 2), 5))
    assert i.tolist() == [99, 98, 97, 96, 95] and s.tolist() == [99.0, 98.0, 97.0, 96.0, 95.0]


def test_recall_with_production_parameters(spark):
    """The test table of 2,000 vectors: at least two curves are merged, and 0.9 of the true neighbours are found."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [r for r in df.collect() if r["embedding"] is not None and all(c is not None for c in r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    want = brute(ids[fine], x[fine])
    got = nearest(df).toPandas()
    assert set(got.query_id) == set(want)
    hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9
