"""Comparisons in blocks against pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import distance, kernels
from weftline.operators import neighbors, pairs


def packed(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(np.asarray(x, float).tolist())], "id long, features array<double>")


def test_closest_pair_goes_by_blocks_and_makes_no_rows_of_pairs(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("pairs are joined row by row")

    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)) + 1e4
    x[650] = x[30] + 1e-3
    monkeypatch.setattr(neighbors, "radius_join", refuse)
    monkeypatch.setattr(neighbors, "SAMPLE", 20)
    monkeypatch.setattr(neighbors, "CLOSEST_VALUES", 16 * 100)
    monkeypatch.setattr(neighbors, "CLOSEST_ROWS", 32)
    for d in (distance.euclidian, distance.manhattan):
        r = neighbors.closest_pair(packed(spark, x), distance=d).first()
        assert (r.node, r.neighbour) == (30, 650)


@pytest.mark.parametrize("f", [distance.euclidian, distance.manhattan, distance.minkowski(3), distance.minkowski(5), distance.hamming, kernels.Linear(), kernels.RBF(0.5), kernels.Polynomial(3, 0.5, 1.0), kernels.Sigmoid(0.5, 0.1)])
def test_blocks_give_what_columns_give(spark, f, monkeypatch):
    monkeypatch.setattr(pairs, "ROWS", 16)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(50, 5)), 1)
    df = packed(spark, x)
    column = getattr(f, "column", f)
    odd = spark.createDataFrame([(91, [1.0, None, 0.0, 0.0, 0.0]), (None, [0.0] * 5), (92, [float("nan")] * 5)], df.schema)
    df, queries = df.union(odd), df.where("id % 7 = 0").union(odd)
    want = df.crossJoin(queries.toDF("q", "w")).select("q", "id", column(F.col("features"), F.col("w")).alias("value"))
    key = lambda r: [(x is None, x if x is not None else 0, str(x)) for x in r]
    got = [sorted(map(tuple, t.collect()), key=lambda r: key(r[:2])) for t in (neighbors.compared(df, queries, f), want)]
    assert [r[:2] for r in got[0]] == [r[:2] for r in got[1]]
    a, b = (np.array([np.nan if r[2] is None else r[2] for r in g]) for g in got)
    assert np.allclose(a, b, rtol=1e-12, atol=1e-14, equal_nan=True)
    assert [r[2] is None for r in got[0]] == [r[2] is None for r in got[1]]


def test_balls_are_met_in_blocks(spark, monkeypatch):
    from weftline.operators import metric

    def refuse(*_, **__):
        raise AssertionError("pairs are joined row by row")

    monkeypatch.setattr(metric.Balls, "candidates", refuse)
    monkeypatch.setattr(pairs, "ROWS", 20)
    rng = np.random.default_rng(7)
    x = np.repeat(np.round(rng.normal(size=(60, 2)), 2), 2, axis=0)
    df = packed(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = {(r.query_id, r.id) for r in neighbors.radius(df, df, 0.5, how="balls").collect()}
    assert near == {(q, i) for q, i in np.ndindex(d.shape) if d[q, i] <= 0.5}
    np.fill_diagonal(d, np.inf)
    got = {(r.query_id, r.rnk): r.id for r in neighbors.knn(df, df, 3, keep_self=False, how="balls").collect()}
    assert got == {(q, k + 1): i for q in range(len(x)) for k, i in enumerate(np.lexsort((np.arange(len(x)), d[q]))[:3])}


def test_full_cells_of_a_grid_are_cut(spark, monkeypatch):
    monkeypatch.setattr(pairs, "ROWS", 10)
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 2.5, size=(120, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    found = neighbors.radius_grid(packed(spark, x), 1.0)
    assert {(r.query_id, r.id) for r in found.collect()} == {(q, i) for q, i in np.ndindex(d.shape) if d[q, i] <= 1.0}
    assert "part" in found._jdf.queryExecution().optimizedPlan().toString()


def test_rbf_of_a_block_makes_no_cube():
    import tracemalloc

    a, b = np.ones((512, 64)), np.zeros((256, 64))
    tracemalloc.start()
    k = kernels.RBF(0.5).matrix(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(k, np.exp(-32.0)) and peak < 8 * k.nbytes
