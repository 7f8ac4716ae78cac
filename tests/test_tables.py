"""Metric balls, histogram trees, tiles, bounded k-means, kept models and the flat format against plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.errors import DecompositionFailed, FindFailed, FitFailed, ParametersError, ReadingError, SolutionFailed
from weftline.functions import distance, kernels
from weftline.operators import bounded_kmeans, cluster, histograms, metric, neighbors, svm, svm_dual, tiles, tree
from weftline.sources import datasets, models
from weftline.streaming import kept


def clustered(spark, n=1200, dims=5, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-20, 20, (30, dims))
    v = centres[rng.integers(0, 30, n)] + rng.normal(0, 0.3, (n, dims))
    v[5] = v[6] = v[7]
    return v, spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, features array<double>")


# -- metric balls ------------------------------------------------------------------


PLAIN = {
    "euclidian": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)),
    "manhattan": lambda a, b: np.abs(a - b).sum(-1),
    "minkowski": lambda a, b: (np.abs(a - b) ** 3).sum(-1) ** (1 / 3),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_joins_by_balls_find_what_all_pairs_find(spark, name):
    v, df = clustered(spark)
    d = distance.minkowski(3) if name == "minkowski" else distance.DISTANCES[name]
    every = PLAIN[name](v[:, None], v[None])
    queries = df.where("id % 7 = 0")
    got = {}
    for r in neighbors.knn(df, queries, 5, distance=d, how="balls").collect():
        got.setdefault(r.query_id, []).append((r.rnk, r.id))
    for q, found in got.items():
        assert [i for _, i in sorted(found)] == np.lexsort((np.arange(len(v)), every[q]))[:5].tolist()
    assert len(got) == len(v[::7])
    near = {(r.query_id, r.id) for r in neighbors.radius(df, queries, 1.1, distance=d, how="balls").collect()}
    assert near == {(q, i) for q in range(0, len(v), 7) for i in np.flatnonzero(every[q] <= 1.1)}


def test_balls_leave_most_pairs_out(spark):
    v, df = clustered(spark, 2000)
    b = metric.balls(df)
    placed = b.placed(df, "id", "features")
    assert b.candidates(placed, F.lit(0.8)).count() < 0.1 * len(v) ** 2
    assert b.nearest_balls(placed, 4).count() < 0.2 * len(v) ** 2
    n = neighbors.knn(df, df, 3, keep_self=False, how="balls")
    assert n.count() == 3 * len(v) and n.where("id = query_id").count() == 0


def test_balls_of_odd_tables(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 0.0]), (None, [1.0, 1.0]), (5, [3.0, 4.0]), (6, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>").withColumn("ball", F.lit("own"))
    found = sorted((r.query_id, r.id) for r in neighbors.radius(df, df, 5.0, how="balls").collect())
    assert found == sorted([(q, i) for q in (1, 1, 2) for i in (1, 1, 2, 5)] + [(5, i) for i in (1, 1, 2, 5)] + [(6, 6)])
    assert neighbors.radius(df.limit(0), df, 5.0, how="balls").count() == 0 and neighbors.radius(df, df.limit(0), 5.0, how="balls").count() == 0
    with pytest.raises(FindFailed):
        neighbors.knn(df.limit(0), df, 2, how="balls")
    with pytest.raises(ParametersError):
        neighbors.knn(df, df, 2, distance=distance.squared_euclidian, how="balls")
    pair = neighbors.closest_pair(df.where("id is not null")).first()
    assert (pair.node, pair.neighbour, pair.distance) == (1, 2, 0.0)


def test_clusters_of_any_metric(spark):
    v, df = clustered(spark, 400)
    by = {n: {r.id: r.cluster for r in cluster.dbscan(df, 1.2, 4, distance=d, how=n).labels.collect()} for n, d in (("balls", distance.manhattan), ("pairs", lambda a, b: distance.manhattan(a, b)))}
    by["auto"] = {r.id: r.cluster for r in cluster.dbscan(df, 1.2, 4, distance=distance.manhattan).labels.collect()}
    assert by["balls"] == by["pairs"] == by["auto"] and max(by["balls"].values()) > 5


# -- histogram trees ---------------------------------------------------------------


def labelled(spark, n=900, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = np.where(x[:, 0] > 0.3, 2, np.where(x[:, 1] + 0.2 * rng.normal(size=n) > 0, 1, 0))
    rows = [(i, *map(float, v), int(c), float(v[0] * 2 + v[2])) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, t double").repartition(3)


def plain_tree(x, y, cuts, depth, score, value):
    """A tree over binned values by trying all cuts."""
    if depth == 0 or len(set(y.tolist())) == 1 or len(y) <= 2:
        return value(y)
    best = None
    for j in range(x.shape[1]):
        for c in cuts[j]:
            left = x[:, j] <= c
            if 0 < left.sum() < len(y):
                g = score(y[left], y[~left], y)
                if best is None or g > best[0] + 1e-12:
                    best = (g, j, c)
    if best is None or best[0] <= 1e-12:
        return value(y)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], plain_tree(x[left], y[left], cuts, depth - 1, score, value), plain_tree(x[~left], y[~left], cuts, depth - 1, score, value))


def follow(node, v):
    while isinstance(node, tuple):
        node = node[2] if v[node[0]] <= node[1] else node[3]
    return node


def test_histogram_trees_are_plain_trees(spark):
    x, y, df = labelled(spark)
    cuts, names = [np.linspace(-1.5, 1.5, 13).tolist()] * 4, ["a", "b", "c", "d"]
    gini = lambda v: 1 - sum((np.mean(v == c)) ** 2 for c in range(3))
    want = plain_tree(x, y, cuts, 4, lambda l, r, t: gini(t) - len(l) / len(t) * gini(l) - len(r) / len(t) * gini(r), lambda v: int(np.bincount(v).argmax()))
    got = tree.decision_tree_classifier(df, names, "y", max_depth=4, cuts=cuts)
    assert {r.id: r.prediction for r in got.predict(df).collect()} == {i: follow(want, v) for i, v in enumerate(x)}
    t = x[:, 0] * 2 + x[:, 2]
    square = lambda v: v.sum() ** 2 / len(v)
    want = plain_tree(x, t, cuts, 3, lambda l, r, a: square(l) + square(r) - square(a), lambda v: v.mean())
    got = tree.decision_tree_regressor(df, names, "t", max_depth=3, cuts=cuts)
    assert all(abs(r.prediction - follow(want, x[r.id])) < 1e-9 for r in got.predict(df).collect())


def test_forests_draw_exact_samples(spark, monkeypatch):
    x, y, df = labelled(spark)
    monkeypatch.setattr(histograms, "BLOCK_ROWS", 64)
    monkeypatch.setattr(histograms, "HELD_VALUES", 2000)
    f = tree.random_forest_classifier(df, ["a", "b", "c", "d"], "y", "id", n_trees=12, max_depth=5, seed=3)
    bags = np.zeros((len(y), 12), int)
    for r in f.bags.collect():
        bags[r.id] = r.w
    for c in range(3):
        assert (bags[y == c].sum(0) == (y == c).sum()).all()
    # Poisson-like spread: about 37 % of the rows are left out of a tree, and trees differ.
    assert 0.3 < (bags == 0).mean() < 0.44 and len({tuple(b) for b in bags.T}) == 12
    oob = f.predict_oob(df, "id").where("prediction is not null").collect()
    assert len(oob) > 0.95 * len(y) and np.mean([r.prediction == r.y for r in oob]) > 0.85
    assert np.mean([r.prediction == r.y for r in f.predict(df).collect()]) > 0.9
    # A large forest goes to the tasks as arrays, with the same results.
    one = {r.id: r.prediction for r in f.predict(df).collect()}
    monkeypatch.setattr(tree, "PLAN_NODES", 1)
    assert {r.id: r.prediction for r in f.predict(df).collect()} == one
    g = tree.random_forest_regressor(df, ["a", "b", "c", "d"], "t", "id", n_trees=6, max_depth=6)
    assert g.bags.agg(F.sum(F.aggregate("w", F.lit(0), lambda a, v: a + v))).first()[0] == 6 * len(y)
    assert np.mean([(r.prediction - r.t) ** 2 for r in g.predict(df).collect()]) < 1.0


def test_draws_fall_to_parts_by_the_law():
    counts = np.array([5, 0, 20, 75])
    parts = np.array([[histograms.fall_to(counts, i, 100, s) for i in range(4)] for s in range(400)])
    assert (parts.sum(1) == 100).all() and (parts[:, 1] == 0).all()
    assert np.allclose(parts.mean(0), counts, atol=0.8) and abs(parts[:, 2].var() - 16) < 4


def test_trees_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 1.0, 0), (2, 2.0, float("nan"), 1), (3, 1.0, 5.0, None), (4, 2.0, 1.0, 1)], "id long, a double, b double, y int")
    got = tree.decision_tree_classifier(df.where("y is not null"), ["a", "b"], "y", cuts=[[1.0], [2.0]], min_samples_split=1)
    assert [r.prediction for r in got.predict(df).orderBy("id").collect()][1] == 1
    with pytest.raises(FitFailed):
        tree.decision_tree_regressor(df.limit(0), ["a"], "b", cuts=[[1.0]])
    with pytest.raises(FitFailed):
        tree.decision_tree_regressor(df, ["a", "b"], "y", cuts=[[1.0]])


# -- tiles ---------------------------------------------------------------------------


def as_cells(spark, a):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "i long, j long, value double")


def whole(cells, shape):
    out = np.zeros(shape)
    for r in cells.collect():
        out[r.i, r.j] = r.value
    return out


@pytest.fixture
def narrow(monkeypatch):
    for n, v in (("GROUP", 2), ("INNER", 2), ("FAN_IN", 2), ("STRIP_VALUES", 100), ("PIVOT_VALUES", 150)):
        monkeypatch.setattr(tiles, n, v)


def test_products_of_tiles(spark, narrow):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(23, 31)), rng.normal(size=(31, 9))
    x, y = (tiles.from_cells(as_cells(spark, m), *m.shape, side=4) for m in (a, b))
    assert np.allclose(whole(x.multiply(y).cells(), (23, 9)), a @ b)
    assert np.allclose(whole(x.transpose().multiply(x).cells(), (31, 31)), a.T @ a)
    rows = tiles.from_rows(spark.createDataFrame([(i, v) for i, v in enumerate(a.tolist())], "i long, v array<double>"), "i", "v", 23, 31, side=4)
    assert np.array_equal(whole(rows.cells(), a.shape), a)
    with pytest.raises(SolutionFailed):
        x.multiply(x)


def test_factors_and_systems(spark, narrow):
    rng = np.random.default_rng(6)
    n = 21
    a = rng.normal(size=(n, n))
    a[0, 0] = 0
    spd = a @ a.T + np.eye(n)
    t = tiles.from_cells(as_cells(spark, spd), n, n, side=4)
    assert np.allclose(whole(tiles.cholesky(t), (n, n)), np.linalg.cholesky(spd))
    g = tiles.from_cells(as_cells(spark, a), n, n, side=4)
    f = tiles.lu(g)
    assert sorted(f.order.tolist()) == list(range(n))
    assert np.allclose(whole(f.lower(), (n, n)) @ whole(f.upper(), (n, n)), a[f.order])
    b = rng.normal(size=(n, 3))
    assert np.allclose(whole(tiles.solve(g, as_cells(spark, b), 3), (n, 3)), np.linalg.solve(a, b))
    assert np.allclose(whole(tiles.inverse(g), (n, n)), np.linalg.inv(a))
    a[3] = a[4]
    for call in (tiles.lu, tiles.inverse):
        with pytest.raises(SolutionFailed):
            call(tiles.from_cells(as_cells(spark, a), n, n, side=4))
    with pytest.raises(DecompositionFailed):
        tiles.cholesky(tiles.from_cells(as_cells(spark, -spd), n, n, side=4))


def test_eigenpairs(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 18)) * np.r_[10.0, 5, 4, np.ones(15)]
    t = tiles.from_cells(as_cells(spark, x), 60, 18, side=8)
    values, vectors, rest = tiles.gram_eigenpairs(t, 4, block=4)
    want, axes = np.linalg.eigh(x.T @ x)
    assert np.allclose(values, want[::-1][:4]) and (rest < 1e-8 * values[0]).all()
    v = whole(vectors.cells(), (18, 4))
    assert np.allclose(np.abs((v * axes[:, ::-1][:, :4]).sum(0)), 1, atol=1e-6)


# -- bounded k-means, kept models, the flat format ------------------------------------


def test_bounded_steps_are_plain_steps(spark):
    v, df = clustered(spark, 1500, 4, 9)
    seeds = cluster.KMeans(tuple(map(tuple, v[np.linspace(0, 1400, 12).astype(int)].tolist())))
    model, steps = bounded_kmeans.kmeans_bounded(df, 12, 40, init=seeds)
    plain = seeds
    for _ in range(len(steps)):
        plain = plain.step(df)
    assert np.allclose(model.centroids, plain.centroids, atol=1e-9) and model.converged
    late = [s.decided / s.rows for s in steps[5:]]
    assert late and min(late) > 0.5
    assert abs(model.distortion - plain.step(df).distortion) < 1e-6 * max(1.0, plain.distortion)
    with pytest.raises(FitFailed):
        bounded_kmeans.kmeans_bounded(df.limit(0), 3, init=cluster.KMeans(((0.0,) * 4, (1.0,) * 4)))


def test_kept_models_count_no_batch_twice(spark, tmp_path):
    rng = np.random.default_rng(1)
    parts = [spark.createDataFrame([(*map(float, x), float(x @ [1.0, -2.0] + 3)) for x in rng.normal(size=(20, 2))] + [(None, 1.0, 1.0)], "a double, b double, y double") for _ in range(6)]
    model = kept.KeptLinear(f"file://{tmp_path}/sums", ("a", "b"), "y")
    add = kept.add_batch(model.path, kept.cross_sums(model.columns, "y"), ["i", "j"])
    for i, p in enumerate(parts):
        add(p, i)
    first = {(r.i, r.j): r.v for r in kept.total(spark, model.path).collect()}
    for i in (4, 5, 5):
        add(parts[i], i)
    assert {(r.i, r.j): r.v for r in kept.total(spark, model.path).collect()} == pytest.approx(first)
    assert first[0, 0] == 120 and kept.batches(spark, model.path) == [2, 3, 4, 5]
    m = model.model(spark)
    assert np.allclose(m.coefficients, [1, -2]) and abs(m.intercept - 3) < 1e-9
    with pytest.raises(FitFailed):
        kept.KeptLinear(f"file://{tmp_path}/none", ("a",), "y").model(spark)


def test_flat_files(spark, tmp_path):
    v = np.random.default_rng(3).normal(size=(50, 6)).astype("<f4")
    (tmp_path / "one.xy").write_bytes(datasets.xy_bytes(v, np.arange(50)))
    df = datasets.read_xy(spark, f"file://{tmp_path}/one.xy", partitionBytes="400")
    assert df.rdd.getNumPartitions() == 4
    assert np.array_equal(np.array([r.features for r in df.orderBy("id").collect()], "<f4"), v)
    path = f"file://{tmp_path}/many"
    for _ in range(2):
        datasets.write_xy(df.repartition(3), path)
    back = sorted((r.target, tuple(r.features)) for r in datasets.read_xy(spark, path).collect())
    assert back == sorted((float(i), tuple(map(float, x))) for i, x in enumerate(v)) and len(list((tmp_path / "many").iterdir())) <= 3
    with pytest.raises(Exception, match="as many features"):
        datasets.write_xy(spark.createDataFrame([([1.0], 1.0), ([1.0, 2.0], 1.0)], "features array<double>, target double").coalesce(1), f"file://{tmp_path}/bad")
    assert not [p for p in (tmp_path / "bad").iterdir() if not p.name.startswith((".", "_"))] if (tmp_path / "bad").exists() else True
    (tmp_path / "cut.xy").write_bytes(datasets.xy_bytes(v, np.arange(50))[:-3])
    with pytest.raises((ReadingError, Exception), match="expected 350 numbers"):
        datasets.read_xy(spark, f"file://{tmp_path}/cut.xy").collect()


def test_forests_come_back(spark, tmp_path):
    _, _, df = labelled(spark, 200)
    f = tree.random_forest_classifier(df, ["a", "b"], "y", "id", n_trees=3, max_depth=3)
    models.save(spark, f, f"file://{tmp_path}/f")
    again = models.load(spark, f"file://{tmp_path}/f")
    rows = lambda m: sorted((r.id, r.prediction) for r in m.predict_oob(df, "id").collect() if r.prediction is not None)
    assert rows(again) == rows(f)


# -- machines by their duals -----------------------------------------------------------


@pytest.mark.parametrize("eps", [None, 0.2])
def test_dual_machines_reach_the_primal_optimum(spark, eps):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 2))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=160) > 0.2, 1, -1) if eps is None else x @ [1.0, -2.0] + 0.3 * rng.normal(size=160) + 1
    df = spark.createDataFrame([(i, v, float(t)) for i, (v, t) in enumerate(zip(x.tolist(), y, strict=True))] + [(900, None, 1.0), (901, [0.0, 0.0], None)], "id long, features array<double>, y double").repartition(3)
    m = svm_dual.fit(df, "features", "y", kernels.Linear(), "id", c=2.0, eps=eps, tol=1e-4)
    w = m.machine.weights @ m.machine.vectors
    loss = lambda w, b: 0.5 * w @ w + 2 * np.maximum(0, 1 - y * (x @ w + b) if eps is None else np.abs(x @ w + b - y) - eps).sum()
    best = loss(w, m.machine.bias)
    assert m.gap <= 1e-4 and m.duals.count() == 160
    for _ in range(200):
        assert loss(w + rng.normal(size=2) * 0.05, m.machine.bias + rng.normal() * 0.05) >= best * (1 - 2e-4)
    other = svm.svc(df, "features", "y", kernels.Linear(), 2.0) if eps is None else svm.svr(df, "features", "y", kernels.Linear(), eps, 2.0)
    assert best <= loss(other.weights @ other.vectors, other.bias) * (1 + 2e-4)
    with pytest.raises(FitFailed):
        svm_dual.fit(df, "features", "y", kernels.Linear(), "id", eps=eps, tol=1e-12, max_rounds=2)
