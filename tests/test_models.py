"""Small fixtures, invariants and error cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.errors import DecompositionFailed, FindFailed, FitFailed, ParametersError, ReadingError, SolutionFailed
from weftline.functions import distance, kernels, vectors
from weftline.operators import cluster, decomposition, linalg, linear, logistic, metrics, naive_bayes, neighbors, optimize, preprocessing, selection, solvers, svm, tree
from weftline.sources import csv, datasets, models


def packed(spark, rows, y=None):
    data = [(i, [float(v) for v in r], *([float(y[i])] if y else [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "id long, features array<double>" + (", y double" if y else ""))


def wide(spark, rows, y):
    names = [f"f{j}" for j in range(len(rows[0]))]
    return spark.createDataFrame([(i, *map(float, r), t) for i, (r, t) in enumerate(zip(rows, y, strict=True))], "id long, " + ", ".join(f"{n} double" for n in names) + (", y int" if isinstance(y[0], int) else ", y double")), names


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} array<double>" for c in cols))
    return df.select(expr).first()[0]


def test_kernels_and_distances(spark):
    a, b = F.col("a"), F.col("b")
    v = {"a": [1.0, 2.0, 3.0], "b": [4.0, 5.0, 6.0]}
    assert one(spark, kernels.Linear().column(a, b), **v) == 32
    assert abs(one(spark, kernels.RBF(0.055).column(a, b), **v) - 0.2265) < 1e-4
    assert abs(one(spark, kernels.Polynomial(3, 0.5, 1.0).column(a, b), **v) - 4913) < 1e-9
    assert abs(one(spark, kernels.Sigmoid(0.01, 0.1).column(a, b), **v) - 0.3969) < 1e-4
    assert abs(one(spark, kernels.Sigmoid(0.01, 0.1, compat=True).column(a, b), **v) - 0.4197) < 1e-4
    assert one(spark, distance.hamming(a, b), a=[1.0, 0.0, 0.0, 1.0], b=[1.0, 1.0, 0.0, 1.0]) == 0.25
    assert abs(one(spark, distance.minkowski(1)(a, b), **v) - 9) < 1e-12
    with pytest.raises(ParametersError):
        distance.minkowski(0)
    with pytest.raises(ParametersError):
        distance.mahalanobis(np.zeros((2, 2)))
    with pytest.raises(Exception, match="length"):
        one(spark, distance.euclidian(a, b), a=[1.0], b=[1.0, 2.0])
    assert one(spark, vectors.argmax(a), a=[1.0, 3.0, 3.0]) == 1
    assert one(spark, vectors.norm(a, float("-inf")), a=[-2.0, 3.0]) == 2


def test_binary_metrics_in_both_conventions(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 0], [0, 0, 1, 1], strict=True)), "y int, p int")
    assert metrics.score(metrics.precision(df, "y", "p")) == 0.5
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1, 1], [0, 1, 1, 1, 1, 0], strict=True)), "y int, p int")
    assert metrics.score(metrics.precision(df, "y", "p")) == metrics.score(metrics.recall(df, "y", "p", compat=True)) == 0.75
    df = spark.createDataFrame([(0.0, 0.1), (0.0, 0.4), (1.0, 0.35), (1.0, 0.8)], "y double, s double")
    assert metrics.score(metrics.roc_auc(df, "y", "s")) == 0.75
    df = spark.createDataFrame([(1.0, 0.5), (0.0, 0.2), (1.0, 0.5), (0.0, 0.5)], "y double, s double")
    assert metrics.score(metrics.roc_auc(df, "y", "s")) == 0.75
    with pytest.raises(Exception, match="0 or 1"):
        metrics.score(metrics.roc_auc(spark.createDataFrame([(2.0, 0.1)], "y double, s double"), "y", "s"))


def test_hcv(spark):
    t, p = [0, 0, 1, 1, 2, 0, 4], [1, 0, 0, 0, 0, 1, 0]
    row = metrics.hcv(spark.createDataFrame(list(zip(t, p, strict=True)), "t int, p int"), "t", "p").first()
    assert abs(row.homogeneity - 0.2548) < 1e-3 and abs(row.completeness - 0.5440) < 1e-3 and abs(row.v_measure - 0.3471) < 1e-3
    row = metrics.hcv(spark.createDataFrame([(1, 1), (1, 1)], "t int, p int"), "t", "p").first()
    assert tuple(row) == (1.0, 1.0, 1.0)


def test_scaler_and_encoders(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 3), 0.5) for i in range(6)], "id int, a double, b double, c double")
    scaled = preprocessing.StandardScaler.fit(df, ["a", "b"]).transform(df)
    assert [r.a for r in scaled.collect()] == [0.0] * 6
    assert abs(scaled.agg(F.stddev_pop("b")).first()[0] - 1) < 1e-12
    enc = preprocessing.OneHotEncoder.fit(df, ["b"], "id")
    assert enc.transform(df).columns == ["id", "a", "b_0", "b_1", "b_2", "c"]
    with pytest.raises(FitFailed):
        preprocessing.OneHotEncoder.fit(df, ["c"], "id")
    with pytest.raises(Exception, match="unseen"):
        enc.transform(df.withColumn("b", F.lit(7.0))).collect()
    m = preprocessing.CategoryMapper.fit(spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None)], "i int, c string"), "c", "i")
    assert m.categories == ("b", "a") and m.get_num("a") == 1 and m.get_cat(0) == "b" and m.invert_one_hot([0.0, 1.0]) == "a"


def test_neighbours(spark):
    df = packed(spark, [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10]], [2.0, 2, 2, 3, 3])
    got = dict(neighbors.KNNClassifier(df, "y", 3).predict(df).collect())
    assert [got[i] for i in range(5)] == [2, 2, 2, 3, 3]
    line = packed(spark, [[1], [2], [3], [4], [5]], [1.0, 2, 3, 4, 5])
    q = packed(spark, [[4.1]])
    assert neighbors.KNNClassifier(line, "y", 5, "distance").predict(q).first().prediction == 4
    assert abs(neighbors.KNNRegressor(line, "y", 1, "distance").predict(packed(spark, [[3.0]])).first().prediction - 3) < 1e-12
    with pytest.raises(ParametersError):
        neighbors.KNNClassifier(df, "y", 1)
    with pytest.raises(FindFailed):
        neighbors.knn(df, df, 6)
    with pytest.raises(FindFailed):
        neighbors.radius(df, df, 0.0)
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(60, 2))
    p = packed(spark, pts)
    grid = {(r.query_id, r.id) for r in neighbors.radius_grid(p, 0.5).collect()}
    assert grid == {(r.query_id, r.id) for r in neighbors.radius(p, p, 0.5).collect()}
    pair = neighbors.closest_pair(p).first()
    d = ((pts[:, None] - pts[None]) ** 2).sum(-1) + np.eye(60) * 9
    assert abs(pair.squared - d.min()) < 1e-12


def test_gaussian_nb_fixture(spark):
    df = packed(spark, [[-1, -1], [-2, -1], [-3, -2], [1, 1], [2, 1], [3, 2]], [1.0, 1, 1, 2, 2, 2])
    nb = naive_bayes.gaussian(df, "y")
    stats = {(r.label, r.j): (r.theta, r["var"]) for r in nb.stats.collect()}
    assert abs(stats[(1.0, 0)][0] + 2) < 1e-9 and abs(stats[(1.0, 0)][1] - 0.6666667) < 1e-6
    assert [r.prediction for r in nb.predict(df, "id").orderBy("id").collect()] == [1, 1, 1, 2, 2, 2]
    priors = naive_bayes.gaussian(df, "y", priors=[0.3, 0.7]).classes.orderBy("label").collect()
    assert [r.prior for r in priors] == [0.3, 0.7]
    with pytest.raises(FitFailed):
        naive_bayes.gaussian(df, "y", priors=[1.0])


def test_discrete_nb_fixtures(spark):
    docs = packed(spark, [[2, 1, 0, 0, 0, 0], [2, 0, 1, 0, 0, 0], [1, 0, 0, 1, 0, 0], [1, 0, 0, 0, 1, 1]], [0.0, 0, 0, 1])
    test = packed(spark, [[3, 0, 0, 0, 1, 1]])
    nb = naive_bayes.multinomial(docs, "y")
    assert [r.prior for r in nb.classes.orderBy("label").collect()] == [0.75, 0.25]
    assert nb.predict(test, "id").first().prediction == 0
    binary = packed(spark, [[1, 1, 0, 0, 0, 0], [0, 1, 0, 0, 1, 0], [0, 1, 0, 1, 0, 0], [0, 1, 1, 0, 0, 1]], [0.0, 0, 0, 1])
    assert naive_bayes.bernoulli(binary, "y").predict(packed(spark, [[0, 1, 1, 0, 0, 1]]), "id").first().prediction == 1
    play = [[2, 2, 1, 0], [2, 2, 1, 1], [1, 2, 1, 0], [0, 1, 1, 0], [0, 0, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1], [2, 1, 1, 0], [2, 0, 0, 0], [0, 1, 0, 0], [2, 1, 0, 1], [1, 1, 1, 1], [1, 2, 0, 0], [0, 1, 1, 1]]
    y = [0.0, 0, 1, 1, 1, 0, 1, 0, 1, 1, 1, 1, 1, 0]
    nb = naive_bayes.categorical(packed(spark, play, y), "y")
    got = [r.prediction for r in nb.predict(packed(spark, [[0, 2, 1, 0], [2, 2, 0, 0]]), "id").orderBy("id").collect()]
    assert got == [0, 1]
    unseen = nb.scores(packed(spark, [[9, 2, 1, 0]]), "id").orderBy("label").collect()
    assert [round(r.score, 6) for r in unseen] == [round(float(np.log(5 / 14)), 6), round(float(np.log(9 / 14)), 6)]


LONGLEY = np.array([[234.289, 235.6, 159.0, 107.608, 1947.0, 60.323], [259.426, 232.5, 145.6, 108.632, 1948.0, 61.122], [258.054, 368.2, 161.6, 109.773, 1949.0, 60.171], [284.599, 335.1, 165.0, 110.929, 1950.0, 61.187], [328.975, 209.9, 309.9, 112.075, 1951.0, 63.221], [346.999, 193.2, 359.4, 113.270, 1952.0, 63.639], [365.385, 187.0, 354.7, 115.094, 1953.0, 64.989], [363.112, 357.8, 335.0, 116.219, 1954.0, 63.761], [397.469, 290.4, 304.8, 117.388, 1955.0, 66.019], [419.180, 282.2, 285.7, 118.734, 1956.0, 67.857], [442.769, 293.6, 279.8, 120.445, 1957.0, 68.169], [444.546, 468.1, 263.7, 121.950, 1958.0, 66.513], [482.704, 381.3, 255.2, 123.366, 1959.0, 68.655], [502.601, 393.1, 251.4, 125.368, 1960.0, 69.564], [518.173, 480.6, 257.2, 127.852, 1961.0, 69.331], [554.894, 400.7, 282.7, 130.081, 1962.0, 70.551]])
DEFLATOR = [83.0, 88.5, 88.2, 89.5, 96.2, 98.1, 99.0, 100.0, 101.2, 104.6, 108.4, 110.8, 112.6, 114.2, 115.7, 116.9]


def test_linear_models(spark):
    df, names = wide(spark, LONGLEY.tolist(), DEFLATOR)
    x, y = LONGLEY, np.array(DEFLATOR)
    a = np.column_stack((x - x.mean(0), np.ones(16)))
    for solver in ("svd", "qr"):
        m = linear.linear_regression(df, names, "y", solver)
        assert np.allclose(a @ np.append(m.coefficients, m.intercept + m.coefficients @ x.mean(0)), a @ np.linalg.lstsq(a, y, rcond=None)[0], atol=1e-5)
    z, yc = (x - x.mean(0)) / x.std(0), y - y.mean()
    ridge = linear.ridge_regression(df, names, "y", 0.1)
    want = np.linalg.solve(z.T @ z + 0.1 * np.eye(6), z.T @ yc) / x.std(0)
    assert np.allclose(ridge.coefficients, want, atol=1e-7)
    raw = linear.ridge_regression(df, names, "y", 0.1, normalize=False)
    assert raw.intercept == 0.0 and np.allclose(raw.coefficients, np.linalg.solve(x.T @ x + 0.1 * np.eye(6), x.T @ y), atol=1e-5)
    for m, l1, l2 in ((linear.lasso(df, names, "y", 0.1), 1.6, 0.0), (linear.elastic_net(df, names, "y", 0.1, 0.5), 0.8, 0.8)):
        w = np.array(m.coefficients) * x.std(0)
        g = -2 * z.T @ (yc - z @ w) + 2 * l2 * w
        assert all(abs(v + l1 * np.sign(u)) < 1e-2 if abs(u) > 1e-9 else abs(v) <= l1 + 1e-2 for u, v in zip(w, g, strict=True))
    assert metrics.score(metrics.mean_absolute_error(ridge.predict(df), "y", "prediction")) < 2
    with pytest.raises(FitFailed):
        linear.ridge_regression(df.limit(4), names, "y")
    with pytest.raises(FitFailed):
        linear.ridge_regression(df.withColumn("f0", F.lit(1.0)), names, "y")
    with pytest.raises(FitFailed):
        linear.lasso(df, names, "y", -1.0)


def test_factorisations():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5))
    low, up, p = linalg.lu(a)
    assert np.allclose(p @ a, low @ up)
    s = a @ a.T + np.eye(5)
    assert np.allclose(linalg.cholesky(s) @ linalg.cholesky(s).T, s)
    b = rng.normal(size=5)
    for solve in (linalg.lu_solve, linalg.cholesky_solve, linalg.qr_solve):
        assert np.allclose(s @ solve(s, b), b)
    assert np.allclose(linalg.svd(s).solve(b), np.linalg.solve(s, b))
    e = linalg.evd(s, True)
    assert (np.diff(e.d) <= 0).all() and np.allclose(s @ e.v, e.v * e.d)
    assert np.allclose(sorted(linalg.evd(np.array([[0.0, 1], [-1, 0]]), False).e), [-1, 1])
    with pytest.raises(DecompositionFailed):
        linalg.cholesky(-s)
    with pytest.raises(SolutionFailed):
        linalg.lu_solve(np.zeros((2, 2)), np.ones(2))
    with pytest.raises(SolutionFailed):
        linalg.qr_solve(np.ones((2, 2)), np.ones(2))


def test_tall_factors(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(70, 3)) @ np.diag([1, 100, 1e-3])
    df, names = wide(spark, x.tolist(), [0.0] * 70)
    df = df.repartition(40)
    f = solvers.qr(df, names)
    assert np.allclose(f.r.T @ f.r, x.T @ x) and np.allclose(np.tril(f.r, -1), 0)
    q = np.array([r.q for r in f.q(df).orderBy("id").select("q").collect()])
    assert np.allclose(q @ f.r, x) and np.allclose(q.T @ q, np.eye(3))
    s = solvers.tall_svd(df, names)
    assert np.allclose(s.s, np.linalg.svd(x)[1])
    u = np.array([r.u for r in s.u(df).orderBy("id").select("u").collect()])
    assert np.allclose(u * s.s @ s.v.T, x)
    assert np.allclose(solvers.triangle(df.limit(2), names).shape, (3, 3))
    with pytest.raises(FitFailed):
        solvers.triangle(df.limit(0), names)
    # Nearly dependent columns, which the squared matrix could not tell apart.
    a = rng.normal(size=50)
    near, _ = wide(spark, np.stack((a, a + 1e-9 * rng.normal(size=50)), 1).tolist(), (2 * a).tolist())
    w = linear.linear_regression(near, ["f0", "f1"], "y", "qr").coefficients
    assert abs(sum(w) - 2) < 1e-5
    with pytest.raises(FitFailed):
        linear.linear_regression(near.withColumn("f1", F.col("f0")), ["f0", "f1"], "y", "qr")


def test_biconjugate_gradient(spark):
    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(6, 6)) + 6 * np.eye(6), rng.normal(size=6)
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6)], "i long, j long, value double")
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, value double")
    x, residual, steps = solvers.biconjugate_gradient(cells, right)
    assert residual < 1e-9 and steps <= 12
    assert np.allclose([r.value for r in x.orderBy("i").collect()], np.linalg.solve(a, b))
    zero, residual, steps = solvers.biconjugate_gradient(cells, right.withColumn("value", F.lit(0.0)))
    assert residual == 0 and steps == 0 and {r.value for r in zero.collect()} == {0.0}
    with pytest.raises(SolutionFailed):
        solvers.biconjugate_gradient(cells, right, tol=0)


def test_impurities():
    assert tree.impurity([0.5, 0.5], "gini") == 0.5
    assert tree.impurity([0.5, 0.5], "entropy") == 1.0
    assert tree.impurity([0.75, 0.25], "classification_error") == 0.25


def test_importances_follow_the_criterion(spark):
    df, names = wide(spark, [[0.0], [0.0], [1.0], [1.0]], [0, 0, 1, 1])
    for criterion, want in (("gini", 0.5), ("entropy", 1.0), ("classification_error", 0.5)):
        assert tree.decision_tree_classifier(df, names, "y", criterion).feature_importances() == [want]


def test_decompositions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    df, names = wide(spark, x.tolist(), [0.0] * 50)
    p = decomposition.pca(df, names, 4)
    s = np.linalg.svd(x - x.mean(0))[1]
    assert np.allclose(p.eigenvalues, s**2)
    c = decomposition.pca(df, names, 4, use_correlation_matrix=True)
    assert np.allclose(c.eigenvalues, np.linalg.eigvalsh(np.corrcoef(x.T))[::-1])
    t = decomposition.truncated_svd(df, names, 2).transform(df).select("pc0", "pc1").toPandas().to_numpy()
    assert np.allclose(np.linalg.norm(t, axis=0), np.linalg.svd(x)[1][:2])
    with pytest.raises(FitFailed):
        decomposition.pca(df, names, 5)


def test_optimisers_on_rosenbrock():
    def f(x):
        a, b = x[0], x[1]
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    r = optimize.lbfgs(f, [0.0, 0.0])
    assert r.converged and r.f_x < 1e-10 and r.iterations <= 24
    g = optimize.gradient_descent(f, [-1.0, 1.0], max_iter=50_000)
    assert g.f_x < 1e-5 and np.allclose(g.x, 1, atol=1e-2)


def test_logistic(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = [int(v) for v in (x @ [1.0, -2.0] + rng.normal(size=120) > 0)]
    df, names = wide(spark, x.tolist(), y)
    m = logistic.logistic_regression(df, names, "y", alpha=1.0)
    w, b = np.array(m.coefficients[0]), m.intercept[0]
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs((p - y) @ x + w).max() < 1e-4 and abs((p - y).sum()) < 1e-4
    y3 = [0 if a < -0.4 else 1 if a < 0.5 else 2 for a in x[:, 0]]
    df3, _ = wide(spark, x.tolist(), y3)
    m3 = logistic.logistic_regression(df3, names, "y", alpha=0.01)
    assert metrics.score(metrics.accuracy(m3.predict(df3), "y", "prediction")) > 0.95
    with pytest.raises(FitFailed):
        logistic.logistic_regression(df.where("y = 0"), names, "y")


def test_clustering(spark):
    rows = [[1.0, 1], [1.1, 1], [0.9, 1], [1, 1.1], [1, 0.9], [5, 5], [5.1, 5], [4.9, 5], [5, 5.1], [5, 4.9], [9, 0]]
    df = packed(spark, rows)
    m = cluster.dbscan(df, 0.5, 2)
    got = [r["cluster"] for r in m.labels.orderBy("id").collect()]
    assert got == [0] * 5 + [1] * 5 + [-1]
    assert [r.prediction for r in m.predict(df).orderBy("query_id").collect()] == [1] * 5 + [2] * 5 + [0]
    km = cluster.kmeans(df.where("id < 10"), 2, 20)
    labels = [r["cluster"] for r in km.predict(df).orderBy("id").collect()]
    assert len(set(labels[:5])) == len(set(labels[5:10])) == 1 and labels[0] != labels[5] and km.converged
    for bad in ({"k": 1}, {"max_iter": 0}):
        with pytest.raises(FitFailed):
            cluster.kmeans(df, **({"k": 2} | bad))
    with pytest.raises(FitFailed):
        cluster.dbscan(df, 0.0, 2)


def test_trees(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    y = [int(a > 0.2) + 2 * int(b > 0) for a, b, _ in x]
    df, names = wide(spark, x.tolist(), y)
    t = tree.decision_tree_classifier(df, names, "y")
    assert metrics.score(metrics.accuracy(t.predict(df), "y", "prediction")) == 1.0
    imp = t.feature_importances(normalize=True)
    assert abs(sum(imp) - 1) < 1e-9 and imp[2] < 0.05 and t.depth >= 2
    assert tree.decision_tree_classifier(df, names, "y", max_depth=1).depth == 1
    binned = tree.decision_tree_classifier(df, names, "y", bins=16)
    assert metrics.score(metrics.accuracy(binned.predict(df), "y", "prediction")) > 0.9
    target = [3.0 * (a > 0) + b for a, b, _ in x.tolist()]
    dr, _ = wide(spark, x.tolist(), target)
    r = tree.decision_tree_regressor(dr, names, "y")
    assert metrics.score(metrics.mean_absolute_error(r.predict(dr), "y", "prediction")) < 1e-9
    f = tree.random_forest_classifier(df, names, "y", "id", n_trees=12, max_depth=6)
    assert metrics.score(metrics.accuracy(f.predict(df), "y", "prediction")) > 0.9
    assert f.predict_oob(df, "id").where("prediction is not null").count() > 60
    g = tree.random_forest_regressor(dr, names, "y", "id", n_trees=5, max_depth=5)
    assert metrics.score(metrics.mean_absolute_error(g.predict(dr), "y", "prediction")) < 1
    with pytest.raises(FitFailed):
        tree.decision_tree_classifier(df.where("y = 1"), names, "y")


def test_machines(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(-2, 0.7, (30, 2)), rng.normal(2, 0.7, (30, 2))))
    df = packed(spark, x, [-1.0] * 30 + [1.0] * 30)
    for k in (kernels.Linear(), kernels.RBF(0.5)):
        m = svm.svc(df, "features", "y", k)
        assert m.predict_class(df).where("prediction = y").count() >= 59
    line = packed(spark, [[i / 10] for i in range(40)], [i / 5 + 1 for i in range(40)])
    r = svm.svr(line, "features", "y", kernels.Linear(), eps=0.1, c=10.0)
    assert line.join(r.predict_value(line).select("id", "prediction"), "id").agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 0.15
    for bad in (None,):
        with pytest.raises(FitFailed):
            svm.svc(df, "features", "y", bad)
    with pytest.raises(FitFailed):
        svm.svc(line, "features", "y", kernels.Linear())
    few = svm.svc(df, "features", "y", kernels.RBF(0.5), landmarks=12)
    assert len(few.vectors) == 12 and few.predict_class(df).where("prediction = y").count() >= 57
    # With all rows as landmarks the machine is at the minimum: no small change of its weights lowers what it minimises.
    m = svm.svc(df, "features", "y", kernels.RBF(0.5))
    k, t = kernels.RBF(0.5).matrix(m.vectors, m.vectors), np.sign(m.vectors[:, 0])
    cost = lambda w: 0.5 * w @ k @ w + np.maximum(0, 1 - t * (k @ w + m.bias)).sum()
    assert all(cost(m.weights) <= cost(m.weights + 0.05 * rng.normal(size=len(t))) + 0.02 * cost(m.weights) for _ in range(50))


def test_selection(spark):
    df = spark.range(33).withColumnRenamed("id", "i")
    sizes = [r["count"] for r in selection.k_fold(df, "i", 5, shuffle=True, seed=3).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [7, 7, 7, 6, 6]
    train, test = selection.train_test_split(df, "i", 0.2, shuffle=True)
    assert test.count() == 6 and train.count() == 27 and not {r.i for r in train.collect()} & {r.i for r in test.collect()}
    with pytest.raises(ParametersError):
        selection.k_fold(df, "i", 1)
    with pytest.raises(ParametersError):
        selection.train_test_split(df, "i", 1.5)
    assert list(selection.param_grid(a=[1, 2], b=[3, 4])) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 4}]
    lng, names = wide(spark, LONGLEY.tolist(), DEFLATOR)
    score = lambda t: -metrics.score(metrics.mean_absolute_error(t, "y", "prediction"))
    got = selection.grid_search(lng, "id", lambda t, alpha: linear.ridge_regression(t, names, "y", alpha), score, {"alpha": [1000.0, 0.1]}, n_splits=2)
    assert got.best_params == {"alpha": 0.1}


def test_sources(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("x;y\n# second header;\n1.5; 2\n 3;-4e1\n")
    got = csv.read_matrix(spark, f"file://{f}", header_rows=2, sep=";")
    assert sorted(map(tuple, got.collect())) == [(1.5, 2.0), (3.0, -40.0)]
    (tmp_path / "b.csv").write_text("h\n")
    with pytest.raises(ReadingError) as e:
        csv.read_matrix(spark, f"file://{tmp_path}/b.csv")
    assert e.value.kind == "NoRowsProvided"
    with pytest.raises(ReadingError):
        csv.read_matrix(spark, f"file://{tmp_path}/missing.csv")
    (tmp_path / "c.csv").write_text("h,i\n1,2\n1,x\n")
    with pytest.raises(Exception, match="InvalidField"):
        csv.read_matrix(spark, f"file://{tmp_path}/c.csv").collect()
    (tmp_path / "d.csv").write_text("h,i\n1,2\n1\n")
    with pytest.raises(Exception, match="InvalidRow"):
        csv.read_matrix(spark, f"file://{tmp_path}/d.csv").collect()
    (tmp_path / "e.xy").write_bytes(datasets.xy_bytes([[1, 2], [3, 4]], [0, 1]))
    assert [(r.id, r.features, r.target) for r in datasets.read_xy(spark, f"file://{tmp_path}/e.xy").orderBy("id").collect()] == [(0, [1.0, 2.0], 0.0), (1, [3.0, 4.0], 1.0)]
    blobs = datasets.make_blobs(spark, 90, 2, 3, seed=1)
    assert blobs.groupBy("label").count().count() == 3


def test_models_come_back(spark, tmp_path):
    df, names = wide(spark, LONGLEY.tolist(), DEFLATOR)
    for i, m in enumerate((linear.ridge_regression(df, names, "y"), decomposition.pca(df, names, 2), tree.decision_tree_regressor(df, names, "y", max_depth=2), preprocessing.StandardScaler.fit(df, names))):
        models.save(spark, m, f"file://{tmp_path}/{i}")
        again = models.load(spark, f"file://{tmp_path}/{i}")
        assert models.to_json(again) == models.to_json(m)


def test_models_with_tables_come_back(spark, tmp_path):
    rng = np.random.default_rng(14)
    x = np.concatenate((rng.normal(-2, 1, (30, 3)), rng.normal(2, 1, (30, 3))))
    df = packed(spark, x, [0.0] * 30 + [1.0] * 30)
    nb = [naive_bayes.gaussian(df, "y"), naive_bayes.bernoulli(df, "y", binarize=0.5), naive_bayes.multinomial(df.withColumn("features", F.transform("features", lambda v: F.abs(v))), "y")]
    cat = df.withColumn("features", F.transform("features", lambda v: F.floor(F.abs(v)).cast("double"))).withColumn("y", F.col("y").cast("int"))
    models_ = [*((m, df, lambda m, d: m.predict(d, "id")) for m in nb), (naive_bayes.categorical(cat, "y"), cat, lambda m, d: m.predict(d, "id"))]
    models_ += [(neighbors.KNNClassifier(df, "y", 3), df, lambda m, d: m.predict(d)), (neighbors.KNNRegressor(df, "y", 3, "distance"), df, lambda m, d: m.predict(d)), (cluster.dbscan(df, 1.5, 3), df, lambda m, d: m.predict(d))]
    for i, (m, d, predict) in enumerate(models_):
        models.save(spark, m, f"file://{tmp_path}/{i}")
        again = models.load(spark, f"file://{tmp_path}/{i}")
        assert sorted(map(tuple, predict(again, d).collect())) == sorted(map(tuple, predict(m, d).collect()))
    with pytest.raises(ParametersError):
        models.save(spark, neighbors.KNNClassifier(df, "y", 3, distance=distance.minkowski(3)), f"file://{tmp_path}/no")


def test_large_models_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(15)
    df = packed(spark, rng.normal(size=(40, 3)), [float(i % 3) for i in range(40)])
    small = sorted(map(tuple, naive_bayes.gaussian(df, "y").scores(df, "id").collect()))
    monkeypatch.setattr(naive_bayes, "MODEL_CELLS", 0)
    large = sorted(map(tuple, naive_bayes.gaussian(df, "y").scores(df, "id").collect()))
    assert [a[:2] for a in small] == [b[:2] for b in large] and np.allclose([a[2] for a in small], [b[2] for b in large])


def test_categories_by_a_join(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, "z")], "id long, c string")
    m = preprocessing.CategoryMapper.fit(df.where("id < 5"), "c", "id")
    got = {r.id: r.n for r in m.join(df, "c", "n").collect()}
    assert got == {r.id: r.n for r in df.select("id", m.number(F.col("c")).alias("n")).collect()} == {1: 0, 2: 1, 3: 0, 4: None, 5: None}
    assert [r.h for r in df.orderBy("id").select(m.one_hot(F.col("c")).alias("h")).collect()] == [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_closest_pair_of_equal_and_of_many_rows(spark, monkeypatch):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(300, 4))
    monkeypatch.setattr(neighbors, "SAMPLE", 20)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d[np.tril_indices(300)] = np.inf
    i, j = np.unravel_index(d.argmin(), d.shape)
    r = neighbors.closest_pair(packed(spark, x)).first()
    assert (r.node, r.neighbour) == (i, j) and abs(r.squared - d.min()) < 1e-12
    r = neighbors.closest_pair(packed(spark, [[1.0, 2.0]] * 6)).first()
    assert (r.node, r.neighbour, r.distance) == (0, 1, 0.0)
