"""Machines of the kernel itself, of which no row is left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.errors import FitFailed
from weftline.functions import kernels
from weftline.operators import svm, svm_dual, svm_rounds


def table(spark, x, y):
    return spark.createDataFrame([(i, v, float(t)) for i, (v, t) in enumerate(zip(x.tolist(), y, strict=True))], "id long, features array<double>, y double")


@pytest.mark.parametrize(("eps", "held"), [(None, 10), (0.1, svm.HELD_VALUES)])
def test_the_duals_prove_the_kernels_own_optimum(spark, eps, held, monkeypatch):
    monkeypatch.setattr(svm_rounds, "WORKING", 300)
    monkeypatch.setattr(svm_rounds, "TASK_ROWS", 250)
    monkeypatch.setattr(svm_rounds, "FAN_IN", 1)
    monkeypatch.setattr(svm_dual, "HELD_VALUES", held)
    monkeypatch.setattr(svm, "CHUNK_ROWS", 100)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6))
    x[50:60] = x[0]
    y = np.where(np.sin(3 * x[:, 0]) + rng.normal(size=500) > 0, 1.0, -1.0) if eps is None else np.sin(x[:, 0]) + 0.3 * rng.normal(size=500)
    df, rbf = table(spark, x, y), kernels.RBF(0.5)
    m = svm_dual.fit(df, "features", "y", rbf, "id", eps=eps)
    rows = sorted(m.duals.collect())
    b, k = np.array([r.dual for r in rows]), rbf.matrix(x, x)
    assert [r.id for r in rows] == list(range(500)) and (b != 0).sum() > 256
    t = k @ b + m.machine.bias
    gap, loss = svm_dual.row_gaps(t, y, b, 1.0, eps)
    # The gap is that of the kernel, not of a space that some rows span.
    assert gap.min() > -1e-9 and gap.sum() <= 1.001e-3 * (b @ k @ b / 2 + loss.sum()) and abs(b.sum()) < 1e-9
    assert isinstance(m.machine, svm.SupportTable if held == 10 else svm.SupportVectors)
    told = {r.id: r.f for r in m.machine.predict_value(df, "features", "f").select("id", "f").collect()}
    assert np.allclose([told[i] for i in range(500)], t, atol=1e-9)
    plain = svm.svc(df, "features", "y", rbf) if eps is None else svm.svr(df, "features", "y", rbf)
    told = {r.id: r.f for r in plain.predict_value(df, "features", "f").select("id", "f").collect()}
    assert np.abs([told[i] - t[i] for i in range(500)]).max() < 0.1


def test_what_cannot_be_fitted(spark):
    x, rbf = np.arange(12.0).reshape(6, 2), kernels.RBF(0.5)
    df = table(spark, x, [1.0, -1.0] * 3)
    with pytest.raises(FitFailed):
        svm_dual.fit(df.withColumn("features", F.expr("if(id = 3, array(1D), features)")), "features", "y", rbf, "id")
    with pytest.raises(FitFailed):
        svm_dual.fit(df.where("id < 0"), "features", "y", rbf, "id", eps=0.1)
    bent = svm.svc(df, "features", "y", kernels.Sigmoid(0.1))
    assert bent.predict_class(df).count() == 6
