import numpy as np
import pytest

from weftline.functions import kernels
from weftline.operators import svm_dual


@pytest.mark.parametrize("eps", [None, 0.1])
def test_rounds_do_not_grow_with_tasks(spark, eps, monkeypatch):
    monkeypatch.setattr(svm_dual, "TASK_ROWS", 60)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3))
    y = np.where(x[:, 0] + rng.normal(size=600) > 0, 1.0, -1.0) if eps is None else 3 * rng.normal(size=600) + x @ [5.0, 0.0, -5.0]
    df = spark.createDataFrame([(i, v, float(t)) for i, (v, t) in enumerate(zip(x.tolist(), y, strict=True))], "id long, features array<double>, y double")
    m = svm_dual.fit(df, "features", "y", kernels.Linear(), "id", eps=eps, max_rounds=12)
    rows = sorted(m.duals.collect())
    b = np.array([r.dual for r in rows])
    t = x @ (m.machine.weights @ m.machine.vectors) + m.machine.bias
    gap, loss = svm_dual.row_gaps(t, y, b, 1.0, eps)
    assert gap.min() > -1e-9 and gap.sum() <= 1e-3 * max(1.0, loss.sum() * 2) and abs(b.sum()) <= 1e-3 * loss.sum()
