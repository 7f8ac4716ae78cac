"""PCA and truncated SVD from the Gram aggregation; the projection is an expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from weftline.errors import FitFailed
from weftline.operators.linalg import evd, gram


@dataclass(frozen=True)
class Projection:
    """Rows times ``components`` (columns by components), minus ``offset``."""

    columns: tuple[str, ...]
    components: np.ndarray
    offset: np.ndarray
    eigenvalues: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        out = {}
        for k in range(self.components.shape[1]):
            e = F.lit(-float(self.offset[k]))
            for c, w in zip(self.columns, self.components[:, k], strict=True):
                e = e + F.col(c).cast("double") * float(w)
            out[f"{prefix}{k}"] = e
        return df.withColumns(out)


def pca(df: DataFrame, columns: Sequence[str], n_components: int = 2, use_correlation_matrix: bool = False) -> Projection:
    """Principal components; with more rows than columns and covariances the eigenvalues are sums of squares.

    Each component's sign is fixed so that its largest loading is positive.
    """
    if not 0 < n_components <= len(columns):
        raise FitFailed(f"{n_components} components asked of {len(columns)} columns")
    g = gram(df, columns)
    m = g.cross / g.n
    sd = np.ones(len(columns))
    if use_correlation_matrix:
        sd = g.std
        m = m / np.outer(sd, sd)
    e = evd(m, True)
    v = e.v[:, :n_components]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(n_components)])
    v = v / sd[:, None]
    values = e.d * g.n if not use_correlation_matrix and g.n > len(columns) else e.d
    return Projection(tuple(columns), v, g.mean @ v, values)


def truncated_svd(df: DataFrame, columns: Sequence[str], n_components: int = 2) -> Projection:
    """The leading right singular vectors of the uncentred rows."""
    if not 0 < n_components < len(columns):
        raise FitFailed(f"{n_components} components asked, but they must be fewer than the {len(columns)} columns")
    g = gram(df, columns)
    e = evd(g.cross + g.n * np.outer(g.mean, g.mean), True)
    v = e.v[:, :n_components]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(n_components)])
    return Projection(tuple(columns), v, np.zeros(n_components), np.sqrt(np.maximum(e.d, 0)))
