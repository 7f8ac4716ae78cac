"""Pairs of rows compared in blocks: Spark deals chunks of rows and queries to tasks, numpy compares what meets there.

A chunk holds a bounded number of rows and of components, so a task's memory does
not grow with the tables; work and exchange grow with the pairs that are asked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.distance import sliced

#: Rows of a chunk, and components in all.
ROWS, VALUES = 1024, 1 << 20
#: Partitions that groups are dealt to at most.
MOST_PARTITIONS = 2048
#: (query_id, id, value) of what a comparison keeps.
PAIR = "query_id long, id long, value double"


def chunks(n: int, dims: int, rows: int = ROWS) -> int:
    return max(1, -(-n // max(1, min(rows, VALUES // max(1, dims)))))


def part_of(id_col: str, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(n) if isinstance(n, int) else n).cast("int")


def upto(n: int | Column) -> Column:
    """The numbers below n, a row each."""
    return F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1))


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    v = column.combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(v), len(flat) // max(1, len(v)))


def table_of(query_id: np.ndarray, ids: np.ndarray, value: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(query_id, pa.int64()), "id": pa.array(ids, pa.int64()), "value": pa.array(value, pa.float64())})


def meet(rows: DataFrame, queries: DataFrame, keys: list[str], groups: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str = PAIR) -> DataFrame:
    """``work`` on the rows and queries of each key; groups that lack either give nothing. Columns are longs or doubles."""
    n = max(1, min(groups, MOST_PARTITIONS))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return work(left, right)

    kinds = {"long": pa.int64(), "double": pa.float64()}
    empty = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in schema.split(","))]).empty_table()
    # A given number of partitions is not made fewer by the bytes, which say little of the work.
    dealt = (df.repartition(n, *keys).groupBy(*keys) for df in (rows, queries))
    left, right = dealt
    return left.cogroup(right).applyInArrow(run, schema)


def smallest(d: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row of d, column of d) of each row's k least values, ties to the smaller id; NaN comes last."""
    if allowed is not None:
        d = np.where(allowed, d, np.inf)
    if d.shape[1] > k:
        bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        open_ = ~(d > bound)
    else:
        open_ = np.ones(d.shape, bool)
    if allowed is not None:
        open_ &= allowed
    i, j = np.nonzero(open_)
    order = np.lexsort((ids[j], d[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep]


def chosen(matrix, k: int | None, r: float | None, keep_self: bool, own_reach: bool = False):
    """A ``work`` for ``meet``: rows (id, v) and queries (query_id, q), the k nearest, those within r, or all.

    With ``own_reach`` rows have ``r`` and queries ``d`` and ``reach``, and only rows with |d - r| <= reach count.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qs = left["id"].to_numpy(), right["query_id"].to_numpy()
        v, q = vectors(left["v"]), vectors(right["q"])
        out = []
        for lo, hi in sliced(len(q), len(v)):
            allowed = None
            if own_reach:
                allowed = np.abs(right["d"].to_numpy()[lo:hi, None] - left["r"].to_numpy()[None, :]) <= right["reach"].to_numpy()[lo:hi, None]
                if not allowed.any():
                    continue
            if not keep_self:
                other = qs[lo:hi, None] != ids[None, :]
                allowed = other if allowed is None else allowed & other
            d = matrix(q[lo:hi], v)
            if k is not None:
                i, j = smallest(d, ids, k, allowed)
            else:
                hit = np.ones(d.shape, bool) if r is None else d <= r
                i, j = np.nonzero(hit if allowed is None else hit & allowed)
            out.append((qs[lo + i], ids[j], d[i, j]))
        return table_of(*(np.concatenate(x) for x in zip(*out))) if out else table_of(*(np.zeros(0),) * 3)

    return work


def within(matrix, r: float, left: pa.Table, right: pa.Table) -> np.ndarray:
    """Whether each query (query_id, q) is within r of each row (id, v), as a matrix of booleans."""
    v, q = vectors(left["v"]), vectors(right["q"])
    out = np.empty((len(q), len(v)), bool)
    for lo, hi in sliced(len(q), len(v)):
        out[lo:hi] = matrix(q[lo:hi], v) <= r
    return out


def stars(near: np.ndarray, ids: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each row and query that is near another to the least number of its component among them.

    They are no more than rows and queries, and join what all pairs of ``near`` join.
    """
    open_, fresh = near.any(1), np.ones(near.shape[1], bool)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(near)):
        if not open_[i]:
            continue
        open_[i], front, found = False, np.array([i]), [query_ids[i : i + 1]]
        while len(front):
            new = np.flatnonzero(near[front].any(0) & fresh)
            fresh[new] = False
            front = np.flatnonzero(near[:, new].any(1) & open_)
            open_[front] = False
            found += [ids[new], query_ids[front]]
        found = np.unique(np.concatenate(found))
        a.append(found[1:])
        b.append(np.full(len(found) - 1, found[0]))
    return np.concatenate(a), np.concatenate(b)


def _numbered(df: DataFrame, id_col: str, features: str, names: tuple[str, str]) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(names[0]), F.col(features).cast("array<double>").alias(names[1]))


def _plain(c: tuple[str, str], dims: int) -> Column:
    whole = F.col(c[0]).isNotNull() & (F.size(c[1]) == dims) & F.forall(c[1], lambda x: x.isNotNull())
    return F.coalesce(whole, F.lit(False))


def every(data: DataFrame, queries: DataFrame, id_col: str, features: str, f, beside: Callable[[DataFrame, DataFrame], DataFrame], k: int | None = None, r: float | None = None, keep_self: bool = True) -> DataFrame:
    """(query_id, id, value): all rows with all queries, the k nearest or those within r.

    ``f`` is a distance or a kernel with a matrix form. Rows without an id, or whose vector
    has nulls or another length, are left to ``beside``, which gives the same of (rows, queries).
    """
    left, right = _numbered(data, id_col, features, ("id", "v")), _numbered(queries, id_col, features, ("query_id", "q"))

    def told(df: DataFrame, c: tuple[str, str]):
        null = F.coalesce(F.col(c[0]).isNull() | F.exists(c[1], lambda x: x.isNull()), F.lit(True))
        return df.agg(F.count(F.lit(1)), F.min(F.size(c[1])), F.max(F.size(c[1])), F.coalesce(F.max(null.cast("int")), F.lit(0))).first()

    (n, low, dims, odd), (m, qlow, qdims, qodd) = told(left, ("id", "v")), told(right, ("query_id", "q"))
    dims = dims or 0
    a, b = chunks(n, dims), chunks(m, dims)
    clean, asked = left.where(_plain(("id", "v"), dims)), right.where(_plain(("query_id", "q"), dims))
    rows = clean.select("*", part_of("id", a).alias("rc"), upto(b).alias("qc"))
    wanted = asked.select("*", part_of("query_id", b).alias("qc"), upto(a).alias("rc"))
    matrix = f.matrix
    found = meet(rows, wanted, ["rc", "qc"], a * b, chosen(matrix, k, r, keep_self))
    if n and m and (odd or qodd or len({low, dims, qlow, qdims}) > 1):
        rest = left.where(~_plain(("id", "v"), dims))
        found = found.union(beside(rest, right)).union(beside(clean, right.where(~_plain(("query_id", "q"), dims))))
    return found
