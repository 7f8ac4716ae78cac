"""Nearest neighbours by inner product over tiles of a block matrix join.

Vectors are dealt out evenly and packed into full blocks, and blocks of queries meet
slices of candidate blocks in a grid of tiles. In a tile both sides are int8
with a scale for each vector; their products are whole numbers, exact in the
floats of the matrix product, and the norms of the quantisation residuals bound
the error of each. A pair survives unless its upper bound is below the query's
20th lower bound so far; survivors are recomputed in double precision on the
original vectors, the best of a tile are picked, and a heap for each query
merges them across a slice. No true neighbour is lost, so the search is exact.
Where products may leave the range of doubles, queries are scaled by powers of
two, bounds that cannot be told let a pair survive, and a score is scaled back
at the end, so only a score that is itself too large is infinite.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from weftline.session import materialise

#: Vectors in a packed block, and values, whichever are fewer; blocks of a candidate slice and of a query group.
BLOCK, BLOCK_VALUES, SLICE, GROUP = 2048, 1 << 19, 16, 4
#: Blocks that one task packs, so that few stay partly filled.
PACKED = 8
_BLOCKS = "part long, dim int, ids binary, vectors binary"


def usable(vector) -> F.Column:
    """True for vectors with no null or non-finite component and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(batches):
    """Blocks of at most BLOCK vectors of one length; ``part`` numbers are random, to be dealt out by."""
    rng = np.random.Generator(np.random.PCG64())
    held: dict[int, tuple[list, list]] = {}

    def row(dim):
        ids, vs = held.pop(dim)
        return pa.RecordBatch.from_arrays([pa.array([int(rng.integers(2**62))]), pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.concatenate(vs).astype("<f8").tobytes()], pa.binary())], names=["part", "dim", "ids", "vectors"])

    for batch in batches:
        vectors = batch.column(1)
        flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))))
        for i, key in enumerate(batch.column(0).to_pylist()):
            v = flat[ends[i] : ends[i + 1]]
            ids, vs = held.setdefault(len(v), ([], []))
            ids.append(key)
            vs.append(v)
            if len(ids) >= min(BLOCK, max(1, BLOCK_VALUES // len(v))):
                yield row(len(v))
    for dim in list(held):
        yield row(dim)


def _quantise(x: np.ndarray):
    """int8 values, scales, norms of what they stand for, and norms of the residuals."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(float).tiny)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, _norm(near), _norm(x - near)


def _norm(x: np.ndarray) -> np.ndarray:
    """Norms of rows whose squares may not fit a double."""
    most = np.abs(x).max(axis=1)
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(most > 0, most * np.linalg.norm(x / np.where(most > 0, most, 1)[:, None], axis=1), 0)


#: Norms whose products are far from the ends of the doubles' range.
_SAFE = (1e-140, 1e140)


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each row, larger scores and then smaller ids first."""
    order = np.lexsort((ids, -scores, rows))
    of = rows[order]
    begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    nth = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
    return order[nth < k]


def _tiles(k: int):
    def unpack(table, i):
        dim = table["dim"][i].as_py()
        return np.frombuffer(table["ids"][i].as_py(), "<i8"), np.frombuffer(table["vectors"][i].as_py(), "<f8").reshape(-1, dim)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            return tiles(left, right)

    def tiles(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        for a in range(left.num_rows):
            qid, q = unpack(left, a)
            power = np.frexp(np.abs(q).max(axis=1))[1]
            plain = not len(q) or (_SAFE[0] < np.abs(q).max(axis=1).min() and np.abs(q).max() < _SAFE[1])
            q = q if plain else np.ldexp(q, -power[:, None])
            q8, qs, qn, qe = _quantise(q)
            # Integer sums stay below 2**24, so single precision holds them exactly up to 1040 components.
            kind = np.float32 if q.shape[1] <= 1040 else np.float64
            heaps: list[list] = [[] for _ in qid]
            floor, tick = np.full(len(qid), -np.inf), count()
            for b in range(right.num_rows):
                cid, c = unpack(right, b)
                c8, cs, cn, ce = _quantise(c)
                near = (q8.astype(kind) @ c8.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
                error = qe[:, None] * (cn + ce)[None, :] + qn[:, None] * ce[None, :]
                error += 1e-9 * (qn + qe)[:, None] * (cn + ce)[None, :]
                own = qid[:, None] == cid[None, :]
                near[own] = -np.inf
                top = np.abs(c).max(axis=1)
                if plain and _SAFE[0] < top.min() and top.max() < _SAFE[1]:
                    low, high, back = near - error, near + error, None
                else:
                    back = np.zeros(len(q), int) if plain else power
                    # Rounding at the end of the range moves a score by its least step.
                    low, high = (np.ldexp(v, back[:, None]) + step for v, step in ((near - error, -1e-322), (near + error, 1e-322)))
                    low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
                    low[own] = -np.inf
                if low.shape[1] >= k:
                    bound = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
                else:
                    bound = floor
                rows, cols = np.nonzero((high >= bound[:, None]) & ~own)
                for i in range(0, len(rows), 65536):
                    r, s = rows[i : i + 65536], cols[i : i + 65536]
                    if back is None:
                        exact = (q[r] * c[s]).sum(axis=1)
                    else:
                        up = np.frexp(top[s])[1]
                        exact = np.ldexp((q[r] * np.ldexp(c[s], -up[:, None])).sum(axis=1), back[r] + up)
                    best = _best(r, exact, cid[s], k)
                    for u, v, x in zip(r[best].tolist(), cid[s[best]].tolist(), exact[best].tolist(), strict=True):
                        item = (x, -v, next(tick))
                        if len(heaps[u]) < k:
                            heapq.heappush(heaps[u], item)
                        elif item > heaps[u][0]:
                            heapq.heapreplace(heaps[u], item)
                floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
            for u, h in enumerate(heaps):
                out_q += [int(qid[u])] * len(h)
                out_v += [-x[1] for x in h]
                out_s += [x[0] for x in h]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` candidates of largest inner product.

    Candidates are all usable rows of another id than the query's, compared with
    queries of the same number of components. Ties go to the smaller id; with
    fewer candidates all are returned. Vectors that are null, zero, or hold a null
    or non-finite component take no part on either side, nor do rows of a null id.
    A repeated candidate id keeps a place for each of its rows; a repeated query
    id is asked once, with the least of its vectors. Components may have any
    finite size; scores that round to the same double are ties. Empty tables give an empty table.
    """

    def packed(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("i"), v.alias("v")).where(F.col("i").isNotNull() & usable(F.col("v")))

    # Packed blocks carry random deal numbers, so they are written once and only read from then on.
    def blocks(df: DataFrame, name: str) -> DataFrame:
        df = materialise(df, name)
        return materialise(df.repartition(max(1, -(-df.count() // (PACKED * BLOCK)))).mapInArrow(_pack, _BLOCKS), f"{name}-blocks")

    left = blocks(packed(queries).groupBy("i").agg(F.min("v").alias("v")), "queries")
    right = blocks(packed(vectors), "candidates")
    groups, slices = (max(1, -(-df.count() // size)) for df, size in ((left, GROUP), (right, SLICE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid_l = left.withColumn("g", (F.col("part") % groups).cast("int")).withColumn("s", every(slices))
    grid_r = right.withColumn("s", (F.col("part") % slices).cast("int")).withColumn("g", every(groups))
    keys = ["g", "s", "dim"]
    found = grid_l.groupBy(*keys).cogroup(grid_r.groupBy(*keys)).applyInArrow(_tiles(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
