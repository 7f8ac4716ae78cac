"""Trees and forests grown from histograms of binned values.

Rows are packed once into blocks of bin numbers. For each level a task walks its
blocks down all trees as they are so far, and adds up counts by (tree, node,
feature, bin); only these sums are exchanged, so the shuffle does not grow with
the rows, and no row is copied or written again. Nodes are taken in groups whose
histograms fit ``HELD_VALUES``. The best split of each node, with the sums of its
two sides, is one row for the driver, which holds the trees.

Bootstrap samples have exact sizes: each tree draws as many rows of each class
as the class has, with replacement. How many of these draws fall to each writing
task follows from the multinomial law, drawn by binomials down a tree of tasks,
then to each block of a task, and a block draws its rows locally. All of it
follows from the seed, so a pass that is run again finds the same samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from random import Random

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.errors import FitFailed
from weftline.session import materialise

#: Rows of a block, and values of the histograms that a task holds.
BLOCK_ROWS, HELD_VALUES = 4096, 1 << 22
_BLOCK = "block long, n int, x binary, y binary, ids binary, c array<long>"


def quantile_cuts(df: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """For each column at most ``bins`` - 1 values at even ranks, ascending."""
    found = df.agg(*(F.percentile_approx(F.col(c).cast("double"), [i / bins for i in range(1, bins)]) for c in columns)).first()
    return [sorted(set(q or ())) for q in found]


def _pack(cuts: list[list[float]], k: int | None):
    kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16

    def run(batches):
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = np.stack([np.searchsorted(q, part.column(2 + j).to_numpy(zero_copy_only=False)) for j, q in enumerate(cuts)], 1).astype(kind)
                y = part.column(1).to_numpy(zero_copy_only=False).astype(np.int32 if k else np.float64)
                c = np.bincount(y, minlength=k) if k else np.array([len(y)])
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + at]), pa.array([len(y)], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (x, y, ids)), pa.array([c.tolist()], pa.list_(pa.int64()))], names=["block", "n", "x", "y", "ids", "c"])
                at += 1

    return run


def _rng(*place: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence(place)))


def fall_to(counts: np.ndarray, at: int, draws: int, *place: int) -> int:
    """How many of ``draws`` draws in proportion to ``counts`` fall to the one at ``at``.

    Binomials split the draws at each node on the way down a tree of the counts;
    the parts of all places add up to ``draws``.
    """
    total, lo, hi = np.concatenate(([0], np.cumsum(counts))), 0, len(counts)
    while hi - lo > 1 and draws:
        mid = (lo + hi) // 2
        left = int(_rng(*place, lo, hi).binomial(draws, (total[mid] - total[lo]) / max(1, total[hi] - total[lo])))
        lo, hi, draws = (lo, mid, left) if at < mid else (mid, hi, draws - left)
    return draws


def _with_quotas(blocks: DataFrame, trees: int, seed: int) -> DataFrame:
    """``blocks`` with ``q``: how often each tree draws from each class of the block."""
    task = F.shiftright("block", 32)
    per = blocks.select(task.alias("task"), F.posexplode("c").alias("k", "n")).groupBy("task", "k").agg(F.sum("n").alias("n")).collect()
    tasks = sorted({r.task for r in per})
    place = {t: i for i, t in enumerate(tasks)}
    counts = np.zeros((max(r.k for r in per) + 1, len(tasks)), np.int64)
    for r in per:
        counts[r.k, place[r.task]] = r.n
    sent = blocks.sparkSession.sparkContext.broadcast((place, counts))

    def run(table: pa.Table) -> pa.Table:
        place, counts = sent.value
        ids, own = np.array(table["block"].to_pylist()), np.array(table["c"].to_pylist()).T
        order = np.argsort(ids)
        at = place[int(ids[0]) >> 32]
        out = np.zeros((len(ids), trees, len(counts)), np.int64)
        for t in range(trees):
            for c in range(len(counts)):
                draws = fall_to(counts[c], at, int(counts[c].sum()), seed, 1, t, c)
                if draws:
                    n = own[c, order]
                    out[order, t, c] = _rng(seed, 2, t, c, at).multinomial(draws, n / n.sum())
        return pa.table({"block": pa.array(ids), "q": pa.array([v.tobytes() for v in out], pa.binary())})

    quotas = blocks.select("block", "c", task.alias("task")).groupBy("task").applyInArrow(run, "block long, q binary")
    return materialise(blocks.join(quotas, "block"), "bagged-blocks")


def weights(block: int, y: np.ndarray, quotas: np.ndarray | None, tree: int, k: int | None, seed: int) -> np.ndarray:
    """How often a tree has drawn each row of a block; 1 without quotas."""
    if quotas is None:
        return np.ones(len(y))
    rng, out = _rng(seed, 3, tree, block >> 32, block & 0xFFFFFFFF), np.zeros(len(y))
    for c, n in enumerate(quotas[tree].tolist()):
        if n:
            rows = np.flatnonzero(y == c) if k else np.arange(len(y))
            out += np.bincount(rows[rng.integers(0, len(rows), n)], minlength=len(y))
    return out


def _unpacked(batches, p: int, wide: bool, k: int | None, trees: int):
    """(block, bins, y, ids, quotas) of each block."""
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            x = np.frombuffer(cols["x"][i].as_py(), np.uint16 if wide else np.uint8).reshape(-1, p)
            y = np.frombuffer(cols["y"][i].as_py(), np.int32 if k else np.float64)
            q = np.frombuffer(cols["q"][i].as_py(), np.int64).reshape(trees, -1) if "q" in cols else None
            yield cols["block"][i].as_py(), x, y, np.frombuffer(cols["ids"][i].as_py(), np.int64), q


class Grown:
    """A tree as arrays by node: the feature looked at (-1 for a leaf), the last bin that goes left, and the left child; the right one follows it."""

    def __init__(self):
        self.feature, self.bin, self.left, self.depth = [-1], [0], [0], [0]

    def split(self, node: int, feature: int, last: int) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.left[node] = feature, last, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.depth.append(self.depth[node] + 1)
        return self.left[node], self.left[node] + 1


def _reach(x: np.ndarray, feature: np.ndarray, last: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row ends in."""
    node, every = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        inner = f >= 0
        node = np.where(inner, left[node] + (x[every, np.where(inner, f, 0)] > last[node]), node)
    return node


def _histograms(arrays: list, looks: list[tuple[int, int, list[int]]], p: int, bins: int, k: int | None, wide: bool, seed: int):
    """Blocks to sums (tree, node, j, x, n, ...) of the nodes and features in ``looks``."""
    names = [f"c{i}" for i in range(k)] if k else ["s", "q"]
    trees = len(arrays)

    def run(batches):
        width = len(names) if k else 3
        held = np.zeros((p, len(looks) * bins * width))
        slots = [np.full(len(a[0]), -1) for a in arrays]
        looked = np.zeros((len(looks), p), bool)
        for s, (t, node, js) in enumerate(looks):
            slots[t][node] = s
            looked[s, js] = True
        for block, x, y, _, q in _unpacked(batches, p, wide, k, trees):
            for t in sorted({t for t, _, _ in looks}):
                w = weights(block, y, q, t, k, seed)
                slot = slots[t][_reach(x, *arrays[t])]
                rows = np.flatnonzero((slot >= 0) & (w > 0))
                for j in range(p):
                    mine = rows[looked[slot[rows], j]]
                    at = (slot[mine] * bins + x[mine, j]) * width
                    if k:
                        np.add.at(held[j], at + y[mine], w[mine])
                    else:
                        np.add.at(held[j], at, w[mine])
                        np.add.at(held[j], at + 1, w[mine] * y[mine])
                        np.add.at(held[j], at + 2, w[mine] * y[mine] ** 2)
        where = np.array([(t, node) for t, node, _ in looks])
        for j in range(p):
            v = held[j].reshape(len(looks), bins, width)
            n = v.sum(2) if k else v[:, :, 0]
            s, b = np.nonzero(n)
            parts = [v[s, b, i] for i in range(width)] if k else [v[s, b, 1], v[s, b, 2]]
            yield pa.RecordBatch.from_arrays([pa.array(where[s, 0].astype(np.int32)), pa.array(where[s, 1]), pa.array(np.full(len(s), j, np.int32)), pa.array(b.astype(np.int32)), pa.array(n[s, b]), *map(pa.array, parts)], names=["tree", "node", "j", "x", "n", *names])

    return run, names


def node_splits(sums: DataFrame, names: list[str], gain: Callable[[Callable[[str], Column]], Column], min_leaf: int) -> DataFrame:
    """(tree, node, gain, j, x, left sums, total sums): each node's best split, by the lower feature and bin among equal gains; j is null without any."""
    cols = ["n", *names]
    per = sums.groupBy("tree", "node", "j", "x").agg(*(F.sum(c).alias(c) for c in cols))
    group = Window.partitionBy("tree", "node", "j")
    upto = group.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.select("tree", "node", "j", "x", *(F.sum(c).over(upto).alias(f"l_{c}") for c in cols), *(F.sum(c).over(group).alias(f"t_{c}") for c in cols))
    run = run.withColumns({f"r_{c}": F.col(f"t_{c}") - F.col(f"l_{c}") for c in cols})
    fits = (F.col("l_n") >= min_leaf) & (F.col("r_n") >= min_leaf) & (F.col("r_n") > 0)
    run = run.withColumn("gain", F.when(fits, gain(lambda s: s)))
    best = F.max_by(F.struct("gain", "j", "x", *(f"l_{c}" for c in cols), *(f"t_{c}" for c in cols)), F.struct(F.coalesce("gain", F.lit(float("-inf"))), -F.col("j"), -F.col("x")))
    return run.groupBy("tree", "node").agg(best.alias("b")).select("tree", "node", "b.*")


def grow(df: DataFrame, columns: Sequence[str], y: Column, k: int | None, gain: Callable, id_col: str | None, trees: int, m: int, cuts: list[list[float]], max_depth: int | None, min_leaf: int, done: Callable, seed: int, bag: bool) -> tuple[list[Grown], list[dict[int, list[float]]], DataFrame]:
    """(trees, sums of each tree's nodes, blocks).

    ``gain`` makes a split's gain of the names of left, right and total sums;
    ``done`` tells from a node's sums (n, ...) that it stays a leaf. With ``bag``
    each tree has a bootstrap sample of its own. Rows without a target are left
    out; a null or NaN value counts as greater than all cuts.
    """
    p, bins, wide = len(columns), max(map(len, cuts), default=0) + 1, max(map(len, cuts), default=0) >= 256
    key = F.col(f"`{id_col}`").cast("long") if id_col else F.lit(0).cast("long")
    rows = df.select(key.alias("id"), y.cast("double").alias("y"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns))).where("y is not null")
    blocks = materialise(rows.mapInArrow(_pack(cuts, k), _BLOCK), "tree-blocks")
    if blocks.isEmpty():
        raise FitFailed("there are no rows to learn from")
    if bag:
        blocks = _with_quotas(blocks, trees, seed)
    out, sums = [Grown() for _ in range(trees)], [{} for _ in range(trees)]
    spark, width = df.sparkSession, (k or 2) + 1
    open_ = [(t, 0) for t in range(trees)]
    schema = "tree int, node long, j int, x int, n double, " + ", ".join(f"c{i} double" for i in range(k)) if k else "tree int, node long, j int, x int, n double, s double, q double"
    share = max(1, HELD_VALUES // (p * bins * width))
    while open_:
        arrays = [(np.array(g.feature), np.array(g.bin), np.array(g.left), max(g.depth) + 1) for g in out]
        sent, nxt = spark.sparkContext.broadcast(arrays), []
        for lo in range(0, len(open_), share):
            looks = [(t, node, sorted(Random(f"{seed}/{(t, node)}").sample(range(p), min(m, p)))) for t, node in open_[lo : lo + share]]
            names = _histograms(arrays, [], p, bins, k, wide, seed)[1]
            run = lambda b, looks=looks, sent=sent: _histograms(sent.value, looks, p, bins, k, wide, seed)[0](b)
            for r in node_splits(blocks.mapInArrow(run, schema), names, gain, min_leaf).collect():
                own = sums[r.tree].setdefault(r.node, [r[f"t_{c}"] for c in ("n", *names)])
                if r.gain is None or not r.gain > 1e-12 or done(own) or max_depth is not None and out[r.tree].depth[r.node] >= max_depth:
                    continue
                left, right = out[r.tree].split(r.node, r.j, r.x)
                a = [r[f"l_{c}"] for c in ("n", *names)]
                sums[r.tree][left], sums[r.tree][right] = a, [t - v for t, v in zip(own, a, strict=True)]
                nxt += [(r.tree, c) for c in (left, right) if not done(sums[r.tree][c]) and (max_depth is None or out[r.tree].depth[c] < max_depth)]
        open_ = sorted(nxt)
    return out, sums, blocks


def bags(blocks: DataFrame, p: int, cuts: list[list[float]], k: int | None, trees: int, seed: int) -> DataFrame:
    """(id, w): how often each tree has drawn each row."""
    wide = max(map(len, cuts), default=0) >= 256

    def run(batches):
        for block, _, y, ids, q in _unpacked(batches, p, wide, k, trees):
            w = np.stack([weights(block, y, q, t, k, seed) for t in range(trees)], 1).astype(np.int32)
            ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * trees)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["id", "w"])

    return blocks.mapInArrow(run, "id long, w array<int>")
