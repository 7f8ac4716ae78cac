"""Decision trees and forests.

With ``bins`` or ``cuts``, and for all forests, trees are grown from histograms
of binned values (``operators/histograms.py``); this is the way for large tables.
Without, a single tree tries every boundary between two values: it is grown a
level at a time by group-bys, all open nodes in one job, with counts for each
(node, feature, value), running sums in value order, and the best threshold of
each feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import floor, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from weftline.errors import FitFailed
from weftline.frame import small
from weftline.operators import histograms
from weftline.session import materialise

#: Bins of a forest's values unless told otherwise.
FOREST_BINS = 64
#: Nodes of a forest that are literals of a plan; a larger one goes to the tasks as arrays.
PLAN_NODES = 2000
#: Levels of a tree, as node numbers double with each; a tree without ``max_depth`` that needs more is an error.
MAX_LEVELS = 60


@dataclass
class Node:
    value: object
    n: float
    impurity: float
    feature: int = -1
    threshold: float = 0.0
    gain: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Forest:
    """Trees over the columns; a classifier has ``classes``."""

    columns: tuple[str, ...]
    trees: list[Node]
    classes: tuple | None = None
    #: (id, w) of a forest: how often each tree has drawn each row.
    bags: DataFrame | None = field(default=None, repr=False)

    def _value(self, node: Node) -> Column:
        if node.left is None:
            return F.lit(node.value)
        x = F.col(self.columns[node.feature]).cast("double")
        return F.when(x <= node.threshold, self._value(node.left)).otherwise(self._value(node.right))

    def _vote(self, votes: Column) -> Column:
        """Of an array of tree results (nulls do not vote) the commonest, first among equals, or the mean."""
        cast = F.filter(votes, lambda v: v.isNotNull())
        if self.classes is None:
            return F.try_divide(F.aggregate(cast, F.lit(0.0), lambda a, v: a + v), F.size(cast).cast("double"))

        def votes_for(i: int) -> Column:
            return F.size(F.filter(cast, lambda v: v == i))

        count = F.array(*map(votes_for, range(len(self.classes))))
        best = F.array_position(count, F.array_max(count)).cast("int")
        return F.when(F.size(cast) > 0, F.element_at(F.array(*(F.lit(c) for c in self.classes)), best))

    def _nodes(self) -> list[tuple[np.ndarray, ...]]:
        """Each tree as arrays by node: column (-1 for a leaf), threshold, left child, value; the right child follows the left."""
        out = []
        for root in self.trees:
            nodes, left, at = [root], [], 0
            while at < len(nodes):
                n = nodes[at]
                left.append(len(nodes) if n.left is not None else 0)
                nodes += [n.left, n.right] if n.left is not None else []
                at += 1
            out.append((np.array([n.feature if n.left is not None else -1 for n in nodes]), np.array([n.threshold for n in nodes]), np.array(left), np.array([float(n.value) for n in nodes])))
        return out

    def _results(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__votes``, the result of each tree."""
        if sum(map(_size, self.trees)) <= PLAN_NODES:
            return df.withColumn("__votes", F.array(*(self._value(t) for t in self.trees)))
        sent, p, of = df.sparkSession.sparkContext.broadcast((self._nodes(), self.depth)), len(self.columns), len(df.columns)

        def run(batches):
            nodes, depth = sent.value
            for b in batches:
                x = np.stack([b.column(of + j).to_numpy(zero_copy_only=False) for j in range(p)], 1)
                every, votes = np.arange(len(x)), []
                for feature, threshold, left, value in nodes:
                    node = np.zeros(len(x), np.int64)
                    for _ in range(depth):
                        f = feature[node]
                        inner = f >= 0
                        node = np.where(inner, left[node] + ~(x[every, np.where(inner, f, 0)] <= threshold[node]), node)
                    votes.append(value[node])
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(nodes))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(of)), pa.ListArray.from_arrays(ends, pa.array(np.stack(votes, 1).ravel()))], names=[*b.schema.names[:of], "__votes"])

        wide = df.select(*df.columns, *(F.col(c).cast("double").alias(f"__x{j}") for j, c in enumerate(self.columns)))
        found = wide.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__votes", T.ArrayType(T.DoubleType()))]))
        return found if self.classes is None else found.withColumn("__votes", F.col("__votes").cast("array<int>"))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the forest's result in ``name``; a null value goes to the right at each split."""
        return self._results(df).withColumn(name, self._vote(F.col("__votes"))).drop("__votes")

    def predict_oob(self, df: DataFrame, id_col: str, name: str = "prediction") -> DataFrame:
        """Votes of the trees whose sample left a row out; null where none did, or for a row that was not learnt from."""
        if self.bags is None:
            raise FitFailed("a single tree has no samples")
        own = self.bags.select(F.col("id").alias("__bag"), F.col("w").alias("__w"))
        rows = self._results(df).join(own, F.col(id_col).cast("long") == F.col("__bag"), "left")
        left_out = F.zip_with("__votes", "__w", lambda v, w: F.when(w == 0, v))
        return rows.withColumn(name, self._vote(F.coalesce(left_out, F.array().cast("array<double>")))).drop("__votes", "__bag", "__w")

    @property
    def depth(self) -> int:
        def deep(n: Node) -> int:
            return 0 if n.left is None else 1 + max(deep(n.left), deep(n.right))

        return max(map(deep, self.trees))

    def feature_importances(self, normalize: bool = False) -> list[float]:
        """Weighted decrease of impurity for each column, over all trees."""
        out = [0.0] * len(self.columns)

        def add(n: Node, root: float) -> None:
            if n.left is not None:
                out[n.feature] += (n.n * n.impurity - n.left.n * n.left.impurity - n.right.n * n.right.impurity) / (1 if normalize else root)
                add(n.left, root)
                add(n.right, root)

        for t in self.trees:
            add(t, t.n)
        total = sum(out)
        return [v / total if normalize and total else v for v in out]


def _size(n: Node) -> int:
    return 1 if n.left is None else 1 + _size(n.left) + _size(n.right)


def _impurity(counts: list[Column], n: Column, criterion: str) -> Column:
    shares = [F.try_divide(c, n) for c in counts]
    if criterion == "gini":
        return 1 - sum((s * s for s in shares[1:]), shares[0] * shares[0])
    if criterion == "entropy":
        terms = [F.when(s > 0, s * F.log2(s)).otherwise(0.0) for s in shares]
        return -sum(terms[1:], terms[0])
    if criterion == "classification_error":
        return 1 - F.greatest(*shares) if len(shares) > 1 else 1 - shares[0]
    raise FitFailed(f"unknown criterion {criterion}")


def impurity(shares: Sequence[float], criterion: str) -> float:
    """The same of numbers."""
    if criterion == "gini":
        return 1 - sum(s * s for s in shares)
    if criterion == "entropy":
        return -sum(s * log2(s) for s in shares if s > 0)
    return 1 - max(shares)


def best_splits(rows: DataFrame, k: int | None, criterion: str = "gini", min_leaf: int = 1, midpoints: bool = True) -> DataFrame:
    """(tree, node, j, gain, threshold): each feature's best split of each node.

    ``rows`` are (tree, node, w, y, v), and maybe js, the features that the node
    looks at; with ``k`` classes y is a class number, else the target. Among equal gains the lowest threshold stands; it lies
    halfway between two values, or without ``midpoints`` on the lower one.
    """
    each = F.posexplode("v").alias("j", "x") if "js" not in rows.columns else F.inline(F.transform("js", lambda j: F.struct(j.alias("j"), F.element_at("v", j + 1).alias("x"))))
    cells = rows.select("tree", "node", "w", "y", each)
    names = [f"c{i}" for i in range(k)] if k else ["s", "q"]
    sums = [F.sum(F.when(F.col("y") == i, F.col("w")).otherwise(0.0)).alias(f"c{i}") for i in range(k)] if k else [F.sum(F.col("w") * F.col("y")).alias("s"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("q")]
    per = cells.groupBy("tree", "node", "j", "x").agg(F.sum("w").alias("n"), *sums)
    group = Window.partitionBy("tree", "node", "j")
    upto = group.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = ["n", *names]
    run = per.select("tree", "node", "j", "x", F.lead("x").over(group.orderBy("x")).alias("next"), *(F.sum(c).over(upto).alias(f"l_{c}") for c in cols), *(F.sum(c).over(group).alias(f"t_{c}") for c in cols))
    run = run.where("next is not null").withColumns({f"r_{c}": F.col(f"t_{c}") - F.col(f"l_{c}") for c in cols})
    if k:
        part = lambda s: _impurity([F.col(f"{s}_{c}") for c in names], F.col(f"{s}_n"), criterion)
        gain = part("t") - F.col("l_n") / F.col("t_n") * part("l") - F.col("r_n") / F.col("t_n") * part("r")
    else:
        power = lambda s: F.col(f"{s}_s") * F.col(f"{s}_s") / F.col(f"{s}_n")
        gain = power("l") + power("r") - power("t")
    run = run.where((F.col("l_n") >= min_leaf) & (F.col("r_n") >= min_leaf)).withColumn("gain", gain)
    best = F.max_by(F.struct("gain", ((F.col("x") + F.col("next")) / 2 if midpoints else F.col("x")).alias("threshold")), F.struct("gain", -F.col("x")))
    return run.groupBy("tree", "node", "j").agg(best.alias("b")).select("tree", "node", "j", "b.gain", "b.threshold")


def _grow(df: DataFrame, columns: Sequence[str], y: Column, k: int | None, classes, max_depth: int | None, min_leaf: int, min_split: int, criterion: str) -> Forest:
    """One tree with exact thresholds."""
    v = [F.col(c).cast("double") for c in columns]
    rows = materialise(df.select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("node"), F.lit(1.0).alias("w"), y.alias("y"), F.array(*v).alias("v")), "tree-rows")
    open_: dict[tuple[int, int], Node] = {}
    roots: dict[int, Node] = {}
    depth = min(max_depth or MAX_LEVELS, MAX_LEVELS)
    for level in range(depth + 1):
        sums = [F.sum(F.when(F.col("y") == i, F.col("w")).otherwise(0.0)) for i in range(k)] if k else [F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("y") * F.col("y"))]
        state = rows.groupBy("tree", "node").agg(F.sum("w"), *sums).collect()
        level_nodes: dict[tuple[int, int], Node] = {}
        live = set()
        for t, node, n, *c in state:
            if k:
                value = max(range(k), key=lambda i: (c[i], -i))
                imp = impurity([x / n for x in c], criterion)
                pure = max(c) == n
                small_node = n <= min_split
            else:
                value, imp = c[0] / n, max(c[1] / n - (c[0] / n) ** 2, 0.0)
                pure, small_node = imp <= 1e-14 * max(1.0, (c[0] / n) ** 2), n < min_split
            got = level_nodes[(t, node)] = Node(value, n, imp)
            if level == 0:
                roots[t] = got
            else:
                parent = open_[(t, node // 2)]
                if node % 2 == 0:
                    parent.left = got
                else:
                    parent.right = got
            if not pure and not small_node:
                live.add((t, node))
        if level == depth and live and max_depth is None:
            raise FitFailed(f"the tree needs more than {MAX_LEVELS} levels; set max_depth")
        if level == depth or not live:
            break
        wanted = small(df.sparkSession.createDataFrame(sorted(live), "tree int, node long"))
        found: dict[tuple[int, int], tuple] = {}
        for r in best_splits(rows.join(wanted, ["tree", "node"]), k, criterion, min_leaf).collect():
            key = (r.tree, r.node)
            if r.gain > 1e-12 and (key not in found or (r.gain, -r.j) > (found[key][0], -found[key][1])):
                found[key] = (r.gain, r.j, r.threshold)
        if not found:
            break
        for key, (g, j, thr) in found.items():
            level_nodes[key].feature, level_nodes[key].threshold, level_nodes[key].gain = j, thr, g
        split = small(df.sparkSession.createDataFrame([(t, n, j, thr) for (t, n), (_, j, thr) in found.items()], "tree int, node long, j int, thr double"))
        child = F.col("node") * 2 + F.when(F.col("v")[F.col("j")] <= F.col("thr"), 0).otherwise(1)
        rows = materialise(rows.join(split, ["tree", "node"]).select("tree", child.alias("node"), "w", "y", "v"), "tree-rows")
        open_ = level_nodes
    for t in list(roots):
        _prune_half(roots[t])
    return Forest(tuple(columns), [roots[t] for t in sorted(roots)], classes)


def _prune_half(n: Node) -> None:
    if n.left is None or n.right is None:
        n.left = n.right = None
    else:
        _prune_half(n.left)
        _prune_half(n.right)


def _classes(df: DataFrame, label: str) -> tuple:
    classes = tuple(sorted(r[0] for r in df.select(label).distinct().limit(1001).collect()))
    if not 2 <= len(classes) <= 1000:
        raise FitFailed(f"two classes are needed, the labels have {len(classes)}")
    return classes


def _number(label: str, classes: tuple) -> Column:
    return (F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(label)) - 1).cast("int")


def _from_histograms(df: DataFrame, columns: Sequence[str], y: Column, k: int | None, classes, id_col: str | None, trees: int, m: int, bins: int | None, cuts: Sequence[Sequence[float]] | None, max_depth: int | None, min_leaf: int, min_split: int, criterion: str, seed: int, bag: bool) -> Forest:
    cuts = [sorted(set(map(float, c))) for c in cuts] if cuts is not None else histograms.quantile_cuts(df, columns, bins or FOREST_BINS)
    if len(cuts) != len(columns):
        raise FitFailed(f"{len(columns)} columns need as many lists of cuts, not {len(cuts)}")

    def gain(_) -> Column:
        if k:
            part = lambda s: _impurity([F.col(f"{s}_c{i}") for i in range(k)], F.col(f"{s}_n"), criterion)
            return part("t") - F.col("l_n") / F.col("t_n") * part("l") - F.col("r_n") / F.col("t_n") * part("r")
        power = lambda s: F.try_divide(F.col(f"{s}_s") * F.col(f"{s}_s"), F.col(f"{s}_n"))
        return power("l") + power("r") - power("t")

    def told(sums: list[float]) -> tuple[object, float, bool]:
        """The value of a node, its impurity, and whether it stays a leaf."""
        n, *c = sums
        if k:
            return max(range(k), key=lambda i: (c[i], -i)), impurity([x / n for x in c], criterion), max(c) == n or n <= min_split
        mean = c[0] / n
        spread = max(c[1] / n - mean**2, 0.0)
        return mean, spread, spread <= 1e-14 * max(1.0, mean**2) or n < min_split

    grown, sums, blocks = histograms.grow(df, columns, y, k, gain, id_col, trees, m, cuts, max_depth, min_leaf, lambda s: told(s)[2], seed, bag)

    def node(t: int, i: int) -> Node:
        value, spread, _ = told(sums[t][i])
        out, g = Node(value, sums[t][i][0], spread), grown[t]
        if g.feature[i] >= 0:
            out.feature, out.threshold = g.feature[i], cuts[g.feature[i]][g.bin[i]]
            out.left, out.right = node(t, g.left[i]), node(t, g.left[i] + 1)
        return out

    of = histograms.bags(blocks, len(columns), cuts, k, trees, seed) if bag else None
    return Forest(tuple(columns), [node(t, 0) for t in range(trees)], classes, of)


def decision_tree_classifier(df: DataFrame, columns: Sequence[str], label: str, criterion: str = "gini", max_depth: int | None = None, min_samples_leaf: int = 1, min_samples_split: int = 2, bins: int | None = None, cuts: Sequence[Sequence[float]] | None = None) -> Forest:
    """A tree; thresholds are any, with ``bins`` quantiles, with ``cuts`` of each column's own."""
    classes = _classes(df, label)
    if bins or cuts is not None:
        return _from_histograms(df, columns, _number(label, classes), len(classes), classes, None, 1, len(columns), bins, cuts, max_depth, min_samples_leaf, min_samples_split, criterion, 0, False)
    return _grow(df, columns, _number(label, classes), len(classes), classes, max_depth, min_samples_leaf, min_samples_split, criterion)


def decision_tree_regressor(df: DataFrame, columns: Sequence[str], target: str, max_depth: int | None = None, min_samples_leaf: int = 1, min_samples_split: int = 2, bins: int | None = None, cuts: Sequence[Sequence[float]] | None = None) -> Forest:
    if bins or cuts is not None:
        return _from_histograms(df, columns, F.col(target), None, None, None, 1, len(columns), bins, cuts, max_depth, min_samples_leaf, min_samples_split, "", 0, False)
    return _grow(df, columns, F.col(target).cast("double"), None, None, max_depth, min_samples_leaf, min_samples_split, "")


def random_forest_classifier(df: DataFrame, columns: Sequence[str], label: str, id_col: str, n_trees: int = 100, m: int | None = None, criterion: str = "gini", max_depth: int | None = None, min_samples_leaf: int = 1, min_samples_split: int = 2, seed: int = 0, bins: int | None = None, cuts: Sequence[Sequence[float]] | None = None) -> Forest:
    """Trees on bootstrap samples that draw as many rows of each class as there are; each node looks at ``m`` columns, floor(sqrt(p)) by default."""
    classes = _classes(df, label)
    return _from_histograms(df, columns, _number(label, classes), len(classes), classes, id_col, n_trees, m or floor(sqrt(len(columns))), bins, cuts, max_depth, min_samples_leaf, min_samples_split, criterion, seed, True)


def random_forest_regressor(df: DataFrame, columns: Sequence[str], target: str, id_col: str, n_trees: int = 10, m: int | None = None, max_depth: int | None = None, min_samples_leaf: int = 1, min_samples_split: int = 2, seed: int = 0, bins: int | None = None, cuts: Sequence[Sequence[float]] | None = None) -> Forest:
    return _from_histograms(df, columns, F.col(target), None, None, id_col, n_trees, m or floor(sqrt(len(columns))), bins, cuts, max_depth, min_samples_leaf, min_samples_split, "", seed, True)
