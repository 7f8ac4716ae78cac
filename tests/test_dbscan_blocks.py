"""Density clustering without a table of pairs, against brute force."""

import numpy as np
import pytest

from weftline.functions import distance
from weftline.operators import cluster, metric, pairs


def plain(rows, eps, least):
    """({id: cluster}, {id: prediction}) of rows (id, vector) with single ids."""
    good = [i for i, (k, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    near = {i: [j for j in good if np.sqrt(sum((a - b) ** 2 for a, b in zip(rows[i][1], rows[j][1], strict=True))) <= eps] for i in good}
    ids = {i: rows[i][0] for i in good if rows[i][0] is not None}
    core = {i for i in ids if len(near[i]) >= least}
    root = {}
    for i in sorted(core, key=ids.get):
        todo = [] if i in root else [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = ids[i]
                todo += [k for k in near[j] if k in core]
    for i in ids.keys() - core:
        found = [root[j] for j in near[i] if j in core]
        if found:
            root[i] = min(found)
    number = {r: n for n, r in enumerate(sorted(set(root.values())))}
    label = {i: number[root[i]] if i in root else -1 for i in ids}
    votes = {}
    for i in ids:
        of = [label[j] for j in near[i] if j in ids]
        votes[ids[i]] = max(sorted(set(of), key=lambda c: (c < 0, c)), key=of.count) + 1
    own = {k: -1 for k, _ in rows if k is not None}
    return own | {ids[i]: c for i, c in label.items()}, {k: 0 for k in own} | votes


@pytest.mark.parametrize("how", ["balls", "pairs", "auto"])
def test_clusters_come_without_a_table_of_pairs(spark, monkeypatch, how):
    def refuse(*_, **__):
        raise AssertionError("pairs within the radius are written")

    monkeypatch.setattr(cluster, "radius", refuse)
    monkeypatch.setattr(metric.Balls, "candidates", refuse)
    monkeypatch.setattr(pairs, "chosen", refuse)
    monkeypatch.setattr(cluster, "_VOTED", 2)
    monkeypatch.setattr(pairs.chunks, "__defaults__", (20,))
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 12, (170, 2)), 1).tolist()
    x += x[:40] + [x[0]] * 50 + [[40.0, 40.0]] * 3 + [[60.0 + 0.5 * i, 0.0] for i in range(60)]
    ids = rng.permutation(len(x)).tolist()
    rows = [*zip(ids, x, strict=True), (1001, None), (1002, [None, 1.0]), (1003, [float("nan"), 1.0]), (1004, [float("inf"), 1.0]), (None, [40.0, 40.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>").repartition(3)
    m = cluster.dbscan(df, 0.6, 4, how=how)
    labels, votes = plain(rows, 0.6, 4)
    got = m.labels.collect()
    assert len(got) == len(rows) and [r.cluster for r in got if r.id is None] == [-1]
    assert {r.id: r.cluster for r in got if r.id is not None} == labels and max(labels.values()) > 5 and -1 in labels.values()
    assert {r.query_id: r.prediction for r in m.predict(df).collect() if r.query_id is not None} == votes
    assert cluster.dbscan(df.limit(0), 0.6, 4, how=how).labels.count() == 0


def test_copies_are_compared_once_and_links_stay_few(spark, monkeypatch):
    rows = [(i, [float(i % 3), 0.0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    kept = {}
    own = cluster.materialise
    monkeypatch.setattr(cluster, "materialise", lambda t, name, **o: kept.setdefault(name, []).append(out := own(t, name, **o)) or out)
    monkeypatch.setattr(cluster, "discard", lambda *_: None)
    m = cluster.dbscan(df, 0.5, 4)
    assert {(int(r.features[0]), r.cluster) for r in m.labels.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert {r.prediction for r in m.predict(df.where("id % 3 = 1")).collect()} == {2}
    assert "near" not in kept and max(t.count() for name, ts in kept.items() if name not in ("members", "rooted") for t in ts) == 3


def test_ids_that_occur_twice_are_one_row(spark):
    rows = [(1, [0.0]), (1, [10.0]), (2, [0.1]), (3, [10.1]), (4, [20.0]), (4, [20.5]), (5, [20.6])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    blocks = cluster.dbscan(df, 0.3, 2).labels
    by_pairs = cluster.dbscan(df, 0.3, 2, distance=lambda a, b: distance.euclidian(a, b)).labels
    assert sorted((r.id, r.cluster) for r in blocks.collect()) == sorted((r.id, r.cluster) for r in by_pairs.collect())


def test_vectors_that_hold_nan_may_be_near_by_hamming(spark):
    df = spark.createDataFrame([(i, [float("nan"), float(i % 2)]) for i in range(8)], "id long, features array<double>")
    assert [r.cluster for r in cluster.dbscan(df, 0.1, 3, distance=distance.hamming).labels.orderBy("id").collect()] == [0, 1] * 4


def test_stars_join_what_pairs_join():
    rng = np.random.default_rng(4)
    near = rng.random((40, 30)) < 0.02
    a, b = pairs.stars(near, np.arange(100, 130), np.arange(40))
    label = {i: i for i in [*range(40), *range(100, 130)]}
    edges = [(i, j + 100) for i, j in zip(*np.nonzero(near), strict=True)]
    for _ in range(70):
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    want = {i: c for i, c in label.items() if i != c}
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)
