"""The distributed search and factor against brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetline.operators import neighbours as nb

FEATURES = ["x", "y"]


def rows(n=400, seed=1):
    """Points on a half-unit grid; a third of them are one and the same point."""
    rng = np.random.default_rng(seed)
    pts = np.column_stack([np.round(rng.normal(0, 20, n) * 2) / 2, rng.integers(0, 4, n).astype(float)])
    pts[: n // 3] = (44.0, 2.0)
    pts[-1] = (500.0, 0.0)
    return pts


def frame(spark, pts):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, x double, y double")


def order(fitted, q):
    """Fitted rows from near to far; ties by vector."""
    d2 = ((fitted - q) ** 2).sum(axis=1)
    return np.lexsort((fitted[:, 1], fitted[:, 0], d2)), d2


def brute_lof(fitted, queries, k):
    """Factors of the fitted rows (self left out) and of the queries."""
    k = max(1, min(k, len(fitted) - 1))

    def near(q, skip=None):
        idx, d2 = order(fitted, q)
        if skip is not None:
            same = [i for i in idx if i != skip]
            idx = np.array(same)
        return idx[:k], np.sqrt(d2[idx[:k]])

    own = [near(p, i) for i, p in enumerate(fitted)]
    kd = np.array([d[-1] for _, d in own])
    lrd = np.array([1 / (np.maximum(kd[i], d).mean() + 1e-10) for i, d in own])
    factor = np.array([-(lrd[i].mean() / r) for (i, _), r in zip(own, lrd)])
    new = []
    for q in queries:
        i, d = near(q)
        r = 1 / (np.maximum(kd[i], d).mean() + 1e-10)
        new.append(-(lrd[i].mean() / r))
    return factor, np.array(new)


@pytest.mark.parametrize("leaf_vectors", [4096, 12])
def test_search_is_exact_in_one_range_and_in_many(spark, leaf_vectors):
    fitted, queries = rows(400), rows(120, seed=2)
    v = nb.settle(nb.distinct_vectors(frame(spark, fitted), FEATURES))
    q = nb.distinct_vectors(frame(spark, queries), FEATURES)
    got = nb.nearest_vectors(q, v, FEATURES, 7, leaf_vectors=leaf_vectors).collect()
    points = np.unique(fitted, axis=0)
    assert len(got) == len(np.unique(queries, axis=0))
    for r in got:
        idx, d2 = order(points, np.array([r.x, r.y]))
        want = [(d2[i], *points[i]) for i in idx[:7]]
        assert [(e.d2, e.n_x, e.n_y) for e in r.near] == want


def leaves_of(spark, points, leaf_vectors):
    v = nb.settle(nb.distinct_vectors(frame(spark, points), FEATURES))
    tree = nb.build_tree(v, v, FEATURES, leaf_vectors)
    return tree, [r["count"] for r in tree.rows.where("weight is not null").groupBy("_node").count().collect()]


@pytest.mark.parametrize("leaf_vectors", [1, 3, 12])
def test_tree_is_cut_down_to_small_leaves(spark, leaf_vectors):
    tree, sizes = leaves_of(spark, rows(400), leaf_vectors)
    assert max(sizes) <= leaf_vectors and sum(sizes) == len(np.unique(rows(400), axis=0))
    assert len(tree.levels) > 2 and tree.rows.where("weight is null").count() == sum(sizes)
    cells = {r._node: r for level in tree.levels for r in level.collect()}
    for r in tree.rows.collect():
        box, node = cells[r._node], r._node
        assert box._low_x <= r.x <= box._high_x and box._low_y <= r.y <= box._high_y
        while "." in node:
            node = cells[node]._parent
            assert node in cells
    assert len(nb.build_tree(*[nb.distinct_vectors(frame(spark, rows(50)), FEATURES)] * 2, FEATURES, 4096).levels) == 1


def test_values_that_nearly_all_vectors_share(spark):
    """Quantiles that are all the greatest (or least) value still separate the rest."""
    points = np.array([(10.0, float(i)) for i in range(200)] + [(i / 10, 0.0) for i in range(5)] + [(20.0 + i, 3.0) for i in range(5)])
    assert max(leaves_of(spark, points, 8)[1]) <= 8


def test_queries_between_and_beyond_the_leaves(spark):
    """Also leaves with fewer vectors than are asked for, and none at all."""
    fitted = np.concatenate([rows(300), [(1000.0, 0.0), (1000.0, 9.0), (-4000.0, 2.0)]])
    queries = np.array([(a, b) for a in (-1e5, -50.25, 0.1, 43.9, 300.0, 999.0, 1e6) for b in (-7.0, 1.5, 1e4)])
    v = nb.settle(nb.distinct_vectors(frame(spark, fitted), FEATURES))
    q = nb.distinct_vectors(frame(spark, queries), FEATURES)
    points = np.unique(fitted, axis=0)
    got = nb.nearest_vectors(q, v, FEATURES, 3, 6).collect()
    assert len(got) == len(queries)
    for r in got:
        idx, d2 = order(points, np.array([r.x, r.y]))
        assert [(e.d2, e.n_x, e.n_y) for e in r.near] == [(d2[i], *points[i]) for i in idx[:3]]


def test_only_narrow_levels_are_broadcast(spark, monkeypatch):
    """The same neighbours when no level may go to every task."""
    v = nb.settle(nb.distinct_vectors(frame(spark, rows(400)), FEATURES))
    want = {(r.x, r.y): r.near for r in nb.nearest_vectors(v, v, FEATURES, 3, 6).collect()}
    monkeypatch.setattr(nb, "NARROW_LEVELS", 0)
    near = nb.nearest_vectors(v, v, FEATURES, 3, 6)
    assert "ResolvedHint" not in near._jdf.queryExecution().analyzed().toString()
    assert {(r.x, r.y): r.near for r in near.collect()} == want


def test_crowded_ranges_are_chunked(spark, monkeypatch):
    monkeypatch.setattr(nb, "CHUNK_QUERIES", 10)
    fitted = rows(300)
    v = nb.settle(nb.distinct_vectors(frame(spark, fitted), FEATURES))
    for size in (4096, 20):
        a = {(r.x, r.y): r.near for r in nb.nearest_vectors(v, v, FEATURES, 3, leaf_vectors=size).collect()}
        assert len(a) == v.count()
        points = np.unique(fitted, axis=0)
        for (x, y), near in a.items():
            idx, d2 = order(points, np.array([x, y]))
            assert [(e.n_x, e.n_y) for e in near] == [tuple(points[i]) for i in idx[:3]]


@pytest.mark.parametrize("k,leaf_vectors", [(5, 4096), (20, 40)])
def test_factor_equals_brute_force(spark, k, leaf_vectors):
    fitted, queries = rows(240), rows(60, seed=3)
    model = nb.fit_lof(frame(spark, fitted), FEATURES, [3, k], leaf_vectors)
    want, new = brute_lof(fitted, queries, k)
    table = {(r.x, r.y): r.factor for r in model.table.where(F.col("k") == k).collect()}
    assert np.allclose([table[tuple(p)] for p in fitted], want, rtol=1e-6)
    scored = nb.score_lof(frame(spark, queries), model, k, 0.05).orderBy("id").collect()
    assert np.allclose([r.lof_factor for r in scored], new, rtol=1e-6)
    offset = np.percentile(np.array([table[tuple(p)] for p in fitted]), 5)
    assert [r.lof_anomaly for r in scored] == [-1 if r.lof_factor < offset else 1 for r in scored]


def test_fewer_rows_than_neighbours(spark):
    fitted = np.array([[0.0, 0.0], [1.0, 0.0], [3.0, 0.0], [9.0, 1.0]])
    model = nb.fit_lof(frame(spark, fitted), FEATURES, [20])
    want, new = brute_lof(fitted, fitted, 20)
    got = {(r.x, r.y): r.factor for r in model.table.collect()}
    assert np.allclose([got[tuple(p)] for p in fitted], want, rtol=1e-6)
    scored = nb.score_lof(frame(spark, fitted), model, 20, 0.5).orderBy("id").collect()
    assert np.allclose([r.lof_factor for r in scored], new, rtol=1e-6)


def test_model_round_trip(spark, tmp_path):
    model = nb.fit_lof(frame(spark, rows(90)), FEATURES, [5, 10])
    nb.save_lof(model, str(tmp_path / "lof"))
    again = nb.load_lof(spark, str(tmp_path / "lof"))
    q = frame(spark, rows(30, seed=9))
    a, b = (nb.score_lof(q, m, 10, 0.1) for m in (model, again))
    assert a.exceptAll(b).count() == 0 and a.count() == 30


def test_vectors_searched_among_themselves_are_held_once(spark, monkeypatch):
    """One row per vector in the tree, no join to find the leaves again, neighbour rows without per-row expressions."""
    v = nb.settle(nb.distinct_vectors(frame(spark, rows(300)), FEATURES))
    trees, whole = [], nb.build_tree
    monkeypatch.setattr(nb, "build_tree", lambda *a: trees.append(whole(*a)) or trees[-1])
    near = nb.nearest_vectors(v, v, FEATURES, 3, 20)
    assert len(trees) == 1 and len(trees[0].levels) > 1 and trees[0].rows.count() == v.count() == near.count()
    other = nb.nearest_vectors(v.select(*FEATURES), v, FEATURES, 3, 20)
    assert trees[1].rows.count() == 2 * v.count()
    assert sorted(map(str, near.collect())) == sorted(map(str, other.select(*near.columns).collect()))
    plan = nb.neighbour_rows(nb.settle(near), FEATURES, [2], F.lit(300), True)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
