from itertools import combinations

import numpy as np
import pytest
from awkward_rows import rows_of
from pyspark.sql import functions as F
from vetline.llm import hard_negatives as hard

VECTORS = "vec_id long, embedding array<float>, label int"
LIMIT = (1 << 63) - 1


def brute(rows, every=100):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        w = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, w))
    out = []
    for at, (a, label, v) in enumerate(kept):
        if a % every:
            continue
        scores = [max(-LIMIT - 1, min(LIMIT, sum(x * y for x, y in zip(v, w)))) for _, _, w in kept]
        same = sorted((-scores[j], kept[j][0]) for j in range(len(kept)) if j != at and kept[j][1] == label)
        other = sorted((-scores[j], kept[j][0]) for j in range(len(kept)) if kept[j][1] != label)
        for s, p in same[:5]:
            fits = [(n, i) for n, i in other if 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fits[:10])]
    return sorted(out, key=repr)


def found(df, every=100, **kw):
    return rows_of(hard.mine(hard.labelled(df), F.col("vec_id") % every == 0, **kw))


def clustered(n, seed, noise=0.3, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    vectors = centres[rng.integers(6, size=n)] + rng.normal(size=(n, width)) * noise
    return [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(10))) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("sizes", [{}, {"cell": 64, "block": 4}])
def test_random_vectors(spark, sizes):
    rows = clustered(900, 1)
    want = brute(rows, 10)
    assert len(want) > 1000
    assert found(spark.createDataFrame(rows, VECTORS), 10, **sizes) == want


def test_ties_and_one_vector_everywhere(spark):
    rows = [(i, [0.5, -0.25, 1.0] if i % 3 else [0.5, 0.0, 0.25 * (i % 5)], i % 4) for i in range(310)]
    assert found(spark.createDataFrame(rows, VECTORS), 10, cell=50, block=8) == brute(rows, 10)


def test_scores_that_are_not_positive(spark):
    """A window of a negative positive is empty; that of a zero one holds zeros only."""
    rows = [(0, [1.0, 0.0], 1), (100, [-1.0, 0.0], 2), (1, [-1.0, 0.5], 1), (2, [0.0, 1.0], 2), (3, [0.0, 3.0], 1),
            (4, [0.0, -3.0], 3), (5, [0.5, 0.5], 2), (6, [-2.0, 0.5], 2)]
    got = found(spark.createDataFrame(rows, VECTORS))
    assert got == brute(rows) and any(g[4] == 0 for g in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (100, [2.0, 1.0], 1), (100, [2.0, 1.0], 1), (100, [1.0, 1.0], 2), (200, None, 1), (300, [nan, 1.0], 1),
        (400, [1.0, inf], 1), (500, [None, 1.0], 1), (None, [1.0, 1.0], 1), (600, [1.0, 1.0], None), (1, [], 1), (2, [5.0], 0),
        (3, [1.0, 0.5, 3.0], 2), (-100, [1.0, 2.5], 3), (7, [0.5, 0.5], 9), (8, [0.7, 0.7], 0), (9, [0.25, 0.5], 2),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    want = brute(rows)
    assert found(df) == want and len(want) > 10
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("cell", "block", "score", "row", "vector", "rank", "position")])
    assert found(extra) == want
    assert found(df.limit(0)) == [] == found(df.where("vec_id % 100 <> 0")) == found(df.where("vec_id = 100 and label = 1"))


@pytest.mark.parametrize("size", [1e5, 1e8, 1e15])
def test_large_numbers(spark, size):
    """Beyond what doubles hold, and beyond a long, where scores saturate."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.uniform(0.1, 1, size=5) * size).astype(np.float32).tolist(), i % 3) for i in range(120)]
    got, want = found(spark.createDataFrame(rows, VECTORS), 20), brute(rows, 20)
    if size < 1e9:
        assert got == want
    else:
        assert {(g[0], g[4], g[5]) for g in got} <= {(w[0], LIMIT, w[5]) for w in want}


def test_spanning_tree():
    points = np.random.default_rng(5).normal(size=(60, 4))
    points[40:] = points[:20]
    order, parent, edge = hard.spanning_tree(points)
    seen = {int(order[0])}
    for at in order[1:]:
        assert parent[at] in seen and np.isclose(edge[at], np.linalg.norm(points[at] - points[parent[at]]))
        seen.add(int(at))
    root = list(range(60))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for length, i, j in sorted((np.linalg.norm(points[i] - points[j]), i, j) for i, j in combinations(range(60), 2)):
        if top(i) != top(j):
            root[top(i)] = top(j)
            total += length
    assert np.isclose(edge.sum(), total)


def test_candidates_outside_the_window_are_not_scored():
    """Tight groups of anchors: after the first of a group only candidates near the window are scored, all that fit."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 16)) * 300
    rows = (centres[np.arange(2000) % 4] + rng.normal(size=(2000, 16)) * 5).astype(np.int64)
    table = pa.table({"vec_id": np.arange(2000), "row": np.arange(2000), "label": np.arange(2000) % 3, "vector": rows.tolist()})
    cell, anchors = hard.Cell(table, 16), rows[::40]
    walk = hard.Walk(cell, anchors, *hard.spanning_tree(anchors.astype(float)))
    for step, at in enumerate(walk.order):
        true = rows @ anchors[at]
        least, most = int(0.3 * true.max()), int(0.8 * true.max())
        places, scores = walk.meet(int(at), step, least, most)
        assert scores.astype(np.int64).tolist() == true[places].tolist()
        assert set(np.flatnonzero((true >= least) & (true <= most))) <= set(places)
    assert walk.scored < 0.5 * len(rows) * len(anchors) and not walk.held
