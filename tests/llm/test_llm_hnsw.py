import numpy as np
import pytest
from awkward_rows import rows_of
from pyspark.sql import functions as F
from vetline.llm import hnsw

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k=20):
    """Rows as in the result; every row is its own, whatever its id."""
    kept = []
    for i, v in rows:
        if i is None or v is None or not any(v) or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        kept.append((i, np.array(v, np.float32).astype(float)))
    out = []
    for at, (q, a) in enumerate(kept):
        if q % 20 == 0:
            n = [min(len(a), len(b)) for _, b in kept]
            scores = sorted((-float((a[:m] * b[:m]).sum()), i) for j, ((i, b), m) in enumerate(zip(kept, n)) if j != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def found(df, **kw):
    return rows_of(hnsw.nearest(df, F.col("vec_id") % 20 == 0, **kw))


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, width))
    made = centres[rng.integers(10, size=n)] + rng.normal(size=(n, width)) * 0.4
    return (made * rng.uniform(0.5, 2, size=(n, 1))).astype(np.float32)


def test_recall_over_shards(spark):
    """Vectors of different lengths in several shards and blocks; recall against all products."""
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(3000, 24, 1))]
    got, want = found(spark.createDataFrame(rows, VECTORS), shard=700, block=40), brute(rows)
    assert len(got) == len(want)
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.97 * len(want)
    score = {w[::2]: w[3] for w in want}
    assert all(np.isclose(g[3], score[g[::2]], rtol=1e-12) for g in got if g[::2] in score)


def test_graph_links():
    """Links stay within their layer and are never too many; a stored graph finds the same."""
    shard = hnsw.Shard(clustered(1500, 16, 2).astype(float))
    assert [len(layer.nodes) for layer in shard.layers] == sorted((len(layer.nodes) for layer in shard.layers), reverse=True)
    assert len(shard.layers) > 1
    for layer in shard.layers:
        own = layer.links[layer.nodes]
        assert set(own[own >= 0].tolist()) <= set(layer.nodes.tolist())
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() and n not in r for n, r in zip(layer.nodes, own))
    again = hnsw.Shard(shard.vectors, shard.layers)
    for (a, s), (b, t) in zip(shard.search(shard.vectors[:50], 10), again.search(shard.vectors[:50], 10)):
        assert a.tolist() == b.tolist() and s.tolist() == t.tolist()


@pytest.mark.parametrize("shard", [8, 8192])
def test_small_tables_are_exact(spark, shard):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(90, 6, 3))]
    same(found(spark.createDataFrame(rows, VECTORS), shard=shard), brute(rows))


def test_one_vector_almost_everywhere(spark):
    rows = [(i, [0.5, -0.25, 1.0] if i % 3 else [0.5, float(i), 0.0]) for i in range(300)]
    same(found(spark.createDataFrame(rows, VECTORS)), brute(rows))
    rows = [(i, [1.0, 2.0]) for i in range(100)]
    same(found(spark.createDataFrame(rows, VECTORS)), brute(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [0.0, 0.0]), (20, [3.0, 1.0]), (20, [3.0, 1.0]), (20, [1.0, 1.0]), (40, None), (60, [nan, 1.0]),
        (80, [1.0, inf]), (100, [None, 1.0]), (None, [1.0, 1.0]), (1, []), (2, [5.0]), (3, [1.0, 2.0, 3.0]), (-20, [-1.0, -2.0]),
        (4, [1e-30, -1e-30]), (5, [1e30, 1e30]),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    same(found(df), brute(rows))
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("shard", "block", "score", "rank", "vector", "k1", "ids", "place")])
    same(found(extra), brute(rows))
    assert found(df.limit(0)) == []
    assert found(df.where("vec_id = 0")) == []
    assert found(df.where("vec_id = 20 and embedding[0] = 0")) == []
