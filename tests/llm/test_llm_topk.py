import duckdb
import numpy as np
import pytest
from awkward_rows import rows_of
from pyspark.sql import functions as F
from vetline.llm import topk

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    """Every row is its own, whatever its id."""
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        kept.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for at, (q, a) in enumerate(kept):
        if q % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for j, (i, b) in enumerate(kept) if j != at)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def found(df, **kw):
    return rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0, **kw))


@pytest.mark.parametrize("sizes", [{}, {"cell": 16, "block": 2}])
def test_random_vectors(spark, sizes):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 24))
    rows = [(i, (centres[i % 5] + rng.normal(size=24) * 0.2).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, VECTORS)
    assert found(df, **sizes) == brute(rows)


def test_ties_and_one_vector_everywhere(spark):
    rows = [(i, [0.5, -0.25, 1.0] if i % 3 else [0.5, 0.0, 0.0]) for i in range(160)]
    assert found(spark.createDataFrame(rows, VECTORS), cell=20) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [0.0, 0.0]), (50, [0.0, 0.0]), (50, [3.0, 1.0]), (100, None), (150, [nan, 1.0]), (200, [1.0, inf]),
        (250, [None, 1.0]), (None, [1.0, 1.0]), (1, []), (2, [5.0]), (3, [1.0, 2.0, 3.0]), (-50, [-1.0, -2.0]), (4, [1e-9, -1e-9]),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    assert found(df) == brute(rows)
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("cell", "block", "score", "rank", "vector", "query_id")])
    assert found(extra) == brute(rows)
    assert found(df.limit(0)) == []
    assert found(df.where("vec_id = 0")) == []


def test_rows_that_share_an_id_and_the_sql(spark, tmp_path):
    """The second row of an id is a candidate and a query of its own, in the check SQL too."""
    rng = np.random.default_rng(3)
    rows = [(i // 2 * 5, rng.normal(size=4).astype(np.float32).tolist()) for i in range(80)] + [(50, [0.5, 0.5, 0.5, 0.5])] * 3
    df = spark.createDataFrame(rows, VECTORS)
    want = brute(rows)
    assert found(df) == want and found(df, cell=8, block=2) == want
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted(con.execute(topk.ORACLE).fetchall(), key=repr) == want


def test_large_numbers(spark):
    """Sums that doubles cannot hold stay exact; beyond a long they saturate."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=6) * 1e6).astype(np.float32).tolist()) for i in range(60)]
    assert found(spark.createDataFrame(rows, VECTORS)) == brute(rows)
    rows = [(i, (rng.normal(size=6) * 1e15).astype(np.float32).tolist()) for i in range(60)]
    limit = (1 << 63) - 1
    got, want = found(spark.createDataFrame(rows, VECTORS)), brute(rows)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], max(-limit - 1, min(limit, w[3]))) for w in want]


def test_survivors_shrink():
    """Candidates that cannot reach the best scores leave before the last dimension."""
    rng = np.random.default_rng(8)
    rows = (rng.normal(size=(3000, 32)) * 20).astype(np.int64)
    rows[:, :8] *= 50
    columns = topk.Columns(np.arange(3000), rows)
    query = rows[17]
    order = np.lexsort((np.arange(3000), -(rows @ query)))
    ids, scores = columns.best(query, 17, 5)
    want = [i for i in order if i != 17][:5]
    assert ids.tolist() == want and scores.tolist() == (rows @ query)[want].tolist()
