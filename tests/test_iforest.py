import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vetline import schema
from vetline.operators import iforest as forest
from vetline.operators.encode import encode_features

FEATURES = schema.FEATURES


@pytest.fixture(scope="module")
def matrix(spark):
    rows = []
    for n in range(1000):
        row = (44000.0 if n % 3 == 0 else 40000.0 + (n % 60) * 1000, 1 if n % 10 < 8 else 3,
               0 if n % 20 == 0 else 1, 1 if n % 10 < 7 else 4)
        rows.append((n, *((44000.0, 5, 0, 9) if n % 50 == 0 else row)))
    return spark.createDataFrame(
        rows, "id int, salary_processed double, employment_type int, has_company_logo int, required_education int")


def postings(spark):
    return spark.createDataFrame([
        ("normal", "60000-90000", "Full-time", "1", "Bachelor's Degree"),
        ("suspicious", "", None, "0", None),
        ("malformed", "not-a-number", "Full-time", "1", "Bachelor's Degree"),
    ], "name string, salary_range string, employment_type string, has_company_logo string, required_education string")


def walk(model, row):
    """Brute force: one row through one tree after the other."""
    paths = []
    for _, nodes in model.nodes.groupby("tree"):
        by_id = nodes.set_index("node")
        at = 1
        while by_id.loc[at, "feature"] >= 0:
            node = by_id.loc[at]
            value = row[model.inputs[int(node["feature"])]]
            if isinstance(node["category"], str):
                right = value == node["category"]
            else:
                right = value > node["threshold"]
            at = 2 * at + int(right)
        paths.append(by_id.loc[at, "path"])
    return -(2.0 ** (-np.mean(paths) / float(forest.average_path(model.sample))))


def test_average_path():
    assert forest.average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert forest.average_path(3) == pytest.approx(2 * (np.log(2) + 0.5772156649015329) - 4 / 3)


@pytest.mark.parametrize("seed", [1, 42])
def test_order_of_the_known_rows(spark, matrix, seed):
    model = forest.fit_forest(matrix, "id", seed=seed)
    scored = forest.score_outliers(encode_features(postings(spark), keep=["name"]), model)
    got = {r.name: r for r in scored.collect()}
    assert got["normal"].anomaly_score > 0 and got["normal"].anomaly_label == 1
    assert got["suspicious"].anomaly_score < got["normal"].anomaly_score - 0.1
    assert not np.isnan(got["malformed"].anomaly_score)
    fraud = forest.score_outliers(encode_features(postings(spark), keep=["name"]), model, "fraud")
    for r in fraud.collect():
        assert r.anomaly_score == -got[r.name].anomaly_score
        assert r.anomaly_label == (1 if got[r.name].anomaly_label == -1 else 0)


def test_score_equals_a_walk_through_the_trees(spark, matrix):
    model = forest.fit_forest(matrix, "id", trees=12, sample=64)
    got = matrix.withColumn("s", forest.raw_score(model)).where("id % 37 = 0").collect()
    assert len(got) > 20
    for r in got:
        assert r.s == pytest.approx(walk(model, r.asDict()), abs=1e-12)


def test_trees_are_well_formed_and_stable(spark, matrix):
    model = forest.fit_forest(matrix, "id", trees=20, sample=100, contamination=0.1)
    again = forest.fit_forest(matrix.repartition(5, "employment_type"), "id", trees=20, sample=100, contamination=0.1)
    pd.testing.assert_frame_equal(model.nodes, again.nodes)
    assert model.offset == again.offset
    assert len(model.nodes) <= 20 * 199
    for _, nodes in model.nodes.groupby("tree"):
        inner = nodes[nodes["feature"] >= 0]["node"]
        assert sorted([1, *(2 * inner), *(2 * inner + 1)]) == sorted(nodes["node"])


def test_flagged_share_is_the_contamination(spark, matrix):
    jitter = matrix.withColumn("salary_processed", F.col("salary_processed") + F.col("id") * 7.5)
    model = forest.fit_forest(jitter, "id", contamination=0.05)
    flagged = forest.score_outliers(jitter, model).where("anomaly_label = -1").count()
    assert 40 <= flagged <= 50


@pytest.mark.parametrize("rows", [30, 499, 500, 1000])
def test_every_tree_draws_for_itself_at_every_size(spark, matrix, rows):
    samples, size = forest._tree_samples(matrix.where(F.col("id") < rows), "id", 10, 50, 42)
    drawn = pd.DataFrame([r.asDict() for r in samples.select("id", "_tree").collect()])
    assert size == min(50, rows)
    for t, own in drawn.groupby("_tree"):
        order = sorted(range(rows), key=lambda i: hashlib.md5(f"42:{t}:{i}".encode()).hexdigest())
        assert sorted(own["id"]) == sorted(order[:size])
    assert drawn["_tree"].nunique() == 10


def test_categories_act_like_their_dummy_columns(spark):
    df = spark.createDataFrame(
        [(i, "abc"[i % 3] if i % 7 else None, i % 2) for i in range(300)], "id int, c string, f int")
    model = forest.fit_forest(df, "id", ["f"], ["c"], trees=15, sample=60)
    # Upper case sorts first, so the category of missing cells is the dropped one.
    assert set(model.nodes["category"].dropna()) == {"a", "b", "c"}
    got = df.withColumn("s", forest.raw_score(model)).where("id < 60").collect()
    for r in got:
        assert r.s == pytest.approx(walk(model, {"c": r.c or "Unknown", "f": r.f}), abs=1e-12)
    unseen = spark.createDataFrame([("zzz", 1), ("Unknown", 1)], "c string, f int")
    a, b = (r.s for r in unseen.withColumn("s", forest.raw_score(model)).collect())
    assert a == b


def test_round_trip_and_missing_model(spark, matrix, tmp_path):
    model = forest.fit_forest(matrix, "id", trees=10, sample=64)
    path = str(tmp_path / "model")
    forest.save_forest(spark, model, path)
    loaded = forest.load_forest(spark, path)
    a, b = (forest.score_outliers(matrix, m) for m in (model, loaded))
    assert a.exceptAll(b).count() == 0
    assert forest.load_forest(spark, str(tmp_path / "absent")) is None
    for f in (tmp_path / "model").glob("version-*/params/*.parquet"):
        f.write_bytes(b"not a table")
    for f in (tmp_path / "model").glob("version-*/params/.*.crc"):
        f.unlink()
    assert forest.load_forest(spark, path) is None
    row = forest.score_outliers(matrix, None).first()
    assert (row.anomaly_score, row.anomaly_label) == (0.0, 1)


def test_a_writer_that_stops_leaves_the_version_before(spark, matrix, tmp_path, monkeypatch):
    """Nodes of a new model without its parameters, or all of it without the last step, are not seen."""
    first, second = (forest.fit_forest(matrix, "id", trees=t, sample=32) for t in (3, 5))
    path = str(tmp_path / "model")
    forest.save_forest(spark, first, path)

    def stop(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr("vetline.runtime.publish", stop)
        with pytest.raises(OSError):
            forest.save_forest(spark, second, path)
    frame = spark.createDataFrame
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda self, rows, schema=None: stop() if "offset" in str(schema) else frame(rows, schema))
        with pytest.raises(OSError):
            forest.save_forest(spark, second, path)
    assert forest.load_forest(spark, path).nodes["tree"].nunique() == 3
    forest.save_forest(spark, second, path)
    assert forest.load_forest(spark, path).nodes["tree"].nunique() == 5


def test_digests_per_tree_are_drawn_from_a_bounded_pool(spark, monkeypatch):
    """Of a table larger than the pool, the pool is the first rows by digest; the trees draw from it alone."""
    monkeypatch.setattr(forest, "POOL", 0)
    df = spark.range(500).select("id", F.col("id").cast("double").alias("x"))
    samples, size = forest._tree_samples(df, "id", 5, 20, 42)
    got = {}
    for r in samples.collect():
        got.setdefault(r._tree, set()).add(r.id)
    md5 = lambda *a: hashlib.md5(":".join(map(str, a)).encode()).hexdigest()
    pool = sorted(range(500), key=lambda i: md5(42, i))[:100]
    assert size == 20
    assert got == {t: set(sorted(pool, key=lambda i: md5(42, t, i))[:20]) for t in range(5)}


def test_hot_vector(spark):
    df = spark.range(900).select(
        "id", *[F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise((F.col("id") % 11).cast("double")).alias(f)
                for f in FEATURES])
    model = forest.fit_forest(df, "id", trees=10, sample=32)
    assert forest.training_scores(df, model).agg(F.sum("n")).first()[0] == 900
