"""Hot keys, stored winners, landed files, workers without this folder on their path."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetline import schema
from vetline.operators import classifier, encode, iforest, neighbours, profile, sampling, selection
from vetline.runtime import read_stored
from vetline.streaming import scoring

FEATURES = schema.FEATURES
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    """One vector fills a third of the table."""
    return spark.range(600).select(
        F.col("id").alias("job_id"), (F.col("id") % 7 == 0).cast("int").alias("fraudulent"),
        *[F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise((F.col("id") * (i + 3) % 41).cast("double")).alias(f)
          for i, f in enumerate(FEATURES)])


@pytest.mark.parametrize("act", [
    lambda df: sampling.stratified_split(df, "k", "y"),
    lambda df: sampling.stratified_folds(df, "k", "y"),
    lambda df: classifier.with_class_weights(df, "y"),
])
def test_wide_rows_are_not_exchanged_on_the_label(spark, act):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"), F.lit("text").alias("wide"))
    plan = plan_of(act(df))
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main
    assert act(df).count() == 1000


def test_labels_that_are_null(spark):
    df = spark.createDataFrame([(i, [None, 0, 1][i % 3]) for i in range(300)], "k int, y int")
    parts = sampling.assign_parts(df, [0.5, 0.5], "k", "y").groupBy("y", "part").count().collect()
    assert sorted(r["count"] for r in parts) == [50] * 6
    assert classifier.with_class_weights(df, "y").count() == 200


def test_hot_category_and_hot_vector(spark, rows):
    df = spark.createDataFrame([(i, "b" if i % 3 else "ac"[i % 2] if i % 5 else None) for i in range(400)], "k int, c string")
    want = {"a": 0, "b": 1, "c": 2, None: -1}
    got = encode.with_category_codes(df.withColumn("code", F.col("c")), ["code"])
    assert all(r.code == want[r.c] for r in got.collect()) and got.count() == 400
    model = neighbours.fit_lof(rows, FEATURES, [10])
    scored = neighbours.score_lof(rows, model, 10, 0.1)
    assert scored.count() == 600 and scored.where("lof_factor is null").count() == 0
    assert scored.groupBy(*FEATURES).agg(F.countDistinct("lof_factor").alias("n")).where("n > 1").count() == 0


def test_vectors_have_no_gaps(spark, rows):
    gap = rows.withColumn(FEATURES[0], F.when(F.col("job_id") > 5, F.col(FEATURES[0])))
    with pytest.raises(Exception, match="has no value"):
        neighbours.fit_lof(gap, FEATURES, [5])


@pytest.mark.parametrize("size", [3, 40, 4000])
def test_split_is_exact_at_every_size(spark, size):
    df = spark.range(size).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    parts = sampling.stratified_split(df, "id", "y").groupBy("y", "split").count().collect()
    for y in (0, 1):
        n = df.where(F.col("y") == y).count()
        held = {r.split: r["count"] for r in parts if r.y == y}
        assert held.get("train", 0) == int(np.floor(n * 0.7 + 0.5)) and sum(held.values()) == n


def test_whiskers_stay_outside_the_box(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 1, 1, 10)], "k string, x double")
    row = profile.box_stats(df, F.col("x"), "k").first()
    assert (row.q1, row.q3, row.whisker_low, row.whisker_high, row.outliers) == (1.0, 3.25, 1.0, 3.25, 1)


@pytest.mark.parametrize("kind", ["IsolationForest", "LOF"])
def test_winner_round_trip(spark, rows, tmp_path, kind):
    if kind == "LOF":
        model = neighbours.fit_lof(rows, FEATURES, [5, 10])
        winner = selection.Winner(kind, model, 0.1, 10, neighbours.lof_offset(model, 10, 0.1))
    else:
        model = iforest.fit_forest(rows, "job_id", trees=10, sample=32, contamination=0.1)
        winner = selection.Winner(kind, model, 0.1, None, model.offset)
    path = str(tmp_path / "winner")
    assert selection.load_winner(spark, path) is None
    selection.save_winner(spark, winner, path)
    again = selection.load_winner(spark, path)
    a, b = (selection.score_with_winner(rows, w).select("job_id", "outlier_score", "outlier_predict") for w in (winner, again))
    assert a.exceptAll(b).count() == 0 and a.count() == 600
    assert kind == "LOF" or a.where("outlier_predict = 1").count() > 0
    neutral = selection.score_with_winner(rows, None).first()
    assert (neutral.outlier_score, neutral.outlier_predict) == (0.0, 0)


def test_unreadable_model(spark, tmp_path):
    for name in ("versions", "params"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.parquet").write_bytes(b"not a table")
    assert neighbours.load_lof(spark, str(tmp_path)) is None
    assert read_stored(spark, str(tmp_path), "params") is None
    assert read_stored(spark, str(tmp_path), "nothing") is None


def _land(folder, columns, row):
    folder.mkdir()
    (folder / "x.csv").write_text(",".join(columns) + "\n" + ",".join(row[c] for c in columns) + "\n")


def _stream(spark, folder, out):
    raw = scoring.landed_postings(spark, str(folder), "job_id")
    scoring.write_scored(scoring.score_postings(raw, None, ["job_id"]), str(out / "t"), str(out / "c")).awaitTermination()
    return spark.read.parquet(str(out / "t")).collect()


def test_landed_header_must_fit(spark, tmp_path):
    row = {c: f"v_{c}" for c in ["job_id", *schema.RAW_COLUMNS]} | {"salary_range": "60000-90000"}
    _land(tmp_path / "good", ["job_id", *schema.RAW_COLUMNS], row)
    (tmp_path / "a").mkdir()
    found = _stream(spark, tmp_path / "good", tmp_path / "a")
    assert [(r.job_id, r.salary_processed) for r in found] == [("v_job_id", 75000.0)]
    for name, columns in (("moved", [*schema.RAW_COLUMNS, "job_id"]), ("swapped", ["job_id", *schema.RAW_COLUMNS[::-1]])):
        _land(tmp_path / name, columns, row)
        (tmp_path / f"{name}-out").mkdir()
        with pytest.raises(Exception):
            _stream(spark, tmp_path / name, tmp_path / f"{name}-out")


def test_workers_find_the_package_from_any_folder(tmp_path):
    """Queries with Python workers run with another working directory and no PYTHONPATH."""
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", "{ROOT}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("iforest_scores", "knn_join"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "iforest_scores" in done.stdout and "knn_join" in done.stdout
