from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vetline.operators import clean as ops
from vetline.operators import encode, profile


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [(3, "a", None), (1, "a", None), (2, "a", ""), (4, "1:a", None)], "job_id int, x string, y string")
    kept = {tuple(r) for r in ops.drop_duplicates(df, "job_id").collect()}
    assert kept == {(1, "a", None), (2, "a", ""), (4, "1:a", None)}
    assert ops.drop_duplicates(df.drop("job_id")).count() == 3


def test_one_row_of_each_set_stays_whatever_its_key(spark):
    def left(rows):
        df = spark.createDataFrame(rows, "job_id int, a string")
        return sorted(map(tuple, ops.drop_duplicates(df, "job_id").collect()), key=repr)

    assert left([(1, "x"), (1, "x")]) == [(1, "x")]
    assert left([(None, "x"), (None, "y"), (2, "z")]) == [(2, "z"), (None, "x"), (None, "y")]
    assert left([(1, "x"), (2, "x"), (2, "y")]) == [(1, "x"), (2, "y")]
    assert left([(None, "x"), (5, "x"), (None, None), (3, None)]) == [(3, None), (5, "x")]
    assert left([(1, "x"), (1, "y"), (1, "x")]) == [(1, "x"), (1, "y")]


def test_zeros_of_both_signs_and_odd_names(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, -0.0, "a"), (3, float("nan"), "a"), (4, float("nan"), "a")],
                               "job_id int, `_digest` double, `a.b` string")
    kept = ops.drop_duplicates(df, "job_id")
    assert kept.columns == df.columns and sorted(r.job_id for r in kept.collect()) == [1, 3]


def test_texts_are_shuffled_once_and_only_if_read(spark, tmp_path):
    spark.range(50).selectExpr("id AS job_id", "CAST(id % 5 AS STRING) AS a", "repeat('t', 50) AS wide").write.parquet(
        str(tmp_path / "t"))
    kept = ops.drop_duplicates(spark.read.parquet(str(tmp_path / "t")), "job_id")

    def exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning"), plan

    assert exchanges(kept)[0] == 1
    n, plan = exchanges(kept.select("job_id", "a"))
    assert n == 1 and "any_value(wide" not in plan


def test_hot_duplicate_group(spark):
    df = spark.range(3000).select(
        F.col("id").alias("job_id"), F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("x"))
    assert ops.drop_duplicates(df, "job_id").count() == 2001


def test_transforms_touch_only_columns_that_exist(spark):
    df = spark.createDataFrame([("t", "none")], "has_company_logo string, other string")
    row = ops.clean_postings(df).first().asDict()
    assert row == {"has_company_logo": 1, "other": None}


def test_order_of_steps(spark):
    df = spark.createDataFrame([(" ", "unknown", "unknown")], "description string, location string, fraudulent string")
    row = ops.clean_postings(df).first().asDict()
    assert row["description"] == "Unspecified" and row["desc_len"] == 11
    assert row["country"] == "Unknown" and row["fraudulent"] == 0 and row["location"] is None


def test_empty_posting_is_encoded(spark):
    row = encode.encode_features(spark.range(1).select("id"), keep=["id"]).first()
    assert list(row) == [0, 44000.0, 5, 0, 9]


def test_one_hot_drops_first_value(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,), ("B",)], "c string")
    rows = encode.one_hot(df, ["c"], []).select("c", vector_to_array("features")).collect()
    by_value = {r[0]: r[1] for r in rows}
    assert sum(by_value["A"]) == 0 and sum(by_value["B"]) == 1 and sum(by_value["Unknown"]) == 1
    counts = {r.feature: r.ones for r in encode.one_hot_counts(df, ["c"]).collect()}
    assert counts == {"c_B": 2, "c_Unknown": 1}


def test_category_codes_with_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert sorted(r.c for r in encode.with_category_codes(df, ["c"]).collect()) == [-1, 0, 1, 1]


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)],
                               "a double, b double, c double")
    got = {(r.a, r.b): r["corr"] for r in profile.correlations(df).collect()}
    assert abs(got["a", "b"] - 1) < 1e-12 and got["a", "c"] is None and len(got) == 9


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 0, 5, 10]], "x double")
    assert [r["count"] for r in profile.histogram(df, F.col("x"), 5).orderBy("bin").collect()] == [2, 0, 1, 0, 1]
    one = profile.histogram(df.where("x = 5"), F.col("x"), 2).orderBy("bin").collect()
    assert [(r.lo, r.hi, r["count"]) for r in one] == [(4.5, 5.0, 0), (5.0, 5.5, 1)]


def test_one_hot_of_many_categories(spark, monkeypatch):
    """Far more values than a range of the dictionary holds; no indexer, no label on the driver."""
    from vetline.operators import ordered
    monkeypatch.setattr(ordered.running_totals, "__defaults__", (None, False, 50))
    df = spark.range(1200).selectExpr("id", "concat('v', lpad(CAST(id % 700 AS STRING), 4, '0')) AS c", "id % 2 AS n")
    hot = encode.one_hot(df, ["c"], ["n"])
    assert "StringIndexer" not in str(hot._jdf.queryExecution().analyzed().toString())
    for r in hot.collect():
        v, rank = r.features, r.id % 700
        assert v.size == 700 and v[0] == r.n
        assert sorted(i for i in v.indices if i) == ([] if rank == 0 else [700 - rank])
