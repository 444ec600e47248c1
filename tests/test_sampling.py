from collections import Counter

import pytest
from pyspark.sql import functions as F

from vetline.operators import sampling


def table(spark, rows=2000):
    # The majority class holds nearly all rows.
    return spark.range(rows).select(
        F.col("id").alias("key"), F.when(F.col("id") % 20 == 0, 1).otherwise(0).alias("label"))


def test_split_shares_are_exact_and_stable(spark):
    df = table(spark)
    got = {r.key: (r.label, r.split) for r in sampling.stratified_split(df, "key", "label").collect()}
    assert Counter(got.values()) == {
        (0, "train"): 1330, (0, "val"): 285, (0, "test"): 285, (1, "train"): 70, (1, "val"): 15, (1, "test"): 15}
    again = sampling.stratified_split(df.repartition(7, "label"), "key", "label").collect()
    assert {r.key: (r.label, r.split) for r in again} == got


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_prefix_length_does_not_matter(spark, digits):
    df = table(spark, 500)
    parts = {r.key: r.part for r in sampling.assign_parts(df, [0.5, 0.5], "key", "label", 1, digits).collect()}
    base = {r.key: r.part for r in sampling.assign_parts(df, [0.5, 0.5], "key", "label", 1).collect()}
    assert parts == base


def test_folds_are_disjoint_and_complete(spark):
    rows = sampling.stratified_folds(table(spark, 1003), "key", "label").collect()
    assert sorted(r.key for r in rows) == list(range(1003))
    sizes = Counter((r.label, r.fold) for r in rows)
    for label in (0, 1):
        n = [sizes[label, f] for f in range(5)]
        assert max(n) - min(n) <= 1


def test_null_class_is_a_class(spark):
    df = spark.range(10).select(F.col("id").alias("key"), F.lit(None).cast("int").alias("label"))
    parts = sampling.assign_parts(df, [0.5, 0.5], "key", "label").collect()
    assert Counter(r.part for r in parts) == {0: 5, 1: 5}


def test_exact_sample(spark):
    df = table(spark, 1001)
    got = {r.key for r in sampling.exact_sample(df, "key", 0.3).collect()}
    assert len(got) == 300
    assert got != {r.key for r in sampling.exact_sample(df, "key", 0.3, seed=7).collect()}
    assert sampling.first_by_digest(df, "key", 17, 1001).count() == 17


def test_tiny_classes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "key int, label string")
    rows = sampling.stratified_split(df, "key", "label").collect()
    assert Counter(r.label for r in rows) == {"a": 1, "b": 2}


def test_row_key_for_repeated_rows(spark):
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("x"),
        F.lit(None).cast("string").alias("y"))
    keyed = sampling.with_row_key(df, block=50)
    assert keyed.count() == 900 and keyed.select("row_key").distinct().count() == 900
    assert keyed.where("x = 'hot'").count() == 300
    again = sampling.with_row_key(df.repartition(5), block=50)
    assert keyed.exceptAll(again).count() == 0


def test_more_classes_than_the_map_takes(spark, monkeypatch):
    """10,001 classes and more: those beyond the map are joined, and all shares stay exact."""
    def parts(df):
        rows = sampling.stratified_split(df, "key", "label").collect()
        assert len({r.key for r in rows}) == len(rows) == df.count()
        return {r.key: r.split for r in rows}

    many = spark.range(40_004).select(
        F.col("id").alias("key"), F.when(F.col("id") % 10_001 == 0, F.lit(None)).otherwise(F.col("id") % 10_001).alias("label"))
    got = parts(many)
    sizes = Counter((k % 10_001, s) for k, s in got.items())
    assert all(sizes[c, "train"] == 3 and sizes[c, "val"] + sizes[c, "test"] == 1 for c in range(10_001))
    few = spark.range(900).select(F.col("id").alias("key"), (F.col("id") % 37 % 11).alias("label"))
    base = parts(few)
    monkeypatch.setattr(sampling, "MAP_CLASSES", 3)
    assert parts(few) == base
    plan = sampling.stratified_split(few, "key", "label")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan
