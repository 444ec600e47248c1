import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vetline.operators.encode import category_codes
from vetline.operators.ordered import (
    exact_quantiles, quantiles_of_counts, running_totals, value_counts_of,
)


@pytest.mark.parametrize("range_rows", [10_000, 7, 3])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, range_rows, descending):
    pdf = pd.DataFrame({"g": [i % 2 for i in range(200)], "value": [((i * 37) % 211) / 2 for i in range(200)],
                        "n": [1 + i % 5 for i in range(200)]})
    got = running_totals(spark.createDataFrame(pdf), "value", ["n"], ["g"], descending, range_rows).toPandas()
    want = pdf.sort_values("value", ascending=not descending)
    want["cum_n"] = want.groupby("g")["n"].cumsum()
    key = ["g", "value"]
    assert got.sort_values(key)["cum_n"].tolist() == want.sort_values(key)["cum_n"].tolist()


def test_running_totals_over_text(spark):
    words = sorted({f"w{(i * 7919) % 997}" for i in range(300)})
    df = spark.createDataFrame([(w, 1) for w in words], "value string, n int")
    got = {r.value: r.cum_n for r in running_totals(df, "value", ["n"], range_rows=20).collect()}
    assert got == {w: i + 1 for i, w in enumerate(words)}
    codes = {r.value: r.code for r in category_codes(df, "value").collect()}
    assert codes == {w: i for i, w in enumerate(words)}


@pytest.mark.parametrize("range_rows", [10_000, 11])
def test_quantiles_with_a_hot_value(spark, range_rows):
    values = [44000.0] * 300 + [float((i * 53) % 401) * 250 for i in range(600)]
    probs = [0.0, 0.01, 0.25, 0.5, 0.777, 0.95, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    counts = value_counts_of(df, F.col("x"))
    row = quantiles_of_counts(counts, probs, range_rows=range_rows).first()
    assert row.n == 900
    assert np.allclose(row.quantiles, np.percentile(values, [100 * p for p in probs]), rtol=1e-12)


def test_quantiles_per_key_ignore_missing(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("a", None), ("b", -0.0), ("b", 0.0), ("b", float("nan"))],
        "k string, x double")
    got = {r.k: (r.n, list(r.quantiles)) for r in exact_quantiles(df, F.col("x"), [0.5], ["k"]).collect()}
    assert got == {"a": (4, [2.5]), "b": (2, [0.0])}


def test_scan_in_levels(spark):
    """Ranges of ranges of ranges: no window without a range, no cut list, and the same totals."""
    df = spark.range(2000).select(((F.col("id") * 7919) % 2003 - 1000).cast("double").alias("value"), (F.col("id") % 3 + 1).alias("n"))
    got = running_totals(df, "value", ["n"], range_rows=10)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "_range3" in plan and "_range4" not in plan and "Bucketizer" not in plan and "UDF" not in plan
    total, want = 0, {}
    for r in sorted(df.collect(), key=lambda r: r.value):
        total += r.n
        want[r.value] = total
    assert {r.value: r.cum_n for r in got.collect()} == want
    ranges = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in ranges and "windowspecdefinition(value" not in ranges
