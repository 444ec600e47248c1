import pytest
from pyspark.sql import functions as F

from vetline.operators import metrics, tuning


def scores(spark, rows):
    return spark.createDataFrame(rows, "s double, y int")


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc(spark):
    assert metrics.roc_auc(scores(spark, [(1.0, 0), (1.0, 1), (1.0, 0)]), "s", "y").first().auc == 0.5
    assert metrics.roc_auc(scores(spark, [(0.1, 0), (0.2, 0), (0.9, 1)]), "s", "y").first().auc == 1.0
    assert metrics.roc_auc(scores(spark, [(0.1, 0), (0.2, 0)]), "s", "y").first().auc is None
    rows = [(float((i * 7) % 23), int(i % 5 == 0)) for i in range(200)]
    assert metrics.roc_auc(scores(spark, rows), "s", "y").first().auc == pytest.approx(brute_auc(rows), abs=1e-12)


def test_curves_end_where_they_should(spark):
    rows = [(float((i * 7) % 23), int(i % 5 == 0)) for i in range(200)]
    roc = [tuple(r) for r in metrics.roc_points(scores(spark, rows), "s", "y").collect()]
    assert (0.0, 0.0, None) in roc and max(roc, key=lambda r: (r[0], r[1]))[:2] == (1.0, 1.0) and len(roc) == 24
    pr = [tuple(r) for r in metrics.pr_points(scores(spark, rows), "s", "y").collect()]
    assert (1.0, 0.0, None) in pr and any(r[1] == 1.0 for r in pr)


def test_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    row = metrics.precision_recall_f1(metrics.confusion(df, "y", "p")).first()
    assert (row.precision, row.recall, row.f1, row.flagged) == (0.0, 0.0, 0.0, 0)
    row = metrics.precision_recall_f1(metrics.confusion(df.select(F.lit(0).alias("y"), F.lit(1).alias("p")), "y", "p")).first()
    assert (row.recall, row.flagged) == (0.0, 2)


def test_best_row_prefers_lowest_parameter(spark):
    sweep = spark.createDataFrame([(0.05, 0.4), (0.03, 0.4), (0.01, 0.1)], "contamination double, f1 double")
    assert tuning.best_row(sweep, "contamination").first().contamination == 0.03


@pytest.mark.parametrize("a,b,model,reason", [
    ((0.204, 0.3), (0.2, 0.3), "IsolationForest", "recall"),
    ((0.2, 0.2), (0.204, 0.3), "LOF", "recall"),
    ((0.19, 0.9), (0.2, 0.1), "LOF", "f1"),
    ((0.3, 0.1), (0.2, 0.9), "IsolationForest", "f1"),
])
def test_recommendation(spark, a, b, model, reason):
    def best(v, c):
        return spark.createDataFrame([(c, v[0], 0.5, v[1], 10)],
                                     "contamination double, f1 double, precision double, recall double, flagged int")
    both = tuning.best_of_both(best(a, 0.1), best(b, 0.05))
    row = tuning.recommend(both).first()
    assert (row.model, row.reason) == (model, reason)
    assert row.contamination == (0.1 if model == "IsolationForest" else 0.05)
    winners = {r.metric: r.winner for r in tuning.head_to_head(both).collect()}
    assert winners["precision"] == "Tie" and winners["f1"] == ("IF" if a[0] > b[0] else "LOF")


def test_comparison_joins_on_equal_settings(spark):
    fields = "contamination double, f1 double, precision double, recall double, flagged int"
    a = spark.createDataFrame([(0.1 + 0.2, 1.0, 1.0, 1.0, 1)], fields)
    b = spark.createDataFrame([(0.3, 2.0, 2.0, 2.0, 2)], fields)
    assert tuning.compare_sweeps(a, b).count() == 1
