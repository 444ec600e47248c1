"""Registered queries: metrics, curves, sweeps and comparison on stated scores."""

from pyspark.sql import functions as F

from vetline import schema
from vetline.functions import scalars
from vetline.operators import metrics, profile, tuning
from vetline.operators.iforest import outlier_label
from vetline.operators.ordered import exact_quantile
from vetline.operators.sampling import stratified_folds
from vetline.plans.views import KEY, LABEL, scored, split_scored, sql
from vetline.runtime import settle

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def _narrow(df, *columns):
    """The label and score columns only, computed once for several readers."""
    return settle(df.select(*columns))


def _flagged(spark, sf_dir):
    """Labels and both scores' predictions at 5 % contamination, over all rows."""
    rows = _narrow(scored(spark, sf_dir), KEY, LABEL, "score_a", "score_b")
    cuts = {s: exact_quantile(rows, F.col(s), 0.05) for s in ("score_a", "score_b")}
    labels = rows.withColumns({
        f"label_{s[-1]}": outlier_label(F.col(s) - cut) for s, cut in cuts.items()})
    return labels.withColumns({f"pred_{m}": scalars.flagged(F.col(f"label_{m}")) for m in "ab"})


_LABELLED = ", ".join(
    f"CASE WHEN score_{m} - (SELECT quantile_cont(score_{m}, 0.05) FROM scored) < 0 THEN -1 ELSE 1 END AS label_{m}"
    for m in "ab")
_FLAGGED = {"flagged": f"""SELECT *, CASE WHEN label_a = -1 THEN 1 ELSE 0 END AS pred_a,
    CASE WHEN label_b = -1 THEN 1 ELSE 0 END AS pred_b FROM (SELECT *, {_LABELLED} FROM scored)"""}

_CELLS = """count(*) FILTER (fraudulent = 0 AND {p} = 0) AS tn, count(*) FILTER (fraudulent = 0 AND {p} = 1) AS fp,
    count(*) FILTER (fraudulent = 1 AND {p} = 0) AS fn, count(*) FILTER (fraudulent = 1 AND {p} = 1) AS tp"""


def _cells(p):
    return _CELLS.format(p=p)


def _ratio(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _prf(digits=4):
    def r(x):
        return f"round_even({x}, {digits})" if digits else x
    return (f"{r(_ratio('2 * tp', '2 * tp + fp + fn'))} AS f1, {r(_ratio('tp', 'tp + fp'))} AS precision, "
            f"{r(_ratio('tp', 'tp + fn'))} AS recall")


def baseline_metrics():
    return _prf()


@query("outlier_labels", sql("SELECT job_id, label_a, label_b, pred_a, pred_b FROM flagged", "scored", _FLAGGED))
def outlier_labels(spark, sf_dir):
    return _flagged(spark, sf_dir).select(KEY, "label_a", "label_b", "pred_a", "pred_b")


@query("confusion", sql(f"SELECT {_cells('pred_a')} FROM flagged", "scored", _FLAGGED))
def confusion(spark, sf_dir):
    return metrics.confusion(_flagged(spark, sf_dir), LABEL, "pred_a")


@query("error_tradeoff", sql(
    "SELECT 'a' AS model, fp, fn FROM (SELECT " + _cells("pred_a") + " FROM flagged) UNION ALL "
    "SELECT 'b', fp, fn FROM (SELECT " + _cells("pred_b") + " FROM flagged)", "scored", _FLAGGED))
def error_tradeoff(spark, sf_dir):
    both = _flagged(spark, sf_dir).select(LABEL, F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred")) for m in "ab"])))
    return metrics.confusion(both, LABEL, "pred", ["model"]).select("model", "fp", "fn")


@query("prf_at_threshold", sql(
    f"SELECT tn, fp, fn, tp, {_prf()}, tp + fp AS flagged FROM (SELECT {_cells('p')} FROM "
    "(SELECT *, CASE WHEN -score_a >= 20000 THEN 1 ELSE 0 END AS p FROM scored))", "scored"))
def prf_at_threshold(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn(
        "p", scalars.over_threshold(-F.col("score_a"), F.lit(20000.0)))
    return metrics.precision_recall_f1(metrics.confusion(rows, LABEL, "p"))


def report_rows(cells="cells"):
    """SQL rows of a classification report over one row of confusion cells."""
    legit = (_ratio("tn", "tn + fn"), _ratio("tn", "tn + fp"), _ratio("2 * tn", "2 * tn + fp + fn"))
    fraud = (_ratio("tp", "tp + fp"), _ratio("tp", "fn + tp"), _ratio("2 * tp", "2 * tp + fp + fn"))
    total = "tn + fp + fn + tp"
    acc = _ratio("tn + tp", total)
    rows = [("Legitimate", legit, "tn + fp"), ("Fraudulent", fraud, "fn + tp"), ("accuracy", (acc,) * 3, total),
            ("macro avg", [f"(({a}) + ({b})) / 2" for a, b in zip(legit, fraud)], total),
            ("weighted avg", [f"(({a}) * (tn + fp) + ({b}) * (fn + tp)) / ({total})"
                              for a, b in zip(legit, fraud)], total)]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS class, round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1, "
        f"CAST({s} AS BIGINT) AS support FROM {cells}" for n, (p, r, f), s in rows)


@query("class_report", sql(report_rows(), "scored", {
    **_FLAGGED, "cells": f"SELECT {_cells('pred_a')} FROM flagged"}))
def class_report(spark, sf_dir):
    report = metrics.class_report(_flagged(spark, sf_dir), LABEL, "pred_a")
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _suspicious(spark, sf_dir):
    return scored(spark, sf_dir).select(LABEL, (-F.col("score_a")).alias("suspicion"))


_CURVE = {"pts": """SELECT s, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, pos, neg, sum(pos) OVER () AS p,
    sum(neg) OVER () AS n FROM (SELECT -score_a AS s, count(*) FILTER (fraudulent = 1) AS pos,
    count(*) FILTER (fraudulent = 0) AS neg FROM scored GROUP BY s) WINDOW w AS (ORDER BY s DESC)"""}


@query("roc_auc", sql(
    """SELECT round(sum(neg * (cp - pos + pos / 2)) / (max(p) * max(n)), 6) AS auc,
       CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives FROM pts""", "scored", _CURVE))
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_suspicious(spark, sf_dir), "suspicion", LABEL).withColumn("auc", F.round("auc", 6))


@query("roc_points", sql(
    """SELECT round(cn / n, 6) AS fpr, round(cp / p, 6) AS tpr, s AS threshold FROM pts
       UNION ALL SELECT 0.0, 0.0, NULL""", "scored", _CURVE))
def roc_points(spark, sf_dir):
    points = metrics.roc_points(_suspicious(spark, sf_dir), "suspicion", LABEL)
    return points.withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


@query("pr_points", sql(
    """SELECT round(cp / (cp + cn), 6) AS precision, round(cp / p, 6) AS recall, s AS threshold FROM pts
       UNION ALL SELECT 1.0, 0.0, NULL""", "scored", _CURVE))
def pr_points(spark, sf_dir):
    points = metrics.pr_points(_suspicious(spark, sf_dir), "suspicion", LABEL)
    return points.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("score_percentiles", sql(
    "SELECT " + ", ".join(f"round(quantile_cont(-score_a, {p / 100}), 6) AS p{p}" for p in schema.CUTOFF_PERCENTILES)
    + " FROM scored", "scored"))
def score_percentiles(spark, sf_dir):
    from vetline.operators.ordered import exact_quantiles
    q = exact_quantiles(_suspicious(spark, sf_dir), F.col("suspicion"), [p / 100 for p in schema.CUTOFF_PERCENTILES])
    return q.select(*[F.round(F.col("quantiles")[i], 6).alias(f"p{p}")
                      for i, p in enumerate(schema.CUTOFF_PERCENTILES)])


def _threshold_sql(p):
    return f"""SELECT 'top {100 - p}%' AS cutoff, tp AS "TP", fp AS "FP", fn AS "FN", pr, re,
        2 * pr * re / (pr + re + 1e-9) AS f FROM (SELECT *, tp / (tp + fp + 1e-9) AS pr, tp / (tp + fn + 1e-9) AS re
        FROM (SELECT {_cells('p')} FROM (SELECT *, CASE WHEN -score_a >=
        (SELECT quantile_cont(-score_a, {p / 100}) FROM scored) THEN 1 ELSE 0 END AS p FROM scored)))"""


@query("threshold_analysis", sql(
    'SELECT cutoff, "TP", "FP", "FN", round_even(pr, 3) AS precision, round_even(re, 3) AS recall, '
    "round_even(f, 3) AS f1 FROM (" + " UNION ALL ".join(map(_threshold_sql, schema.CUTOFF_PERCENTILES)) + ")",
    "scored"))
def threshold_analysis(spark, sf_dir):
    return metrics.threshold_analysis(
        _suspicious(spark, sf_dir), "suspicion", LABEL, schema.CUTOFF_PERCENTILES)


def _sweep_sql(score, values=schema.CONTAMINATIONS):
    return " UNION ALL ".join(
        f"""SELECT CAST({c} AS DOUBLE) AS contamination, {_prf()}, tp + fp AS flagged FROM (SELECT {_cells('p')}
        FROM (SELECT *, CASE WHEN {score} < (SELECT quantile_cont({score}, {c}) FROM split WHERE split = 'train')
        THEN 1 ELSE 0 END AS p FROM split WHERE split = 'val'))""" for c in values)


def _sweep(rows, score, values=schema.CONTAMINATIONS):
    train, val = (rows.where(F.col("split") == s) for s in ("train", "val"))
    return metrics.contamination_sweep(train, val, score, LABEL, values)


def _split_rows(spark, sf_dir):
    return _narrow(split_scored(spark, sf_dir), LABEL, "split", "score_a", "score_b")


@query("contamination_sweep", sql(_sweep_sql("score_a"), "split"))
def contamination_sweep(spark, sf_dir):
    return _sweep(_split_rows(spark, sf_dir), "score_a")


@query("baseline_comparison", sql(
    "SELECT 'a' AS model, f1, precision, recall FROM (" + _sweep_sql("score_a", [0.05]) + ") UNION ALL "
    "SELECT 'b', f1, precision, recall FROM (" + _sweep_sql("score_b", [0.05]) + ")", "split"))
def baseline_comparison(spark, sf_dir):
    rows = _split_rows(spark, sf_dir)
    one = [_sweep(rows, f"score_{m}", [0.05]).select(F.lit(m).alias("model"), "f1", "precision", "recall")
           for m in "ab"]
    return one[0].union(one[1])


_SWEEPS = {"fa": _sweep_sql("score_a"), "fb": _sweep_sql("score_b")}
_BEST = {**_SWEEPS,
         "ba": "SELECT * FROM fa ORDER BY f1 DESC, contamination LIMIT 1",
         "bb": "SELECT * FROM fb ORDER BY f1 DESC, contamination LIMIT 1"}


def _both_sweeps(spark, sf_dir):
    rows = _split_rows(spark, sf_dir)
    return _sweep(rows, "score_a"), _sweep(rows, "score_b")


@query("sweep_compare", sql(
    """SELECT fa.contamination, fa.f1 AS IF_f1, fa.precision AS IF_precision, fa.recall AS IF_recall,
       fa.flagged AS IF_flagged, fb.f1 AS LOF_f1, fb.precision AS LOF_precision, fb.recall AS LOF_recall,
       fb.flagged AS LOF_flagged FROM fa JOIN fb ON fa.contamination = fb.contamination""", "split", _SWEEPS))
def sweep_compare(spark, sf_dir):
    return tuning.compare_sweeps(*_both_sweeps(spark, sf_dir))


def _best(spark, sf_dir):
    a, b = (tuning.best_row(s, "contamination") for s in _both_sweeps(spark, sf_dir))
    return tuning.best_of_both(a, b)


@query("best_setting", sql("SELECT * FROM ba", "split", _BEST))
def best_setting(spark, sf_dir):
    return tuning.best_row(_sweep(_split_rows(spark, sf_dir), "score_a"), "contamination")


@query("head_to_head", sql(" UNION ALL ".join(
    f"""SELECT '{m}' AS metric, ba.{m} AS "IF", bb.{m} AS "LOF", CASE WHEN ba.{m} > bb.{m} THEN 'IF'
        WHEN bb.{m} > ba.{m} THEN 'LOF' ELSE 'Tie' END AS winner FROM ba, bb""" for m in tuning.METRICS),
    "split", _BEST))
def head_to_head(spark, sf_dir):
    return tuning.head_to_head(_best(spark, sf_dir))


@query("recommend", sql(
    """SELECT CASE WHEN w THEN 'IsolationForest' ELSE 'LOF' END AS model,
       CASE WHEN w THEN ca ELSE cb END AS contamination, if_f1, lof_f1,
       CASE WHEN close THEN 'recall' ELSE 'f1' END AS reason FROM (SELECT *,
       CASE WHEN close THEN ra >= rb ELSE if_f1 > lof_f1 END AS w FROM (SELECT ba.f1 AS if_f1, bb.f1 AS lof_f1,
       ba.recall AS ra, bb.recall AS rb, ba.contamination AS ca, bb.contamination AS cb,
       abs(ba.f1 - bb.f1) < 0.005 AS close FROM ba, bb))""", "split", _BEST))
def recommend(spark, sf_dir):
    return tuning.recommend(_best(spark, sf_dir))


@query("crosstab_outliers", sql(
    """SELECT label_a, count(*) FILTER (fraudulent = 0) AS fraudulent_0,
       count(*) FILTER (fraudulent = 1) AS fraudulent_1 FROM flagged GROUP BY label_a""", "scored", _FLAGGED))
def crosstab_outliers(spark, sf_dir):
    return profile.crosstab(_flagged(spark, sf_dir), "label_a", LABEL, [0, 1])


@query("agreement", sql(
    "SELECT count(*) FILTER (label_a = label_b) AS agree, count(*) AS rows FROM flagged", "scored", _FLAGGED))
def agreement(spark, sf_dir):
    return profile.agreement(_flagged(spark, sf_dir), "label_a", "label_b")


_FOLD = " + ".join(f"(r >= floor(n * CAST({b} AS DOUBLE) + 0.5))::INT" for b in (0.2, 0.4, 0.6, 0.8))


@query("fold_summary", sql(
    " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std "
                       "FROM folds" for m in tuning.METRICS), "ranked", {
        "folds": f"SELECT fold, {_prf(0)} FROM (SELECT fold, {_cells('p')} FROM (SELECT {_FOLD} AS fold, fraudulent, "
                 "CASE WHEN score_a <= -20000 THEN 1 ELSE 0 END AS p FROM ranked) GROUP BY fold)"}))
def fold_summary(spark, sf_dir):
    rows = scored(spark, sf_dir).select(
        KEY, LABEL, scalars.over_threshold(-F.col("score_a"), F.lit(20000.0)).alias("p"))
    folds = stratified_folds(settle(rows), KEY, LABEL)
    per_fold = metrics.precision_recall_f1(metrics.confusion(folds, LABEL, "p", ["fold"]), None)
    summary = metrics.cross_validation_summary(per_fold)
    return summary.withColumns({c: F.round(c, 6) for c in ("mean", "std")})
