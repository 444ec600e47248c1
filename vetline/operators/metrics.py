"""Classification metrics from one aggregation over labels and predictions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.functions.scalars import cutoff_label, guarded_ratio, round_even, safe_ratio
from vetline.operators.ordered import quantiles_of_counts, running_totals, value_counts_of
from vetline.runtime import settle


def confusion_of(label: Column, pred: Column, weight: Column | None = None) -> dict[str, Column]:
    """The four cells as aggregates, for rows of 0/1 labels and predictions."""
    one = F.lit(1) if weight is None else weight
    return {
        name: F.coalesce(F.sum(F.when((label == y) & (pred == p), one)), F.lit(0)).cast("bigint")
        for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    }


def confusion(df: DataFrame, label: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """Columns tn, fp, fn, tp; one row, or one per key."""
    cells = confusion_of(F.col(label), F.col(pred))
    return df.groupBy(*(keys or [])).agg(*[c.alias(n) for n, c in cells.items()])


def precision_recall_f1(cells: DataFrame, digits: int | None = 4) -> DataFrame:
    """Add f1, precision, recall and flagged to rows with confusion cells."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    raw = {
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
    }
    rounded = {n: c if digits is None else round_even(c, digits) for n, c in raw.items()}
    return cells.withColumns({**rounded, "flagged": tp + fp})


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Rows (class, precision, recall, f1, support): both classes, accuracy and averages.

    The accuracy row carries the accuracy in all three metric columns.
    """
    cells = confusion(df, label, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1, n = tn + fp, fn + tp, tn + fp + fn + tp

    def one(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.cast("bigint").alias("support"))

    def mean(a: Column, b: Column, weighted: bool) -> Column:
        return safe_ratio(a * n0 + b * n1, n) if weighted else (a + b) / 2

    legit = (safe_ratio(tn, tn + fn), safe_ratio(tn, n0), safe_ratio(2 * tn, 2 * tn + fp + fn))
    fraud = (safe_ratio(tp, tp + fp), safe_ratio(tp, n1), safe_ratio(2 * tp, 2 * tp + fp + fn))
    accuracy = safe_ratio(tn + tp, n)
    return cells.select(F.inline(F.array(
        one("Legitimate", *legit, n0),
        one("Fraudulent", *fraud, n1),
        one("accuracy", accuracy, accuracy, accuracy, n),
        one("macro avg", *[mean(a, b, False) for a, b in zip(legit, fraud)], n),
        one("weighted avg", *[mean(a, b, True) for a, b in zip(legit, fraud)], n),
    )))


# --- curves ---------------------------------------------------------------


def score_counts(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """One settled row per distinct score: ``neg`` and ``pos`` rows."""
    one = F.col(weight) if weight else F.lit(1)

    def rows_of(y: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col(label) == y, one)), F.lit(0)).cast("bigint")

    return settle(
        df.where(F.col(score).isNotNull())
        .groupBy((F.col(score).cast("double") + F.lit(0.0)).alias("value"))
        .agg(rows_of(0).alias("neg"), rows_of(1).alias("pos"))
    )


def _cumulative(counts: DataFrame) -> DataFrame:
    """From the highest score down, with the totals as ``_t``."""
    totals = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return running_totals(counts, "value", ["pos", "neg"], descending=True).withColumn("_t", totals)


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row with the area under the ROC curve; ties count half."""
    ranked = _cumulative(score_counts(df, score, label))
    above = F.col("cum_pos") - F.col("pos") + F.col("pos") / 2
    wins = F.sum(F.col("neg") * above)
    return ranked.agg(
        F.try_divide(wins, F.max("_t.p").cast("double") * F.max("_t.n")).alias("auc"),
        F.max("_t.p").alias("positives"), F.max("_t.n").alias("negatives"),
    )


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows (fpr, tpr, threshold) for every distinct score, and the origin (threshold null)."""
    counts = score_counts(df, score, label)
    points = _cumulative(counts).select(
        F.try_divide(F.col("cum_neg").cast("double"), F.col("_t.n")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("_t.p")).alias("tpr"),
        F.col("value").alias("threshold"),
    )
    origin = counts.agg(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return origin.union(points)


def pr_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows (precision, recall, threshold) for every distinct score, and the end point (1, 0)."""
    counts = score_counts(df, score, label)
    points = _cumulative(counts).select(
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        safe_ratio(F.col("cum_pos"), F.col("_t.p")).alias("recall"),
        F.col("value").alias("threshold"),
    )
    end = counts.agg(
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold"))
    return end.union(points)


# --- thresholds -----------------------------------------------------------


def confusion_per_threshold(
    counts: DataFrame, thresholds: Column, params: list, param: str, flag
) -> DataFrame:
    """Rows (param, tn, fp, fn, tp), all thresholds from one aggregation.

    ``counts`` is a ``score_counts`` table, ``thresholds`` an array column in
    the order of ``params``, ``flag(score, threshold)`` the predicate.
    """
    rows = counts.withColumn("_thr", thresholds)
    aggs = []
    for i, p in enumerate(params):
        hit = flag(F.col("value"), F.col("_thr")[i])
        cells = {
            "tn": F.when(~hit, F.col("neg")), "fp": F.when(hit, F.col("neg")),
            "fn": F.when(~hit, F.col("pos")), "tp": F.when(hit, F.col("pos")),
        }
        aggs.append(F.struct(
            F.lit(p).alias(param),
            *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in cells.items()],
        ))
    return rows.agg(F.array(*aggs).alias("_r")).select(F.inline("_r"))


def threshold_analysis(df: DataFrame, score: str, label: str, percentiles: list[int]) -> DataFrame:
    """Rows (cutoff, TP, FP, FN, precision, recall, f1): flag scores at or above a percentile."""
    counts = score_counts(df, score, label)
    weighted = counts.select("value", (F.col("neg") + F.col("pos")).alias("n"))
    cuts = quantiles_of_counts(weighted, [p / 100 for p in percentiles]).select("quantiles").scalar()
    cells = confusion_per_threshold(counts, cuts, percentiles, "percentile", lambda s, t: s >= t)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = guarded_ratio(tp, tp + fp), guarded_ratio(tp, tp + fn)
    f1 = guarded_ratio(2 * precision * recall, precision + recall)
    return cells.select(
        cutoff_label(F.col("percentile")).alias("cutoff"),
        tp.alias("TP"), fp.alias("FP"), fn.alias("FN"),
        round_even(precision, 3).alias("precision"), round_even(recall, 3).alias("recall"),
        round_even(f1, 3).alias("f1"),
    )


def contamination_sweep(
    train_scores: DataFrame | None, val_scores: DataFrame, score: str, label: str, contaminations: list[float],
    weight: str | None = None, train_counts: DataFrame | None = None,
) -> DataFrame:
    """Rows (contamination, f1, precision, recall, flagged).

    Contamination only moves the threshold, so one scored table serves all
    values: the threshold is that quantile of the training scores, and a
    validation row is flagged when its score lies below it. With ``weight`` both
    tables are compacted and that column counts their rows. ``train_counts``, a settled
    ``value_counts_of`` table, saves counting the training scores again.
    """
    train = train_counts
    if train is None:
        train = settle(value_counts_of(train_scores, F.col(score), weight=weight))
    cuts = quantiles_of_counts(train, contaminations).select("quantiles").scalar()
    counts = score_counts(val_scores, score, label, weight)
    cells = confusion_per_threshold(counts, cuts, contaminations, "contamination", lambda s, t: s < t)
    scored = precision_recall_f1(cells)
    return scored.select("contamination", "f1", "precision", "recall", "flagged")


def cross_validation_summary(folds: DataFrame) -> DataFrame:
    """Rows (metric, mean, std) with the population deviation over folds."""
    metrics = ["f1", "precision", "recall"]
    wide = folds.agg(*[F.struct(
        F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std")
    ).alias(m) for m in metrics])
    return wide.select(F.inline(F.array(*metrics)))
