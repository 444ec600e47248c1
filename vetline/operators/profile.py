"""Profiling: counts, means, describe, correlation, word and length tables."""

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline import schema
from vetline.functions import text
from vetline.functions.scalars import quoted
from vetline.operators.ordered import quantiles_of_counts, value_counts_of
from vetline.runtime import settle


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _named_rows(columns: list[str], fields: dict) -> Column:
    """``inline`` of one struct per column; ``fields`` maps names to column -> Column."""
    return F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[make(c).alias(n) for n, make in fields.items()])
        for c in columns
    ]))


def null_counts(df: DataFrame) -> DataFrame:
    """Rows (column, nulls), from one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.select(_named_rows(df.columns, {"nulls": F.col}))


def column_profile(df: DataFrame) -> DataFrame:
    """Rows (column, dtype, non_null, rows), from one pass over the table."""
    types = dict(df.dtypes)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    return counts.select(_named_rows(df.columns, {
        "dtype": lambda c: F.lit(types[c]),
        "non_null": F.col,
        "rows": lambda c: F.col("_rows"),
    }))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows (column, count) without nulls, most frequent first, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(column))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return value_counts(df, column).limit(n)


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def group_mean(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias(name))


def feature_means(df: DataFrame, features: list[str], label: str = "fraudulent") -> DataFrame:
    """Rows (feature, Legitimate, Fraudulent), from one pass over the table."""
    per_class = {
        f"{f}_{y}": F.avg(F.when(F.col(label) == y, F.col(f))) for f in features for y in (0, 1)
    }
    means = df.agg(*[c.alias(n) for n, c in per_class.items()])
    rows = _named_rows(features, {
        "Legitimate": lambda f: F.col(f"{f}_0"), "Fraudulent": lambda f: F.col(f"{f}_1"),
    })
    return means.select(rows).withColumnRenamed("column", "feature")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max per column.

    The table is read once: the counts per distinct value give every statistic.
    """
    columns = columns or numeric_columns(df)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns
    ])))
    counts = settle(value_counts_of(long, F.col("x"), ["column"]))
    quartiles = quantiles_of_counts(counts, [0.25, 0.5, 0.75], ["column"])
    mean = counts.groupBy("column").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    # The deviation is summed around the mean; squares of raw values would cancel.
    off = F.col("value") - F.col("mean")
    mean = F.broadcast(mean)  # one row per column
    spread = (
        counts.join(mean, "column").groupBy("column")
        .agg(F.sum(F.col("n") * off * off).alias("_ss"))
    )
    q = F.col("quantiles")
    return quartiles.join(mean, "column").join(F.broadcast(spread), "column").select(
        "column", F.col("n").alias("count"), "mean",
        F.sqrt(F.try_divide("_ss", F.col("n") - 1)).alias("std"), "min",
        q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), "max",
    )


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (a, b, corr) for all ordered column pairs, from one pass.

    Rows are used pairwise where both sides are present; a side without
    variance gives null.
    """
    columns = columns or numeric_columns(df)

    def pearson(a: str, b: str) -> Column:
        x, y = (f"CASE WHEN `{other}` IS NOT NULL THEN CAST(`{own}` AS DOUBLE) END"
                for own, other in ((a, b), (b, a)))
        return F.expr(f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y}))")

    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*[pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        f"named_struct('a', {quoted(left)}, 'b', {quoted(right)}, 'corr', c{i})"
        for i, (a, b) in enumerate(pairs) for left, right in {(a, b), (b, a)}
    ]
    return wide.select(F.expr(f"inline(array({', '.join(cells)}))"))


def correlation_with(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """Rows (feature, corr) for one target, strongest positive first."""
    rows = correlations(df, columns).where(F.col("b") == target)
    return rows.select(F.col("a").alias("feature"), "corr").orderBy(F.desc_nulls_last("corr"), "feature")


def crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Counts of ``rows`` x ``columns``; a combination that never occurs is 0."""
    cells = [F.count_if(F.col(columns) == v).alias(f"{columns}_{v}") for v in values]
    return df.groupBy(rows).agg(*cells)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how many rows have equal labels, out of how many."""
    return df.agg(F.count_if(F.col(a) == F.col(b)).alias("agree"), F.count(F.lit(1)).alias("rows"))


def stop_words(junk=tuple(schema.JUNK_WORDS)) -> list[str]:
    """The English list plus the junk words."""
    return sorted({*schema.STOP_WORDS, *junk})


def row_by_key(df: DataFrame, key: str, value: Column) -> DataFrame:
    """The one row with this key, for scoring by itself."""
    return df.where(F.col(key) == value)


def word_frequency(df: DataFrame, words: Column, drop: list[str] | None = None) -> DataFrame:
    """Rows (word, count) over an array column of words."""
    kept = df.select(F.explode(words).alias("word"))
    if drop:
        kept = kept.where(~F.col("word").isin(*drop))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def top_words(df: DataFrame, column: Column, n: int = 20, drop: list[str] | None = None) -> DataFrame:
    """The ``n`` most frequent words; equal counts in alphabetical order."""
    counts = word_frequency(df, text.tokens(column), stop_words() if drop is None else drop)
    return counts.orderBy(F.desc("count"), F.asc("word")).limit(n)


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """Rows (bin, lo, hi, count) of equal-width bins, empty ones included.

    The last bin is closed. A table with one distinct value gets the range
    value - 0.5 to value + 0.5.
    """
    rows = df.select(value.cast("double").alias("x")).where(F.col("x").isNotNull())
    span = rows.agg(F.min("x").alias("a"), F.max("x").alias("b")).select(
        F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("a") - 0.5).alias("lo"),
        F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("b") + 0.5).alias("hi"),
    )
    limits = span.select(F.struct("lo", "hi")).scalar()
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    bin_no = F.least(F.floor((F.col("x") - lo) * bins / (hi - lo)), F.lit(bins - 1))
    counted = (
        rows.withColumn("_s", limits).groupBy(bin_no.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = span.select(
        "lo", ((F.col("hi") - F.col("lo")) / bins).alias("w"),
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )
    return edges.join(counted, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
    )


def box_stats(df: DataFrame, value: Column, key: str) -> DataFrame:
    """Quartiles, whiskers, outlier count per key.

    A whisker ends at the last value within 1.5 IQR of the box, and never inside the box.
    """
    counts = settle(value_counts_of(df, value, [key]))
    q = F.col("quantiles")
    fences = quantiles_of_counts(counts, [0.25, 0.5, 0.75], [key]).select(
        key, q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"),
        (q[0] - (q[2] - q[0]) * 1.5).alias("_low"), (q[2] + (q[2] - q[0]) * 1.5).alias("_high"),
    )
    inside = (F.col("value") >= F.col("_low")) & (F.col("value") <= F.col("_high"))
    found = counts.join(fences, key).groupBy(key, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("_low"),
        F.max(F.when(inside, F.col("value"))).alias("_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )
    return found.select(
        key, "q1", "median", "q3", F.least("_low", "q1").alias("whisker_low"),
        F.greatest("_high", "q3").alias("whisker_high"), "outliers",
    )


def class_weights(df: DataFrame, label: str = "fraudulent") -> DataFrame:
    """Rows (label, count, weight) with balanced weights rows / (classes * count)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.agg(F.struct(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.withColumn("_t", totals).select(
        label, "count", (F.col("_t.n") / (F.col("_t.k") * F.col("count"))).alias("weight")
    )


def distinct_classes(df: DataFrame, label: str = "fraudulent") -> DataFrame:
    return df.select(label).distinct()


def fraud_rate(df: DataFrame, label: str = "fraudulent") -> DataFrame:
    """One row: rows, fraudulent rows and their share."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).alias("fraud"), F.avg(label).alias("rate")
    )


def mutual_information(df: DataFrame, columns: list[str], label: str = "fraudulent") -> DataFrame:
    """Rows (feature, mutual_info) in nats, most informative first.

    The plug-in estimate over the contingency table of each discrete column
    and the label; bin a continuous column first.
    """
    long = df.select(label, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("x"))
        for c in columns
    ])))
    cells = settle(long.groupBy("feature", "x", label).agg(F.count(F.lit(1)).alias("n")))
    by_x = cells.groupBy("feature", "x").agg(F.sum("n").alias("n_x"))
    by_y = cells.groupBy("feature", label).agg(F.sum("n").alias("n_y"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("n_all"))
    # Few rows: one per column and label value, one per column.
    joined = (
        cells.join(by_x, ["feature", "x"])
        .join(F.broadcast(by_y), ["feature", label]).join(F.broadcast(total), "feature")
    )
    n, nx, ny, na = (F.col(c).cast("double") for c in ("n", "n_x", "n_y", "n_all"))
    info = F.sum(n / na * F.ln(n * na / (nx * ny)))
    return joined.groupBy("feature").agg(info.alias("mutual_info")).orderBy(
        F.desc("mutual_info"), "feature"
    )


def binned(value: Column, cuts: list[Column]) -> Column:
    """How many cut points the value reaches."""
    return reduce(lambda a, b: a + b, [(value >= c).cast("int") for c in cuts])
