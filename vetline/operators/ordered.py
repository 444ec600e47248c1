"""Running totals and exact quantiles along an order, by a scan in levels.

Rows are first compacted to one per distinct value. The compact table is dealt into value
ranges of about RANGE_ROWS rows by Spark's range partitioning and ranked range by range, in
parallel. The ranges' totals are again a table along the same order, of which RANGE_ROWS
rows at a time make up a range, and so on until one range is left; what comes before a range is
joined to its rows. No list of cuts and no window grows with the table.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetline.runtime import settle

RANGE_ROWS = 10_000  # rows that one window holds, about


def _value_range(df: DataFrame, order: str, n_ranges: int) -> DataFrame:
    """Add ``_range0``, the number of the value range a row falls in; equal values share one."""
    if n_ranges == 1:
        return df.withColumn("_range0", F.lit(0))
    # Settled, as the ranges come from a sample.
    return settle(df.repartitionByRange(n_ranges, order).withColumn("_range0", F.spark_partition_id()))


def _scan(rows: DataFrame, order: str, level: int, n_ranges: int, sums: list[str], keys: list[str],
          descending: bool, range_rows: int) -> DataFrame:
    """Add ``_before_<sum>``: the total of all rows before each row along ``order``, in all ranges."""
    group = [*keys, f"_range{level}"]
    by = F.desc(order) if descending else F.asc(order)
    w = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f"_before_{s}": F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums})
    if n_ranges == 1:
        return inside
    totals = rows.groupBy(*group).agg(*[F.sum(s).alias(s) for s in sums]).withColumn(
        f"_range{level + 1}", F.expr(f"CAST(_range{level} DIV {range_rows} AS INT)"))
    above = _scan(totals, f"_range{level}", level + 1, -(-n_ranges // range_rows), sums, keys, descending, range_rows)
    shifts = above.select(*group, *[F.col(f"_before_{s}").alias(f"_shift_{s}") for s in sums])
    joined = inside.join(shifts, group)
    return joined.select(*rows.columns, *[(F.col(f"_before_{s}") + F.col(f"_shift_{s}")).alias(f"_before_{s}") for s in sums])


def running_totals(
    compact: DataFrame,
    order: str,
    sums: list[str],
    keys: list[str] | None = None,
    descending: bool = False,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add ``cum_<sum>``: the total of ``<sum>`` up to and including each row.

    ``compact`` holds one row per (keys, order) value; it is read several
    times, so pass a settled table. ``order`` and the keys are not null.
    """
    n_ranges = max(1, -(-compact.count() // range_rows))
    rows = _value_range(compact, order, n_ranges)
    scanned = _scan(rows, order, 0, n_ranges, sums, keys or [], descending, range_rows)
    return scanned.select(*compact.columns, *[(F.col(f"_before_{s}") + F.col(s)).alias(f"cum_{s}") for s in sums])


def value_counts_of(df: DataFrame, value: Column, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One row per (keys, value) with its number of rows; null and NaN are left out."""
    keys = keys or []
    # + 0.0 turns -0.0 into 0.0, so that both count as one value.
    rows = df.select(*keys, (value.cast("double") + F.lit(0.0)).alias("value"),
                     (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy(*keys, "value").agg(F.sum("_w").alias("n"))


def quantiles_of_counts(
    counts: DataFrame, probs: list[float], keys: list[str] | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Exact quantiles of a settled ``value_counts_of`` table.

    One row per key: ``n`` and ``quantiles``, an array in the order of
    ``probs``, linearly interpolated between the two nearest ranks.
    """
    keys = keys or []
    ranked = running_totals(counts, "value", ["n"], keys, range_rows=range_rows)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_rows"))
    if keys:
        ranked = ranked.join(totals, keys)
    else:
        ranked = ranked.withColumn("_rows", totals.scalar())
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("value")))

    out, position = [], []
    for i, p in enumerate(probs):
        h = (F.col("_rows") - 1) * F.lit(float(p))
        position += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}")]
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(lo + (hi - lo) * (h - F.floor(h)))
    return (
        ranked.groupBy(*keys)
        .agg(F.max("_rows").alias("_rows"), *position)
        .select(*keys, F.col("_rows").alias("n"), F.array(*out).alias("quantiles"))
    )


def exact_quantiles(
    df: DataFrame, value: Column, probs: list[float], keys: list[str] | None = None, weight: str | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per key."""
    return quantiles_of_counts(settle(value_counts_of(df, value, keys, weight)), probs, keys)


def exact_quantile(df: DataFrame, value: Column, prob: float, weight: str | None = None) -> Column:
    """One exact quantile as a scalar column for use over any other table."""
    return exact_quantiles(df, value, [prob], weight=weight).select(F.get("quantiles", F.lit(0))).scalar()


def exact_median(df: DataFrame, value: Column) -> Column:
    return exact_quantile(df, value, 0.5)
