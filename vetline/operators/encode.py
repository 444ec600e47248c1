"""Encoding metadata columns as numbers."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline import schema
from vetline.functions import scalars
from vetline.operators.clean import with_missing_columns
from vetline.operators.ordered import exact_median, running_totals
from vetline.runtime import settle


SALTS = 16  # parts that the rows of one category are dealt to when they look up its code


def _logo(df: DataFrame) -> Column:
    c = F.col("has_company_logo")
    if isinstance(df.schema["has_company_logo"].dataType, T.StringType):
        return scalars.binary_flag(c)
    return F.coalesce(c.cast("int"), F.lit(0))


def encode_features(
    df: DataFrame, keep: list[str] | None = None, salary_fallback: float = schema.TRAIN_SALARY_MEDIAN
) -> DataFrame:
    """The four scored features in contract order, next to the ``keep`` columns.

    Built-in expressions only. Absent columns, missing cells and unseen
    categories take the defaults, so any posting can be encoded.
    """
    inputs = ["salary_range", "employment_type", "has_company_logo", "required_education"]
    df = with_missing_columns(df, inputs)
    return df.select(
        *(keep or []),
        scalars.salary_or(F.col("salary_range"), salary_fallback).alias("salary_processed"),
        scalars.employment_code(F.col("employment_type")).alias("employment_type"),
        _logo(df).alias("has_company_logo"),
        scalars.education_code(F.col("required_education")).alias("required_education"),
    )


def fill_salary_median(df: DataFrame, name: str = "salary_processed") -> DataFrame:
    """Add the salary midpoint, missing ones replaced by the table's exact median."""
    midpoint = scalars.salary_midpoint(F.col("salary_range"))
    return df.withColumn(name, F.coalesce(midpoint, exact_median(df, midpoint)))


def category_codes(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows (value, code): the alphabetical rank of each distinct value, from 0 (``descending``: the last has 0)."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    ranked = running_totals(settle(values.withColumn("n", F.lit(1))), "value", ["n"], descending=descending)
    return ranked.select("value", (F.col("cum_n") - 1).cast("int").alias("code"))


def with_category_codes(df: DataFrame, columns: list[str], descending: bool = False) -> DataFrame:
    """Replace each column by its alphabetical code; null becomes -1.

    A category may fill much of the table, so both sides of the lookup carry a salt; nulls
    match nothing and spread by it as well.
    """
    # Equal rows of different partitions get different salts.
    salt = F.pmod(F.xxhash64(*df.columns) + F.spark_partition_id(), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part")
    for c in columns:
        codes = category_codes(df, c, descending).select(F.col("value").alias("_value"), F.col("code").alias("_code"), salts)
        salted = df.withColumn("_salt", salt)
        df = salted.join(
            codes, (salted[c] == codes["_value"]) & (salted["_salt"] == codes["_part"]), "left"
        ).withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_value", "_code", "_part", "_salt")
    return df


def one_hot(df: DataFrame, categorical: list[str], numeric: list[str], output: str = "features") -> DataFrame:
    """Sparse one-hot vector with each column's alphabetically first value dropped.

    Null categories are a category of their own, named Unknown. The dictionary of each column
    is a table, ranked in parallel and joined to the rows; the driver learns its size only.
    """
    filled = df.na.fill(schema.MISSING_CATEGORY, categorical)
    index = [f"_{c}_i" for c in categorical]
    hot = [f"_{c}_v" for c in categorical]
    # From the last value to the first, which then has the highest code: the one the encoder drops.
    coded = with_category_codes(filled.withColumns({i: F.col(c) for i, c in zip(index, categorical)}), index, descending=True)
    coded = coded.withColumns({i: F.col(i).cast("double") for i in index})
    stages = [
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=[*numeric, *hot], outputCol=output),
    ]
    return Pipeline(stages=stages).fit(coded).transform(coded).drop(*index, *hot)


def one_hot_counts(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Rows (feature, ones): the column sums of the one-hot matrix.

    Counted from the categories themselves, so no vector is built; the first
    value of each column is left out as in ``one_hot``.
    """
    filled = df.na.fill(schema.MISSING_CATEGORY, categorical)
    long = filled.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in categorical
    ])))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("ones"))
    first = counts.groupBy("column").agg(F.min("value").alias("_first"))
    return counts.join(first, "column").where(F.col("value") != F.col("_first")).select(
        F.concat_ws("_", "column", "value").alias("feature"), "ones"
    )
