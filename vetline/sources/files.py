"""Reading and writing posting tables as CSV or Parquet."""

from pyspark.sql import DataFrame, SparkSession

from vetline import schema
from vetline.operators.clean import standardise_nulls

# Free text holds quotes, commas and line breaks. Quotes are doubled, line
# breaks stay inside quotes, and spaces at the ends of a cell are kept.
CSV_OPTIONS = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_csv(spark: SparkSession, path: str, null_tokens=tuple(schema.CSV_NULL_TOKENS)) -> DataFrame:
    """Postings from CSV with a header; every column is a string.

    Cells that spell a missing value become null. A multi-line file is read by
    one task, so keep large tables as many files, or as Parquet.
    """
    return spark.read.options(**CSV_OPTIONS).csv(path).transform(standardise_nulls, null_tokens)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index; a folder with one file per task."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    df.write.mode("overwrite").options(**options).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, the default format."""
    df.write.mode("overwrite").parquet(path)
