"""Scoring postings as they land.

Cleaning (without duplicate removal), encoding and scoring look at one row at
a time, so the batch functions run on a stream as they are, without state.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from vetline import schema
from vetline.operators.clean import clean_postings, standardise_nulls
from vetline.operators.encode import encode_features
from vetline.operators.iforest import Forest, score_outliers
from vetline.sources.files import CSV_OPTIONS


def landed_postings(spark: SparkSession, folder: str, key: str | None = None) -> DataFrame:
    """A stream of the CSV files that land in ``folder``, with ``key`` as their first column.

    A file's header must name exactly these columns in this order (in any case of
    letters); a file with another header stops the stream instead of shifting values
    into wrong columns.
    """
    columns = ([StructField(key, StringType())] if key else []) + list(schema.RAW_SCHEMA.fields)
    options = {**CSV_OPTIONS, "enforceSchema": "false"}
    raw = spark.readStream.schema(StructType(columns)).options(**options).csv(folder)
    return raw.transform(standardise_nulls, tuple(schema.CSV_NULL_TOKENS))


def score_postings(raw: DataFrame, model: Forest | None, keep: list[str], convention: str = "anomaly") -> DataFrame:
    """Raw postings, batch or streaming, to features, ``anomaly_score`` and ``anomaly_label``."""
    clean = clean_postings(raw, dedupe=False)
    return score_outliers(encode_features(clean, keep=keep), model, convention)


def write_scored(scored: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to a Parquet table, exactly once per row; by default until the input is used up."""
    writer = scored.writeStream.format("parquet").outputMode("append")
    return (
        writer.option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
