"""Cleaning: missing markers, flags, country, text placeholders, duplicates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline import schema
from vetline.functions import scalars, text


def standardise_nulls(df: DataFrame, tokens=tuple(schema.NULL_TOKENS)) -> DataFrame:
    """Missing markers become null in every string column."""
    markers = scalars.token_set(tokens)
    return df.select(
        *[
            scalars.null_tokens(F.col(f.name), markers).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def parse_flags(df: DataFrame, columns=tuple(schema.BINARY_COLUMNS), parse=scalars.binary_flag) -> DataFrame:
    """Binary columns that exist become 0/1."""
    present = set(df.columns)
    return df.withColumns({c: parse(F.col(c)) for c in columns if c in present})


def add_features(df: DataFrame) -> DataFrame:
    """Country, text placeholders, description length; only where the inputs exist."""
    present = set(df.columns)
    if "location" in present:
        df = df.withColumn("country", scalars.country(F.col("location")))
    texts = [c for c in schema.TEXT_COLUMNS if c in present]
    df = df.na.fill(schema.MISSING_TEXT, texts) if texts else df
    if "description" in present:
        df = df.withColumn("desc_len", text.char_count(F.col("description")))
    return df


def row_digest(fields: list[T.StructField]) -> Column:
    """SHA-256 over the cells, each with its length, so that no two rows read alike; nulls are equal."""
    numbers = (T.FloatType, T.DoubleType)
    # + 0 turns -0.0 into 0.0, so that both count as one value.
    values = [f"`{f.name}` + 0" if isinstance(f.dataType, numbers) else f"`{f.name}`" for f in fields]
    texts = [f"CAST({v} AS STRING)" for v in values]
    # A null cell reads as length -1 and no content.
    cells = [f"coalesce(length({t}), -1), {t}" for t in texts]
    return F.expr(f"unhex(sha2(concat_ws('|', {', '.join(cells)}), 256))")


def drop_duplicates(df: DataFrame, key: str | None = None) -> DataFrame:
    """Keep one of each set of rows equal in all columns (nulls equal).

    ``key`` is a row identifier that takes no part in the comparison: one row of each set
    stays and has the smallest identifier of the set, null if no row of it has one. An
    identifier may be null or shared by different rows; no row is lost by it.

    One aggregation by digest, which copies enter combined before the shuffle. As all rows
    of a set are equal, any cell of a column will do, so columns nobody reads later are
    not shuffled.
    """
    rest = [f for f in df.schema.fields if f.name != key]
    name = "_digest"
    while name in df.columns:
        name = f"_{name}"
    kept = [(F.min if c == key else F.any_value)(F.col(f"`{c}`")).alias(c) for c in df.columns]
    return df.groupBy(row_digest(rest).alias(name)).agg(*kept).drop(name)


def clean_postings(df: DataFrame, dedupe: bool = True, key: str | None = "job_id") -> DataFrame:
    """Raw postings to clean postings; ``dedupe`` is for training tables only.

    Length is measured after the placeholder is filled in, and duplicates are
    dropped last, on the finished columns.
    """
    clean = df.transform(standardise_nulls).transform(parse_flags).transform(add_features)
    return clean.transform(drop_duplicates, key) if dedupe else clean


def with_missing_columns(df: DataFrame, columns=tuple(schema.RAW_COLUMNS)) -> DataFrame:
    """Add absent posting columns as null strings."""
    present = set(df.columns)
    absent = [c for c in columns if c not in present]
    return df.withColumns({c: F.lit(None).cast("string") for c in absent})
