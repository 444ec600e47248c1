"""Registered queries: cleaning, scalar functions, encoding, splits."""

from pyspark.sql import functions as F

from vetline import schema
from vetline.functions import scalars, text
from vetline.operators import clean as ops
from vetline.operators import encode, sampling
from vetline.plans import views
from vetline.plans.postings import RULES, raw_postings, table
from vetline.plans.views import KEY, LABEL, clean, encoded, sql
from vetline.runtime import settle

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


_COLS = ", ".join([KEY, *views.CLEAN_COLUMNS])


@query("clean_postings", sql(f"SELECT {_COLS} FROM clean", "clean"))
def clean_training(spark, sf_dir):
    return clean(spark, sf_dir)


# Copies added to the raw postings, as (rows, their job_id, their department).
_COPIES = [("job_id % 3 = 0", "job_id", "department"), ("job_id % 5 = 0", "CAST(NULL AS BIGINT)", "department"),
           ("job_id % 7 = 0", "job_id - 1000000", "department"),
           ("job_id % 11 = 0", "CAST(NULL AS BIGINT)", "concat('Team ', CAST(job_id AS VARCHAR(20)))"),
           ("job_id % 13 = 0", "job_id", "concat('Desk ', CAST(job_id AS VARCHAR(20)))")]
_RAW_COLUMNS = list(RULES)


def _copied(rows, key, department):
    cells = {KEY: key, "department": department}
    return [f"{cells.get(c, c)} AS {c}" for c in _RAW_COLUMNS], rows


_REPEATED = " UNION ALL ".join(
    ["SELECT * FROM once"] + [f"SELECT {', '.join(cells)} FROM once WHERE {rows}" for cells, rows in (_copied(*c) for c in _COPIES)])


@query("clean_repeated", sql(f"SELECT {_COLS} FROM clean", "clean").replace("raw AS (", "once AS (", 1).replace(
    "nulls AS (", f"raw AS ({_REPEATED}),\nnulls AS (", 1))
def clean_repeated(spark, sf_dir):
    """Postings of which many occur again: whole, without an identifier, with another one, or as another
    posting with the same identifier or none."""
    once = raw_postings(spark, sf_dir)
    both = once
    for cells, rows in (_copied(*c) for c in _COPIES):
        both = both.unionByName(once.where(rows).selectExpr(*cells))
    return ops.clean_postings(both)


@query("clean_for_scoring", sql(f"SELECT {_COLS} FROM single", "single"))
def clean_scoring(spark, sf_dir):
    return ops.clean_postings(raw_postings(spark, sf_dir), dedupe=False)


def _strict(c):
    return f"CAST(CASE {c} WHEN 't' THEN 1 WHEN 'f' THEN 0 END AS INTEGER)"


def _validation(c):
    return (f"CAST(CASE WHEN lower({c}) IN ('t', 'true', '1') THEN 1 "
            f"WHEN lower({c}) IN ('f', 'false', '0') THEN 0 END AS INTEGER)")


_FLAGS = ["telecommuting", "has_company_logo", "has_questions"]


@query("binary_parse_variants", sql("SELECT job_id, " + ", ".join(
    f"{views.flag(c)} AS {c}_default, {_validation(c)} AS {c}_validation, {_strict(c)} AS {c}_strict"
    for c in _FLAGS) + " FROM raw", "raw"))
def binary_parse_variants(spark, sf_dir):
    parsers = {"default": scalars.binary_flag, "validation": scalars.validation_flag,
               "strict": scalars.strict_flag}
    return raw_postings(spark, sf_dir).select(KEY, *[
        parse(F.col(c)).alias(f"{c}_{n}") for c in _FLAGS for n, parse in parsers.items()])


@query("text_clean_eda", sql(
    f"SELECT job_id, {views.eda('description')} AS clean_description, "
    f"CAST(length({views.eda('description')}) AS INTEGER) AS clean_desc_len FROM clean", "clean"))
def text_clean_eda(spark, sf_dir):
    cleaned = clean(spark, sf_dir).select(KEY, text.clean_eda(F.col("description")).alias("clean_description"))
    return cleaned.withColumn("clean_desc_len", text.char_count(F.col("clean_description")))


@query("text_clean_pages", f"SELECT page_id, {views.eda('html')} AS clean_html FROM pages")
def text_clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_eda(F.col("html")).alias("clean_html"))


@query("text_clean_model", sql("SELECT job_id, " + ", ".join(
    f"{views.model_text(c)} AS {c}" for c in ["title", "description", "requirements", "benefits"])
    + " FROM clean", "clean"))
def text_clean_model(spark, sf_dir):
    fields = ["title", "description", "requirements", "benefits"]
    return clean(spark, sf_dir).select(KEY, *[text.clean_model(F.col(c)).alias(c) for c in fields])


def _joined(fields, make):
    return " || ' ' || ".join(make(f"coalesce({c}, '')") for c in fields)


_FULL = _joined(["title", "description", "requirements", "benefits"], views.model_text)
_RAW_TEXT = _joined(["title", "company_profile", "description", "requirements"], lambda c: c)


@query("text_concat", sql(f"SELECT job_id, {_FULL} AS full_text, {_RAW_TEXT} AS text FROM single", "single"))
def text_concat(spark, sf_dir):
    df = ops.clean_postings(raw_postings(spark, sf_dir), dedupe=False)
    return df.select(KEY, text.cleaned_full_text().alias("full_text"), text.raw_full_text().alias("text"))


@query("word_count", sql(
    f"SELECT job_id, CAST(length(description) AS INTEGER) AS text_length, "
    f"CAST(len({views.words('description')}) AS INTEGER) AS word_count FROM single", "single"))
def word_count(spark, sf_dir):
    df = ops.clean_postings(raw_postings(spark, sf_dir), dedupe=False)
    return df.select(KEY, text.char_count(F.col("description")).alias("text_length"),
                     text.word_count(F.col("description")).alias("word_count"))


@query("salary_midpoint", sql(
    f"SELECT job_id, salary_range, {views.salary('salary_range')} AS midpoint, "
    f"coalesce({views.salary('salary_range')}, 44000.0) AS salary_processed FROM raw", "raw"))
def salary_midpoint(spark, sf_dir):
    c = F.col("salary_range")
    return raw_postings(spark, sf_dir).select(
        KEY, c, scalars.salary_midpoint(c).alias("midpoint"), scalars.salary_or(c).alias("salary_processed"))


@query("salary_median_fill", sql(
    f"""SELECT job_id, coalesce(s, (SELECT quantile_cont(s, 0.5) FROM
        (SELECT {views.salary('salary_range')} AS s FROM clean))) AS salary_processed
        FROM (SELECT job_id, {views.salary('salary_range')} AS s FROM clean)""", "clean"))
def salary_median_fill(spark, sf_dir):
    # Only the columns the median and its filling need are kept for the second read.
    narrow = settle(clean(spark, sf_dir).select(KEY, "salary_range"))
    return encode.fill_salary_median(narrow).select(KEY, "salary_processed")


@query("ordinal_codes", sql(
    """SELECT 'employment_type' AS "column", value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT coalesce(employment_type, 'Unknown') AS value FROM clean)
       UNION ALL
       SELECT 'required_education', value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER)
         FROM (SELECT DISTINCT coalesce(required_education, 'Unknown') AS value FROM clean)""", "clean"))
def ordinal_codes(spark, sf_dir):
    df = clean(spark, sf_dir).na.fill(schema.MISSING_CATEGORY, ["employment_type", "required_education"])
    both = [
        encode.category_codes(df, c).select(F.lit(c).alias("column"), "value", "code")
        for c in ("employment_type", "required_education")
    ]
    return both[0].union(both[1])


@query("category_coded_rows", sql(
    """SELECT job_id, CAST(CASE WHEN industry IS NULL THEN -1 ELSE
         (SELECT count(DISTINCT c2.industry) FROM clean c2 WHERE c2.industry < c.industry) END AS INTEGER) AS industry
       FROM clean c""", "clean"))
def category_coded_rows(spark, sf_dir):
    return encode.with_category_codes(clean(spark, sf_dir).select(KEY, "industry"), ["industry"])


_FEATURES = "job_id, salary_processed, employment_type, has_company_logo, required_education"


@query("frozen_encoding", sql(f"SELECT {_FEATURES}, fraudulent FROM enc", "enc"))
def frozen_encoding(spark, sf_dir):
    return encoded(spark, sf_dir)


@query("encode_missing_columns", sql(
    f"""SELECT job_id, CAST(44000.0 AS DOUBLE) AS salary_processed,
        {views.codes('employment_type', schema.EMPLOYMENT_CODES)} AS employment_type,
        {views.flag('has_company_logo')} AS has_company_logo, CAST(9 AS INTEGER) AS required_education
        FROM raw""", "raw"))
def encode_missing_columns(spark, sf_dir):
    partial = raw_postings(spark, sf_dir).drop("salary_range", "required_education", "not_there")
    return encode.encode_features(partial, keep=[KEY])


_META = ["location", "employment_type", "required_experience", "required_education", "industry", "function"]


@query("one_hot_counts", sql(
    "SELECT feature, ones FROM (SELECT c || '_' || v AS feature, ones, v, min(v) OVER (PARTITION BY c) AS first "
    "FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, coalesce({c}, 'Unknown') AS v, count(*) AS ones FROM clean GROUP BY ALL"
        for c in _META) + ")) WHERE v <> first", "clean"))
def one_hot_counts(spark, sf_dir):
    return encode.one_hot_counts(clean(spark, sf_dir), _META)


@query("one_hot_nonzeros", sql(
    "SELECT job_id, CAST(" + " + ".join(
        f"(CASE WHEN coalesce({c}, 'Unknown') <> (SELECT min(coalesce({c}, 'Unknown')) FROM clean) THEN 1 ELSE 0 END)"
        for c in _META) + " + telecommuting + has_company_logo + has_questions AS INTEGER) AS nonzeros FROM clean",
    "clean"))
def one_hot_nonzeros(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    df = clean(spark, sf_dir).select(KEY, *schema.METADATA_COLUMNS)
    flags = ["telecommuting", "has_company_logo", "has_questions"]
    hot = encode.one_hot(df, _META, flags)
    ones = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return hot.select(KEY, ones.cast("int").alias("nonzeros"))


@query("stratified_split", sql("SELECT job_id, fraudulent, split FROM split", "split"))
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(settle(encoded(spark, sf_dir).select(KEY, LABEL)), KEY, LABEL)


@query("stratified_folds", sql(
    """SELECT job_id, fraudulent, CAST((r >= floor(n * CAST(0.2 AS DOUBLE) + 0.5))::INT
        + (r >= floor(n * CAST(0.4 AS DOUBLE) + 0.5))::INT + (r >= floor(n * CAST(0.6 AS DOUBLE) + 0.5))::INT
        + (r >= floor(n * CAST(0.8 AS DOUBLE) + 0.5))::INT AS INTEGER) AS fold FROM ranked""", "ranked"))
def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(settle(encoded(spark, sf_dir).select(KEY, LABEL)), KEY, LABEL)


@query("exact_sample", sql(
    """SELECT job_id, fraudulent FROM (SELECT *, row_number() OVER (ORDER BY h) - 1 AS g, count(*) OVER () AS m
        FROM ranked) WHERE g < floor(m * CAST(0.3 AS DOUBLE) + 0.5)""", "ranked"))
def exact_sample(spark, sf_dir):
    return sampling.exact_sample(settle(encoded(spark, sf_dir).select(KEY, LABEL)), KEY, 0.3)
