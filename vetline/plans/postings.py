"""The posting table as a view over the ``documents`` and ``labels`` tables.

The test tables hold no postings, so every attribute is made up from a
document's length by a fixed rule; the description is the document's whole
text, the title its first line. The rules are SQL expressions that Spark and the checking engine share.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Attribute rules; d is documents, l is labels.
RULES = {
    "job_id": "d.doc_id",
    "title": "split_part(d.text, chr(10), 1)",
    "location": """CASE d.n_chars % 6 WHEN 0 THEN 'US, NY, New York' WHEN 1 THEN 'GB, LND, London'
        WHEN 2 THEN ' DE , BE, Berlin' WHEN 3 THEN ', CA, Toronto' WHEN 5 THEN 'unknown' END""",
    "department": """CASE d.n_chars % 4 WHEN 0 THEN 'Sales' WHEN 1 THEN 'Engineering' WHEN 2 THEN '' END""",
    "salary_range": """CASE d.n_chars % 8 WHEN 0 THEN '60000-90000' WHEN 1 THEN '500000-1000000'
        WHEN 2 THEN 'not-a-number' WHEN 3 THEN '' WHEN 5 THEN '30000 - 45000' WHEN 6 THEN '1000-1500.5'
        WHEN 7 THEN concat(CAST(20000 + (d.n_chars % 50) * 1000 AS VARCHAR(20)), '-',
                           CAST(30000 + (d.n_chars % 70) * 1000 AS VARCHAR(20))) END""",
    "company_profile": """CASE d.n_chars % 3 WHEN 0 THEN 'None'
        WHEN 1 THEN concat('Company ', CAST(d.n_chars % 97 AS VARCHAR(20))) END""",
    "description": """CASE WHEN d.n_chars % 3 = 0 THEN concat('<p>', d.text, '</p>')
        WHEN d.n_chars % 11 = 0 THEN ' ' ELSE d.text END""",
    "requirements": "CASE WHEN d.n_chars % 2 = 0 THEN concat('Needed: ', d.text) END",
    "benefits": """CASE d.n_chars % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'Unknown'
        WHEN 3 THEN 'Paid leave - 401(k)' WHEN 4 THEN 'Paid leave - 401(k)' END""",
    "telecommuting": """CASE d.n_chars % 4 WHEN 0 THEN 't' WHEN 1 THEN 'f' WHEN 2 THEN ' T ' END""",
    "has_company_logo": """CASE d.n_chars % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 't' WHEN 2 THEN '1'
        WHEN 3 THEN '0' WHEN 4 THEN 'yes' END""",
    "has_questions": """CASE d.n_chars % 3 WHEN 0 THEN 'f' WHEN 1 THEN 't' WHEN 2 THEN 'unknown' END""",
    "employment_type": """CASE d.n_chars % 8 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time'
        WHEN 2 THEN 'Contract' WHEN 3 THEN 'Temporary' WHEN 4 THEN 'Other' WHEN 6 THEN 'full-time'
        WHEN 7 THEN 'Unknown' END""",
    "required_experience": """CASE d.n_chars % 3 WHEN 0 THEN 'Entry level' WHEN 1 THEN 'Mid-Senior level' END""",
    "required_education": """CASE d.n_chars % 16 WHEN 0 THEN 'Associate Degree'
        WHEN 1 THEN 'Bachelor''s Degree' WHEN 2 THEN 'Certification' WHEN 3 THEN 'Doctorate'
        WHEN 4 THEN 'High School or equivalent' WHEN 5 THEN 'Master''s Degree'
        WHEN 6 THEN 'Professional' WHEN 7 THEN 'Some College Coursework Completed'
        WHEN 8 THEN 'Some High School Coursework' WHEN 10 THEN 'Unspecified' WHEN 11 THEN 'Vocational'
        WHEN 12 THEN 'Vocational - Degree' WHEN 13 THEN 'Vocational - HS Diploma'
        WHEN 14 THEN 'PhD' WHEN 15 THEN 'Unknown' END""",
    "industry": """CASE d.n_chars % 5 WHEN 0 THEN 'Oil & Energy' WHEN 1 THEN 'Accounting'
        WHEN 2 THEN 'Internet' WHEN 4 THEN 'none' END""",
    "function": """CASE d.n_chars % 4 WHEN 0 THEN 'Administrative' WHEN 1 THEN 'Engineering'
        WHEN 3 THEN 'Sales' END""",
    "fraudulent": "CASE l.toxic WHEN 1 THEN 't' WHEN 0 THEN 'f' END",
    "in_balanced_dataset": "CASE l.quality WHEN 1 THEN 't' WHEN 0 THEN 'f' END",
}

#: The same first line; Spark looks no further than its end, where ``split_part`` cuts the whole text into lines.
FIRST_LINE = "substring_index(d.text, chr(10), 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    # Only as a pattern may a stream's path be a single file; this one fits nothing else.
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def postings_of(documents: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Raw postings; without labels the two label columns are left out."""
    rules = RULES | {"title": FIRST_LINE}
    rows = documents.alias("d")
    if labels is None:
        rules = {c: r for c, r in rules.items() if not r.startswith("CASE l.")}
    else:
        rows = rows.join(labels.alias("l"), F.expr("d.doc_id = l.doc_id"), "left")
    return rows.select(*[F.expr(rule).alias(c) for c, rule in rules.items()])


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
