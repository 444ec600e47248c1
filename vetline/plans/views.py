"""Shared inputs of the registered queries, and their SQL twins.

``sql(body, upto)`` puts the common table expressions a check query needs in
front of its body.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline import schema
from vetline.operators.clean import clean_postings
from vetline.operators.encode import encode_features
from vetline.operators.sampling import stratified_split
from vetline.plans.postings import RULES, raw_postings
from vetline.runtime import settle

KEY, LABEL = "job_id", "fraudulent"


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_postings(raw_postings(spark, sf_dir))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, label and the four features of the cleaned, deduplicated postings."""
    return encode_features(clean(spark, sf_dir), keep=[KEY, LABEL])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores a query language can state, to check the evaluation operators.

    Lower is more anomalous, as with the models.
    """
    off = F.abs(F.col("salary_processed") - 44000.0)
    logo, emp, edu = (F.col(c) for c in ("has_company_logo", "employment_type", "required_education"))
    return encoded(spark, sf_dir).withColumns({
        "score_a": -(off + 5000 * (1 - logo) + 1000 * emp + 500 * edu),
        "score_b": -(off + 3000 * emp),
    })


def split_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Cut points and split read the rows several times; the texts are read once.
    return stratified_split(settle(scored(spark, sf_dir)), KEY, LABEL)


# --- SQL twins ------------------------------------------------------------

# The code points of Unicode whitespace, for an engine without the property.
WS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
EDGE = rf"^{WS}+|{WS}+\z"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(c: str) -> str:
    return f"regexp_replace({c}, '{EDGE}', '', 'g')"


def flag(c: str) -> str:
    return f"CAST(CASE WHEN lower({strip(c)}) IN ('t', 'true', '1', '1.0') THEN 1 ELSE 0 END AS INTEGER)"


def salary(c: str) -> str:
    side = r"\+?([0-9]+(?:_[0-9]+)*)"
    pattern = rf"^{WS}*{side}{WS}*-{WS}*{side}{WS}*\z"
    part = "CAST(replace(regexp_extract({c}, '{p}', {i}), '_', '') AS DOUBLE)"
    a, b = (part.format(c=c, p=pattern, i=i) for i in (1, 2))
    return f"CASE WHEN regexp_matches({c}, '{pattern}') THEN ({a} + {b}) / 2 END"


def codes(c: str, table: dict[str, int]) -> str:
    arms = " ".join(f"WHEN {quoted([k])} THEN {v}" for k, v in table.items())
    return f"CAST(CASE {c} {arms} ELSE {table[schema.MISSING_CATEGORY]} END AS INTEGER)"


def eda(c: str) -> str:
    return (f"lower(regexp_replace(regexp_replace({c}, '<[^\\n]*?>', ' ', 'g'),"
            f" '[^a-zA-Z ]', ' ', 'g'))")


def model_text(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower({c}), '{WS}+', ' ', 'g'),"
            f" '[^a-z0-9 ]', '', 'g'))")


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def single(c: str) -> str:
    """Single precision, as a double."""
    return f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"


def _nulls() -> str:
    cells = [KEY] + [
        f"CASE WHEN {c} NOT IN ({quoted(schema.NULL_TOKENS)}) THEN {c} END AS {c}"
        for c in schema.RAW_COLUMNS
    ]
    return f"SELECT {', '.join(cells)} FROM raw"


def _single() -> str:
    cells = [KEY]
    for c in schema.RAW_COLUMNS:
        if c in schema.BINARY_COLUMNS:
            cells.append(f"{flag(c)} AS {c}")
        elif c in schema.TEXT_COLUMNS:
            cells.append(f"coalesce({c}, 'Unspecified') AS {c}")
        else:
            cells.append(c)
    first = strip("split_part(location, ',', 1)")
    cells.append(f"CASE WHEN location IS NULL OR {first} = '' THEN 'Unknown' ELSE {first} END AS country")
    cells.append("CAST(length(coalesce(description, 'Unspecified')) AS INTEGER) AS desc_len")
    return f"SELECT {', '.join(cells)} FROM nulls"


CLEAN_COLUMNS = [*schema.RAW_COLUMNS, "country", "desc_len"]


def features_sql(source: str) -> str:
    return f"""SELECT {KEY}, {LABEL},
        coalesce({salary('salary_range')}, 44000.0) AS salary_processed,
        {codes('employment_type', schema.EMPLOYMENT_CODES)} AS employment_type,
        has_company_logo,
        {codes('required_education', schema.EDUCATION_CODES)} AS required_education
        FROM {source}"""


CTES = {
    "raw": f"SELECT {', '.join(f'{r} AS {c}' for c, r in RULES.items())} "
           "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "nulls": _nulls(),
    "single": _single(),
    "clean": f"SELECT min({KEY}) AS {KEY}, {', '.join(CLEAN_COLUMNS)} FROM single "
             f"GROUP BY {', '.join(CLEAN_COLUMNS)}",
    "enc": features_sql("clean"),
    "scored": """SELECT *,
        -(abs(salary_processed - 44000.0) + 5000 * (1 - has_company_logo) + 1000 * employment_type
          + 500 * required_education) AS score_a,
        -(abs(salary_processed - 44000.0) + 3000 * employment_type) AS score_b FROM enc""",
    "ranked": f"""SELECT *, md5('42:' || CAST({KEY} AS VARCHAR)) AS h,
        row_number() OVER (PARTITION BY {LABEL} ORDER BY md5('42:' || CAST({KEY} AS VARCHAR))) - 1 AS r,
        count(*) OVER (PARTITION BY {LABEL}) AS n FROM scored""",
    "split": """SELECT *, CASE WHEN r < floor(n * CAST(0.7 AS DOUBLE) + 0.5) THEN 'train'
        WHEN r < floor(n * CAST(0.85 AS DOUBLE) + 0.5) THEN 'val' ELSE 'test' END AS split FROM ranked""",
}


def sql(body: str, upto: str, extra: dict[str, str] | None = None) -> str:
    names = list(CTES)
    parts = {n: CTES[n] for n in names[: names.index(upto) + 1]} | (extra or {})
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts.items()) + f"\n{body}"
