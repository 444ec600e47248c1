"""Registered queries: profiling tables."""

from pyspark.sql import functions as F

from vetline import schema
from vetline.functions import text
from vetline.operators import clean as ops
from vetline.operators import profile
from vetline.operators.ordered import exact_quantiles
from vetline.plans import views
from vetline.plans.postings import raw_postings, table
from vetline.plans.views import CLEAN_COLUMNS, KEY, LABEL, clean, encoded, quoted, single, sql
from vetline.runtime import settle

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


_ALL = [KEY, *CLEAN_COLUMNS]
_NUMERIC = ["telecommuting", "has_company_logo", "has_questions", "fraudulent", "desc_len"]
_FEATURES = schema.FEATURES


def _union(parts):
    return " UNION ALL ".join(parts)


@query("null_profile", sql(_union(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM clean" for c in _ALL), "clean"))
def null_profile(spark, sf_dir):
    return profile.null_counts(clean(spark, sf_dir))


def _type(c):
    return "bigint" if c == KEY else "int" if c in [*schema.BINARY_COLUMNS, "desc_len"] else "string"


@query("column_profile", sql(_union(
    f"SELECT '{c}' AS \"column\", '{_type(c)}' AS dtype, count({c}) AS non_null, count(*) AS rows FROM clean"
    for c in _ALL), "clean"))
def column_profile(spark, sf_dir):
    return profile.column_profile(clean(spark, sf_dir))


def _describe_sql(columns, source):
    return _union(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {single(f"avg({c})")} AS mean,
            {single(f"stddev_samp({c})")} AS std, CAST(min({c}) AS DOUBLE) AS min,
            {single(f"quantile_cont(CAST({c} AS DOUBLE), 0.25)")} AS q25,
            {single(f"quantile_cont(CAST({c} AS DOUBLE), 0.5)")} AS q50,
            {single(f"quantile_cont(CAST({c} AS DOUBLE), 0.75)")} AS q75,
            CAST(max({c}) AS DOUBLE) AS max FROM {source}""" for c in columns)


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _describe(df, columns):
    # Single precision drops the noise of the order of summation at any magnitude.
    cols = ["mean", "std", "q25", "q50", "q75"]
    return profile.describe(df, columns).withColumns({c: F.col(c).cast("float").cast("double") for c in cols})


@query("describe_numeric", sql(_describe_sql(_NUMERIC, "clean"), "clean"))
def describe_numeric(spark, sf_dir):
    df = clean(spark, sf_dir).drop("in_balanced_dataset", KEY)
    return _describe(df, profile.numeric_columns(df))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_lineitem", _describe_sql(_MEASURES, "lineitem"))
def describe_lineitem(spark, sf_dir):
    return _describe(table(spark, sf_dir, "lineitem"), _MEASURES)


def _counts_sql(column, source, limit=""):
    return (f"SELECT {column}, count(*) AS count FROM {source} WHERE {column} IS NOT NULL "
            f"GROUP BY {column} ORDER BY count DESC, {column} {limit}")


@query("value_counts_country", sql(_counts_sql("country", "clean"), "clean"))
def value_counts_country(spark, sf_dir):
    return profile.value_counts(clean(spark, sf_dir), "country")


@query("value_counts_label", sql(_counts_sql(LABEL, "clean"), "clean"))
def value_counts_label(spark, sf_dir):
    return profile.value_counts(clean(spark, sf_dir), LABEL)


@query("top_locations", sql(_counts_sql("location", "clean", "LIMIT 10"), "clean"))
def top_locations(spark, sf_dir):
    return profile.top_values(clean(spark, sf_dir), "location", 10)


@query("preview_rows", sql("SELECT job_id, title, country, desc_len FROM clean ORDER BY job_id LIMIT 5", "clean"))
def preview_rows(spark, sf_dir):
    return profile.preview(clean(spark, sf_dir).select(KEY, "title", "country", "desc_len"), [KEY], 5)


@query("length_by_label", sql(
    f"""SELECT fraudulent, count(*) AS rows, round(avg(length({views.eda('description')})), 6)
        AS mean_clean_desc_len FROM clean GROUP BY fraudulent""", "clean"))
def length_by_label(spark, sf_dir):
    length = text.char_count(text.clean_eda(F.col("description")))
    means = profile.group_mean(clean(spark, sf_dir), LABEL, length, "mean_clean_desc_len")
    return _rounded(means, ["mean_clean_desc_len"])


@query("feature_means_by_label", sql(_union(
    f"""SELECT '{f}' AS feature, round(avg({f}) FILTER (fraudulent = 0), 6) AS "Legitimate",
        round(avg({f}) FILTER (fraudulent = 1), 6) AS "Fraudulent" FROM enc""" for f in _FEATURES), "enc"))
def feature_means_by_label(spark, sf_dir):
    return _rounded(profile.feature_means(encoded(spark, sf_dir), _FEATURES), ["Legitimate", "Fraudulent"])


def _corr_sql(a, b):
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 6) END"


@query("corr_matrix", sql(_union(
    f"SELECT '{a}' AS a, '{b}' AS b, {_corr_sql(a, b)} AS corr FROM clean" for a in _NUMERIC for b in _NUMERIC),
    "clean"))
def corr_matrix(spark, sf_dir):
    df = clean(spark, sf_dir).drop("in_balanced_dataset", KEY)
    return _rounded(profile.correlations(df), ["corr"])


@query("corr_with_target", sql(_union(
    f"SELECT '{a}' AS feature, {_corr_sql(a, LABEL)} AS corr FROM clean" for a in _NUMERIC), "clean"))
def corr_with_target(spark, sf_dir):
    df = clean(spark, sf_dir).drop("in_balanced_dataset", KEY)
    return _rounded(profile.correlation_with(df, LABEL), ["corr"])


@query("corr_lineitem", _union(
    f"SELECT '{a}' AS a, '{b}' AS b, {_corr_sql(a, b)} AS corr FROM lineitem" for a in _MEASURES for b in _MEASURES))
def corr_lineitem(spark, sf_dir):
    return _rounded(profile.correlations(table(spark, sf_dir, "lineitem"), _MEASURES), ["corr"])


_WORDS = f"SELECT unnest({views.words(views.eda('description'))}) AS word FROM clean"


@query("word_frequency", sql(f"SELECT word, count(*) AS count FROM ({_WORDS}) GROUP BY word", "clean"))
def word_frequency(spark, sf_dir):
    return profile.word_frequency(clean(spark, sf_dir), text.tokens(text.clean_eda(F.col("description"))))


# The English list ships with Spark ML and is read from the running session, so
# its SQL twin drops only the fixed junk words.
@query("top_words", sql(
    f"""SELECT word, count(*) AS count FROM ({_WORDS}) WHERE word NOT IN ({quoted(schema.JUNK_WORDS)})
        GROUP BY word ORDER BY count DESC, word LIMIT 20""", "clean"))
def top_words(spark, sf_dir):
    return profile.top_words(
        clean(spark, sf_dir), text.clean_eda(F.col("description")), 20, list(schema.JUNK_WORDS))


@query("top_words_without_stop_words", sql(
    f"""SELECT word, count(*) AS count FROM ({_WORDS})
        WHERE word NOT IN ({quoted([*schema.STOP_WORDS, *schema.JUNK_WORDS])})
        GROUP BY word ORDER BY count DESC, word LIMIT 20""", "clean"))
def top_words_without_stop_words(spark, sf_dir):
    return profile.top_words(clean(spark, sf_dir), text.clean_eda(F.col("description")), 20)


def _histogram_sql(value, bins, source):
    return f"""
        SELECT CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / {bins}, 6) AS lo,
               round(lo + (b + 1) * (hi - lo) / {bins}, 6) AS hi, count(x) AS count
        FROM (SELECT CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM {source})
        CROSS JOIN range({bins}) AS t(b)
        LEFT JOIN (SELECT CAST({value} AS DOUBLE) AS x,
                     least(floor((x - min(x) OVER ()) * {bins} / (max(x) OVER () - min(x) OVER ())), {bins} - 1) AS bx
                   FROM {source}) ON bx = b
        GROUP BY b, lo, hi"""


@query("length_histogram", sql(_histogram_sql(f"length({views.eda('description')})", 10, "clean"), "clean"))
def length_histogram(spark, sf_dir):
    length = text.char_count(text.clean_eda(F.col("description")))
    # The lengths are read twice (limits, bins); the texts only once.
    narrow = settle(clean(spark, sf_dir).select(length.alias("n")))
    return _rounded(profile.histogram(narrow, F.col("n"), 10), ["lo", "hi"])


@query("word_count_histogram", sql(_histogram_sql(f"len({views.words('description')})", 30, "clean"), "clean"))
def word_count_histogram(spark, sf_dir):
    narrow = settle(clean(spark, sf_dir).select(text.word_count(F.col("description")).alias("n")))
    return _rounded(profile.histogram(narrow, F.col("n"), 30), ["lo", "hi"])


@query("length_boxplot", sql(
    f"""SELECT s.fraudulent, q1, median, q3,
          CASE WHEN min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) > q1 THEN q1
            ELSE min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) END AS whisker_low,
          CASE WHEN max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) < q3 THEN q3
            ELSE max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) END AS whisker_high,
          count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM lens s JOIN (SELECT fraudulent, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
          quantile_cont(x, 0.75) AS q3 FROM lens GROUP BY fraudulent) q ON q.fraudulent = s.fraudulent
        GROUP BY s.fraudulent, q1, median, q3""", "clean",
    {"lens": f"SELECT fraudulent, CAST(length({views.eda('description')}) AS DOUBLE) AS x FROM clean"}))
def length_boxplot(spark, sf_dir):
    return profile.box_stats(
        clean(spark, sf_dir), text.char_count(text.clean_eda(F.col("description"))), LABEL)


@query("class_weights", sql(
    """SELECT fraudulent, count(*) AS count, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
       FROM clean GROUP BY fraudulent""", "clean"))
def class_weights(spark, sf_dir):
    return _rounded(profile.class_weights(clean(spark, sf_dir)), ["weight"])


@query("distinct_classes", sql("SELECT DISTINCT fraudulent FROM clean", "clean"))
def distinct_classes(spark, sf_dir):
    return profile.distinct_classes(clean(spark, sf_dir))


@query("fraud_rate", sql(
    "SELECT count(*) AS rows, CAST(sum(fraudulent) AS BIGINT) AS fraud, round(avg(fraudulent), 6) AS rate FROM clean",
    "clean"))
def fraud_rate(spark, sf_dir):
    return _rounded(profile.fraud_rate(clean(spark, sf_dir)), ["rate"])


_DECILES = [i / 10 for i in range(1, 10)]
_BINNED = " + ".join(f"(s >= q[{i}])::INT" for i in range(1, 10))


@query("mutual_information", sql(
    _union(f"""SELECT feature, round(sum(n / na * ln(n * na / (nx * ny))), 6) AS mutual_info FROM (
        SELECT '{name}' AS feature, CAST(count(*) AS DOUBLE) AS n,
          CAST(sum(count(*)) OVER () AS DOUBLE) AS na, CAST(sum(count(*)) OVER (PARTITION BY {c}) AS DOUBLE) AS nx,
          CAST(sum(count(*)) OVER (PARTITION BY fraudulent) AS DOUBLE) AS ny
        FROM binned GROUP BY {c}, fraudulent) GROUP BY feature""" for name, c in [
            ("salary_processed", "salary_bin"), ("employment_type", "employment_type"),
            ("has_company_logo", "has_company_logo"), ("required_education", "required_education")]),
    "enc", {"binned": f"""SELECT *, {_BINNED} AS salary_bin FROM (SELECT *, salary_processed AS s,
        (SELECT quantile_cont(salary_processed, [{', '.join(map(str, _DECILES))}]) FROM enc) AS q FROM enc)"""}))
def mutual_information(spark, sf_dir):
    df = settle(encoded(spark, sf_dir))
    deciles = exact_quantiles(df, F.col("salary_processed"), _DECILES).select("quantiles").scalar()
    cuts = [F.col("_q")[i] for i in range(9)]
    salary_bin = profile.binned(F.col("salary_processed"), cuts)
    binned = df.withColumn("_q", deciles).withColumn("salary_processed", salary_bin).drop("_q")
    return _rounded(profile.mutual_information(binned, _FEATURES), ["mutual_info"])


@query("crosstab_labels", sql(
    """SELECT in_balanced_dataset, count(*) FILTER (fraudulent = 0) AS fraudulent_0,
       count(*) FILTER (fraudulent = 1) AS fraudulent_1 FROM clean GROUP BY in_balanced_dataset""", "clean"))
def crosstab_labels(spark, sf_dir):
    return profile.crosstab(clean(spark, sf_dir), "in_balanced_dataset", LABEL, [0, 1])


@query("null_profile_raw", sql(_union(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM nulls" for c in [KEY, *schema.RAW_COLUMNS]),
    "nulls"))
def null_profile_raw(spark, sf_dir):
    return profile.null_counts(ops.standardise_nulls(raw_postings(spark, sf_dir)))
