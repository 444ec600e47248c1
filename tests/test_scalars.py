"""Edge cases with exact expectations."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetline import schema
from vetline.functions import scalars, text


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


CASES = [
    (scalars.null_tokens, {"": None, " ": None, "none": None, "None": None, "NaN": None, "unknown": None,
                           "Unknown": None, "NONE": "NONE", " Unknown": " Unknown", "  ": "  ", None: None}),
    (scalars.binary_flag, {"t": 1, " T ": 1, "TRUE": 1, "1": 1, "1.0": 1, "f": 0, "False": 0, "0": 0, "0.0": 0,
                           "yes": 0, "2": 0, None: 0, " t　": 1}),
    (scalars.validation_flag, {"T": 1, "True": 1, "F": 0, " t": None, "yes": None, None: None}),
    (scalars.strict_flag, {"t": 1, "f": 0, "T": None, "1": None, None: None}),
    (scalars.country, {"US, NY, New York": "US", " DE , BE": "DE", ", CA": "Unknown", None: "Unknown",
                       "GB": "GB", "": "Unknown"}),
    (text.char_count, {"Unspecified": 11, "\U0001F600": 1, "": 0}),
    (text.word_count, {" a  b\n": 2, "": 0, "a b": 2, "\x1ca　b c": 3, "   ": 0}),
    (text.clean_eda, {"<b>Hi</b> 2U": " hi   u", "<a\nb>x": " a b x", "é": " ", "<i> </i>A": "   a"}),
    (text.clean_model, {"A - B": "a  b", " C++\tdev! ": "c dev", "é": "", "x \ny": "x y"}),
    (scalars.salary_midpoint, {
        "60000-90000": 75000.0, "30000 - 45000": 37500.0, "+5-10": 7.5, "1-2-3": None, "-5-10": None, "a-b": None,
        "Oct-15": None, "1000-1500.5": None, "": None, None: None, "1_000-2_000": 1500.0, "5-": None, "90-10": 50.0,
        "9007199254740993-9007199254740993": 9007199254740992.0,
        "1" + "0" * 40 + "-0": 5e39, "1" + "0" * 400 + "-0": None}),
    (scalars.salary_or, {"not-a-number": 44000.0, None: 44000.0, "1-3": 2.0}),
    (scalars.employment_code, {**schema.EMPLOYMENT_CODES, "full-time": 5, None: 5, " Other": 5}),
    (scalars.education_code, {**schema.EDUCATION_CODES, "PhD": 9, None: 9}),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_edge_cases(spark, fn, cases):
    assert dict(zip(cases, apply(spark, fn, list(cases)))) == cases


def test_numbers(spark):
    row = spark.range(1).select(
        scalars.round_even(F.lit(0.03125), 4), scalars.round_even(F.lit(0.00015), 4),
        scalars.safe_ratio(F.lit(3), F.lit(0)), scalars.guarded_ratio(F.lit(0), F.lit(0)),
        scalars.flagged(F.lit(-1)), scalars.flagged(F.lit(1)),
        scalars.over_threshold(F.lit(2.0), F.lit(2.0)), scalars.cutoff_label(F.lit(85)),
    ).first()
    assert list(row) == [0.0312, float(np.round(0.00015, 4)), 0.0, 0.0, 1, 0, 1, "top 15%"]


def test_joined_text(spark):
    df = spark.createDataFrame(
        [("A!", None, "d  d", "r", None)], "title string, company_profile string, description string, "
        "requirements string, benefits string")
    assert list(df.select(text.cleaned_full_text(), text.raw_full_text()).first()) == ["a d d r ", "A!  d  d r"]


def test_character_classes_cover_all_code_points(spark):
    points = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(points)], "i int, c string")
    rows = df.select(
        "i", (F.regexp_replace("c", text.WS_RUN, "") == "").alias("ws"), text.clean_eda(F.col("c")).alias("eda"),
        text.clean_model(F.concat(F.lit("x"), F.col("c"), F.lit("x"))).alias("model")).orderBy("i").collect()
    for c, r in zip(points, rows):
        assert r.ws == bool(re.match(r"\s", c)), repr(c)
        assert r.eda == re.sub("[^a-zA-Z ]", " ", c).lower(), repr(c)
        want = re.sub(r"[^a-z0-9\s]", "", re.sub(r"\s+", " ", f"x{c}x".lower()))
        assert r.model == want, repr(c)
