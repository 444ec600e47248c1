"""Scalar expressions over posting columns. All take and return ``Column``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetline import schema
from vetline.functions.text import WS_ANY, strip


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table(values: dict[str, int]) -> Column:
    """A constant map."""
    return F.expr(f"map({', '.join(f'{quoted(k)}, {v}' for k, v in values.items())})")


def token_set(tokens) -> Column:
    """A constant array of strings."""
    return F.expr(f"array({', '.join(map(quoted, tokens))})")


def null_tokens(c: Column, tokens: Column | None = None) -> Column:
    """Whole-cell missing markers become null.

    A lookup in a constant array: unlike a short ``IN`` list it is not unrolled,
    which keeps the generated code of a wide table small enough to be compiled.
    """
    tokens = token_set(schema.NULL_TOKENS) if tokens is None else tokens
    return F.when(~F.array_contains(tokens, c), c)


def binary_flag(
    c: Column,
    true=tuple(schema.TRUE_TOKENS),
    false=tuple(schema.FALSE_TOKENS),
    trim: bool = True,
    lower: bool = True,
    default: int | None = 0,
    decimals: bool = True,
) -> Column:
    """Parse a textual flag to 0/1.

    Unknown spellings become ``default``. With ``decimals`` the spellings ``1.0``
    and ``0.0``, which a float-typed reader produces, count as flags too. One
    pattern match per value keeps the generated code of many flags short.
    """
    def spelled(tokens) -> Column:
        tokens = [*tokens, *[f"{t}.0" for t in tokens if decimals and t in ("0", "1")]]
        edge, case = WS_ANY if trim else "", "i" if lower else ""
        body = "|".join(t.replace(".", r"\.") for t in tokens)
        return c.cast("string").rlike(rf"^{edge}(?{case}:{body}){edge}\z")

    if default == 0:
        return F.coalesce(spelled(true), F.lit(False)).cast("int")
    parsed = F.when(spelled(true), 1).when(spelled(false), 0)
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def validation_flag(c: Column) -> Column:
    """Lower-cased but not trimmed; unknown spellings stay null."""
    return binary_flag(c, trim=False, default=None, decimals=False)


def strict_flag(c: Column) -> Column:
    """Only the exact letters ``t`` and ``f``; everything else stays null."""
    return binary_flag(
        c, true=("t",), false=("f",), trim=False, lower=False, default=None
    )


def country(location: Column) -> Column:
    """Text before the first comma, trimmed; nothing there means Unknown."""
    first = strip(F.substring_index(location, ",", 1))
    return F.coalesce(
        F.when(first != "", first), F.lit(schema.MISSING_CATEGORY)
    )


_INT = r"\+?([0-9]+(?:_[0-9]+)*)"
_RANGE = rf"^{WS_ANY}{_INT}{WS_ANY}-{WS_ANY}{_INT}{WS_ANY}\z"


def salary_midpoint(c: Column) -> Column:
    """Midpoint of ``low-high`` when both sides are integers, else null.

    Numbers are doubles throughout; one too large for a double counts as malformed.
    """
    low, high = (
        F.replace(F.regexp_extract(c, _RANGE, i), F.lit("_"), F.lit("")).try_cast("double") for i in (1, 2)
    )
    total = low + high
    return F.when(c.rlike(_RANGE) & (F.abs(total) < F.lit(float("inf"))), total / 2)


def salary_or(c: Column, fallback: float = schema.TRAIN_SALARY_MEDIAN) -> Column:
    """Midpoint, or the frozen training median."""
    return F.coalesce(salary_midpoint(c), F.lit(float(fallback)))


def code_of(c: Column, codes: dict[str, int], default: int) -> Column:
    """Dictionary lookup with a default."""
    return F.coalesce(F.try_element_at(_table(codes), c), F.lit(default))


def employment_code(c: Column) -> Column:
    codes = schema.EMPLOYMENT_CODES
    return code_of(c, codes, codes[schema.MISSING_CATEGORY])


def education_code(c: Column) -> Column:
    codes = schema.EDUCATION_CODES
    return code_of(c, codes, codes[schema.MISSING_CATEGORY])


def round_even(c: Column, digits: int) -> Column:
    """Round by scaling and rounding half to even."""
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def guarded_ratio(num: Column, den: Column) -> Column:
    """``num / (den + 1e-9)``: zero instead of an error on an empty denominator."""
    return num / (den + F.lit(1e-9))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` with zero for a zero denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def flagged(label: Column) -> Column:
    """Outlier label -1/1 to fraud label 1/0."""
    return (label == -1).cast("int")


def over_threshold(score: Column, threshold: Column) -> Column:
    """1 where the score reaches the threshold."""
    return (score >= threshold).cast("int")


def cutoff_label(percentile: Column) -> Column:
    """``top 15%`` for the 85th percentile."""
    return F.format_string("top %d%%", (F.lit(100) - percentile).cast("int"))
