"""Text expressions. All take and return ``Column``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of Unicode whitespace as the source data's tools define it: Java's
# Unicode \s plus U+001C to U+001F. Property classes like this one and \p{Alpha}
# below run several times faster in Java than the same sets spelled as ranges.
_WS = r"[\s\x{1C}-\x{1F}]"
WS_RUN = f"(?U:{_WS}+)"
WS_ANY = f"(?U:{_WS}*)"


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``trim`` knows only U+0020)."""
    return F.regexp_replace(c, rf"^{WS_RUN}|{WS_RUN}\z", "")


def char_count(c: Column) -> Column:
    """Length in code points."""
    return F.char_length(c)


def tokens(c: Column) -> Column:
    """Whitespace-separated tokens without empties."""
    return F.array_remove(F.split(c, WS_RUN), "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def clean_eda(c: Column) -> Column:
    """Tags to a space, then every non-letter to a space, then lower case.

    Runs of spaces stay. A tag that spans a line break is not a tag here, so
    only its brackets go.
    """
    no_tags = F.regexp_replace(c, r"<[^\n]*?>", " ")
    return F.lower(F.regexp_replace(no_tags, r"[^\p{Alpha} ]", " "))


def clean_model(c: Column) -> Column:
    """Lower case, collapse whitespace, delete all but ``a-z 0-9`` and space, trim.

    Deleting after collapsing leaves two spaces where a lone symbol stood.
    ``Alnum`` is ASCII only, and lower case has left no capitals in it.
    """
    one_space = F.regexp_replace(F.lower(c), WS_RUN, " ")
    return F.trim(F.regexp_replace(one_space, r"[^\p{Alnum} ]", ""))


def joined(*cols: Column) -> Column:
    """Concatenate with single spaces; a null counts as an empty string."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


def cleaned_full_text(prefix: str = "") -> Column:
    """Title, description, requirements and benefits, each cleaned for the model."""
    fields = ["title", "description", "requirements", "benefits"]
    return joined(*[clean_model(F.coalesce(F.col(prefix + f), F.lit(""))) for f in fields])


def raw_full_text(prefix: str = "") -> Column:
    """Title, company profile, description and requirements as they are."""
    fields = ["title", "company_profile", "description", "requirements"]
    return joined(*[F.col(prefix + f) for f in fields])
