"""Rows with the awkward cases every operator has to take."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make themselves, here as plain extra ones.
EXTRA = ("score", "ids", "fp", "hits", "kept_text", "n_removed", "spans", "digest", "doc", "rid", "shard")

WORDS = "the quick brown fox jumps over a lazy dog while seven grey wolves watch from behind tall pine trees near water".split()


def long_text(seed: int, n: int) -> str:
    return " ".join(f"{WORDS[(i * seed + i // 7) % len(WORDS)]}{(i * i * seed) % 97}" for i in range(n))


ROWS = [
    (1, long_text(3, 80), "en", "a", 5),
    (2, long_text(3, 80), "en", "b", None),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "   \n\n \t ", "en", None, 7),
    (6, "word", "de", "c", 4),
    (7, long_text(5, 6000), "de", "c", 1),
    (8, "á é́ 漢字 😀 ﬁ \x00 " + long_text(7, 60), "fr", "d", 1),
    (9, long_text(3, 79) + " changed", "en", "e", 1),
    (10, "Line one\nLine one\nother\n", None, "a", 3),
    (10, "Line one\nLine one\nother\n", None, "a", 3),
    (None, long_text(11, 50), "en", "f", 2),
    (None, None, None, None, None),
    (-5, long_text(13, 120) + "\n" + long_text(3, 40), "en", "g", 9),
]


def clashing(docs):
    """The same rows with extra columns whose names operators use."""
    return docs.select("*", *[F.lit("x").alias(c) for c in EXTRA])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
