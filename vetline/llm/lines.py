"""Removal of lines that many sites share, by DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import free_names, stored

#: log2 of the registers of a sketch; its relative standard error is 1.04 / sqrt(registers).
SKETCH_LOG2 = 10
#: Standard errors around the threshold within which the estimate is not relied on.
BAND = 6


def _parts(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_keys(line: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a line."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def _lines(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: its keys, site, document and position."""
    exploded = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("site"),
        F.xxhash64("text").alias("digest"), F.posexplode(_parts(F.col("text"))).alias("pos", "line"),
    )
    return exploded.where(F.trim("line") != "").select(
        "doc_id", "digest", "site", "pos", *_line_keys(F.col("line"))
    )


def widespread_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """(k1, k2, first): lines on at least ``min_sites`` different sites.

    A HyperLogLog sketch of the sites is merged per line. Estimates clearly above the
    threshold count as they are; lines within the band around it get an exact count
    of different sites. ``first`` is the line's first place (doc_id, pos), nulls first.
    """
    rows = _lines(docs)
    error = BAND * 1.04 / 2 ** (SKETCH_LOG2 / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = rows.groupBy("k1", "k2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_LOG2)).alias("sites"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
    ).where(F.col("sites") >= low)
    # One row per line and site before the join: a line in every document weighs no more than its sites.
    pairs = rows.select("k1", "k2", "site").distinct()
    exact = (
        pairs.join(spread.where(F.col("sites") <= high).select("k1", "k2", "first"), ["k1", "k2"])
        .groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("sites"), F.min("first").alias("first"))
        .where(F.col("sites") >= min_sites)
    )
    return spread.where(F.col("sites") > high).select("k1", "k2", "first").unionByName(
        exact.select("k1", "k2", "first")
    )


def _marked(docs: DataFrame, min_sites: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with n_lines, n_removed and kept_text under free names, and these names."""
    # Written once, so that the join below can split a line that fills many documents.
    wide = stored(widespread_lines(docs, min_sites), "lines")
    own, its_id, its_digest, gone, *new = free_names(
        docs.columns, "own", "its_id", "its_digest", "gone", "n_lines", "n_removed", "kept_text"
    )
    removed = (
        _lines(docs).join(wide, ["k1", "k2"])
        .where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias(its_id), F.col("digest").alias(its_digest))
        .agg(F.collect_set("pos").alias(gone))
    )
    joined = docs.withColumn(own, F.xxhash64("text")).join(
        removed, F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(its_digest)), "left"
    )
    parts = _parts(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    made = (
        F.size(parts), F.coalesce(F.size(F.col(gone)), F.lit(0)),
        F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(
            F.array_join(F.transform(kept, lambda i: parts[i]), "\n")
        ),
    )
    return joined.select(*docs.columns, *[m.alias(n) for m, n in zip(made, new)]), new


def mark_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """``docs`` with n_lines, n_removed and kept_text.

    Lines end at a line feed. A line on ``min_sites`` or more different sites (source;
    null counts as one site of its own, with the empty name) stays at its first place
    only, by doc_id and position; all its other occurrences go, in one document as
    well. Blank lines never count and always stay. A null text counts as empty. Rows
    equal in doc_id and text lose the same lines; null doc_ids come first. The three
    new columns replace any of the same name; other columns pass unchanged. An empty
    table gives an empty result.
    """
    marked, new = _marked(docs, min_sites)
    names = ("n_lines", "n_removed", "kept_text")
    return marked.select(
        *[c for c in docs.columns if c not in names], *[F.col(n).alias(name) for n, name in zip(new, names)]
    )


def drop_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """``docs`` with the text that is left, and n_chars (where present) to match."""
    marked, (_, n_removed, kept) = _marked(docs, min_sites)
    changed = F.col(n_removed) > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length(kept).cast(kind)).otherwise(F.col("n_chars"))
    return marked.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


ORACLE = """
WITH parts AS (
    SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
    SELECT doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts
), spread AS (
    SELECT line, count(DISTINCT site) AS sites FROM l WHERE trim(line) <> '' GROUP BY line
), marked AS (
    SELECT l.doc_id, l.line, l.pos, coalesce(s.sites >= 10, false)
        AND row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.pos) > 1 AS gone
    FROM l LEFT JOIN spread s ON l.line = s.line
)
SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (gone)::INT AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
