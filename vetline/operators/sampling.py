"""Stratified splits, folds and exact samples by hash order.

Rows are ordered by a digest of (seed, key). A part of a class is a range of
that order, so it has an exact size, needs no sort of the table, and does not
change when the table is read in another order. The cut points are found from
counts per digest prefix; only the rows in the prefix a cut falls into are
ranked. There are about as many prefixes as rows share one, at every size of the table.
``key`` must identify a row; see ``with_row_key`` where there is none.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetline.runtime import settle

MAP_CLASSES = 10_000  # the largest classes, whose cut points travel with every task


def digest(key: Column, seed: int) -> Column:
    """Hex digest that puts the rows in a seeded random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def _cuts(df: DataFrame, label: Column, key: str, bounds: list[float], seed: int, digits: int | None) -> DataFrame:
    """One row per class: ``_cut``, the first digest of each part after the first.

    A cut past the last row of its class is null.
    """
    rows = df.select(
        F.struct(label.alias("_label")).alias("_class"), digest(F.col(key), seed).alias("_h")
    )
    # Hex digits that give some sqrt(rows) prefixes, so that some sqrt(rows) rows share each.
    chosen = F.lit(digits) if digits else rows.agg(
        F.greatest(F.lit(1), F.ceil(F.log(16.0, F.greatest(F.count(F.lit(1)), F.lit(1))) / 2)).cast("int")
    ).scalar()
    rows = rows.withColumn("_digits", chosen).withColumn("_prefix", F.expr("substring(_h, 1, _digits)")).drop("_digits")
    counts = rows.groupBy("_class", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    # Some sqrt(rows) prefixes per class in this window.
    upto = Window.partitionBy("_class").orderBy("_prefix")
    whole = Window.partitionBy("_class")
    ranked = counts.withColumns({
        "_end": F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0)),
        "_all": F.sum("_n").over(whole),
    })
    # Parts take round-half-up shares; a cut is the 0-based rank it starts at.
    starts = F.array(*[
        F.struct(F.lit(i).alias("_part"), F.floor(F.col("_all") * F.lit(b) + 0.5).alias("_rank"))
        for i, b in enumerate(bounds)
    ])
    hit = ranked.select("*", F.inline(starts)).where(
        (F.col("_end") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_end"))
    ).select(
        "_class", "_prefix", "_part",
        (F.col("_rank") - F.col("_end") + F.col("_n") + 1).alias("_nth"),
    )
    # Only rows that share a cut's prefix: some sqrt(rows) of the class.
    near = rows.join(hit, ["_class", "_prefix"])
    nth = F.row_number().over(Window.partitionBy("_class", "_part").orderBy("_h"))
    found = near.withColumn("_i", nth).where(F.col("_i") == F.col("_nth"))
    per_class = found.groupBy("_class").agg(
        F.map_from_entries(F.collect_list(F.struct("_part", "_h"))).alias("_at")
    )
    at = F.array(*[F.try_element_at("_at", F.lit(i)) for i in range(len(bounds))])
    sizes = counts.groupBy("_class").agg(F.sum("_n").alias("_rows"))
    return per_class.join(sizes, "_class").select("_class", "_rows", at.alias("_cut"))


def _with_cuts(rows: DataFrame, label: str, cuts: DataFrame, bounds: list[float]) -> DataFrame:
    """Add ``_cut``, the cut points of each row's class (none: null, past the last row)."""
    own = F.struct(F.col(label).alias("_label"))
    largest = cuts.orderBy(F.desc("_rows"), "_class").limit(MAP_CLASSES).select("_class", "_cut")
    by_class = largest.agg(F.map_from_entries(F.collect_list(F.struct("_class", "_cut")))).scalar()
    cut = F.try_element_at(by_class, own)
    mapped = rows.withColumn("_cut", cut)
    if cuts.count() <= MAP_CLASSES:
        return mapped
    further = cuts.join(largest, cuts["_class"].eqNullSafe(largest["_class"]), "left_anti").select(
        F.col("_class").alias("_of"), F.col("_cut").alias("_its"))
    rest = mapped.where(F.col("_cut").isNull()).withColumn("_class", own)
    joined = rest.join(further, F.col("_class") == F.col("_of"), "left")
    return mapped.where(F.col("_cut").isNotNull()).unionByName(joined.select(*rows.columns, F.col("_its").alias("_cut")))


def assign_parts(
    df: DataFrame,
    fractions: list[float],
    key: str,
    label: str | None = None,
    seed: int = 42,
    digits: int | None = None,
    name: str = "part",
) -> DataFrame:
    """Add ``name``: the 0-based part of each row, by exact shares per class.

    Every class is divided by ``fractions`` (which sum to 1) to within one row. The cut
    points of the largest MAP_CLASSES classes travel as one map, in which a row looks up
    its own, so that wide rows are not shuffled. Rows of further classes, none of which
    has more than a MAP_CLASSES-th of the table, are joined with theirs. ``digits`` sets the
    length of the digest prefixes that are counted; without it the table's size does.
    """
    bounds, total = [], 0.0
    for f in fractions[:-1]:
        total += f
        bounds.append(round(total, 15))
    rows = df.withColumn("_h", digest(F.col(key), seed))
    if label is None:
        cuts = _cuts(df, F.lit(0), key, bounds, seed, digits)
        rows = rows.withColumn("_cut", cuts.select("_cut").scalar())
    else:
        rows = _with_cuts(rows, label, settle(_cuts(df, F.col(label), key, bounds, seed, digits)), bounds)
    # A null cut lies past the end of the class.
    passed = [
        F.coalesce(F.col("_h") >= F.get("_cut", F.lit(i)), F.lit(False)).cast("int")
        for i in range(len(bounds))
    ]
    part = sum(passed[1:], passed[0]) if passed else F.lit(0)
    return rows.select(*df.columns, part.alias(name))


def stratified_split(
    df: DataFrame,
    key: str,
    label: str = "fraudulent",
    fractions=(("train", 0.70), ("val", 0.15), ("test", 0.15)),
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` with the given names and shares per class."""
    parts = assign_parts(df, [f for _, f in fractions], key, label, seed)
    names = F.array(*[F.lit(n) for n, _ in fractions])
    return parts.withColumn("split", F.get(names, F.col("part"))).drop("part")


def stratified_folds(df: DataFrame, key: str, label: str = "fraudulent", k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0 .. k-1, each with its share of every class."""
    return assign_parts(df, [1.0 / k] * k, key, label, seed, name="fold")


def first_by_digest(df: DataFrame, key: str, rows: int, of: int, seed: int = 42) -> DataFrame:
    """The ``rows`` first rows in digest order of a table with ``of`` rows."""
    share = min(1.0, rows / of)
    return assign_parts(df, [share, 1 - share], key, seed=seed).where("part = 0").drop("part")


def exact_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """A seeded sample without replacement of exactly the rounded size."""
    return assign_parts(df, [fraction, 1 - fraction], key, seed=seed).where("part = 0").drop("part")


def with_row_key(df: DataFrame, name: str = "row_key", block: int = 10_000) -> DataFrame:
    """Give a table without identifiers a key that is the same on every read.

    Identical rows are counted, numbered and hashed with their number. The
    numbering is spread block by block, so a row repeated often enough to make
    up much of the table is not written out by one task.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((_n - 1) DIV {block} AS BIGINT)")))
    )
    spread = blocks.repartition(*df.columns, "_b")
    last = F.least(F.col("_n") - F.col("_b") * block, F.lit(block)) - 1
    numbered = spread.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    ordinal = F.col("_b") * block + F.col("_i")
    content = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return numbered.select(
        *df.columns, F.sha2(F.concat_ws("|", ordinal.cast("string"), content), 256).alias(name)
    )
