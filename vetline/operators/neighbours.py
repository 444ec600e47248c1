"""Exact nearest neighbours and the Local Outlier Factor.

Equal vectors are compacted to one with a multiplicity, so repeated postings
cost nothing. The distinct vectors are divided by a tree that is held as
tables: a crowded cell is split along its widest feature into up to FAN cells,
until every leaf is small. A query first searches its own leaf; the distance
it finds rules out all cells whose box lies farther away, and only the other
leaves are searched as well. The result is exact, and only the nearest vectors
ever leave a task. Nothing that grows with the table passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline import schema
from vetline.operators.metrics import confusion_of, contamination_sweep, precision_recall_f1
from vetline.operators.ordered import quantiles_of_counts, value_counts_of
from vetline.operators.sampling import stratified_folds
from vetline.runtime import current_version, read_stored, settle, side_by_side, write_version

LEAF_VECTORS = 2048  # distinct fitted vectors per leaf, at most
FAN = 64  # cells that one is split into, at most
NARROW_LEVELS = 2  # levels of the tree with at most FAN ** 2 cells, which may go to every task
CHUNK_QUERIES = 16_384  # distinct queries per task
NEAR_VECTORS = 2048  # vectors whose neighbours are listed at once
SALTS = 16  # parts that the rows of one vector are dealt to when they look up its factor
LRD_GUARD = 1e-10  # keeps the density of a vector among its copies finite


def distinct_vectors(df: DataFrame, features: list[str], weight: str = "weight") -> DataFrame:
    """One row per distinct vector, features as doubles, with its number of rows.

    A vector has a value in every feature: a null or NaN has no distance to anything and
    stops the job with a message, as the encoder never leaves one.
    """
    def value(f: str) -> Column:
        x = F.col(f).cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x), x + F.lit(0.0)).otherwise(
            F.raise_error(F.lit(f"feature {f} has no value in some row; fill or drop such rows first")))

    vectors = df.select(*[value(f).alias(f) for f in features])
    return vectors.groupBy(*features).agg(F.count(F.lit(1)).alias(weight))


# --- nearest neighbours ---------------------------------------------------


@dataclass
class Tree:
    """Cells of the fitted vectors; a cell's path begins with its parent's."""

    levels: list[DataFrame]  # per level below the root: _node, _parent, _n, _low_<feature>, _high_<feature>
    rows: DataFrame  # the vectors with their leaf in _node: features, weight (null: only asked), _node


def _cells(rows: DataFrame, features: list[str], leaf_vectors: int) -> DataFrame:
    """Size, box and split of each cell: _n, _low_f and _high_f, _feature, _cuts and _strict.

    The split takes quantiles of the feature that is widest between its first and last
    quantile, else of the widest one at all. A cell with a single cut at its greatest
    value is split into what lies below and the rest (_strict), so that splitting ends.
    """
    probs = [i / FAN for i in range(1, FAN)]
    made = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        made += [F.min(f).alias(f"_low_{f}"), F.max(f).alias(f"_high_{f}"),
                 F.percentile_approx(f, probs, 1000).alias(f"_q_{f}")]
    cells = rows.where("weight is not null").groupBy("_node").agg(*made)
    # Evenly spaced parts, half as many again as there have to be leaves: quantiles are approximate.
    parts = F.least(F.lit(FAN), F.ceil(1.5 * F.col("_n") / leaf_vectors)).cast("int")

    def spread(i: int, f: str) -> Column:
        q = F.col(f"_q_{f}")
        return F.struct((F.element_at(q, -1) - F.element_at(q, 1)).alias("inner"),
                        (F.col(f"_high_{f}") - F.col(f"_low_{f}")).alias("outer"), F.lit(i).alias("at"))

    chosen = F.greatest(*[spread(i, f) for i, f in enumerate(features)]) if len(features) > 1 else spread(0, features[0])
    quantiles = F.array(*[F.col(f"_q_{f}") for f in features])
    highs = F.array(*[F.col(f"_high_{f}") for f in features])
    cells = cells.withColumn("_feature", chosen["at"]).withColumn("_parts", parts)
    high = F.get(highs, F.col("_feature"))
    picked = F.filter(F.get(quantiles, F.col("_feature")), lambda x, i: (
        F.floor((i + 1) * F.col("_parts") / FAN) > F.floor(i * F.col("_parts") / FAN)) & (x < high))
    cells = cells.withColumn("_cuts", F.array_distinct(picked))
    return cells.withColumn("_strict", F.size("_cuts") == 0).withColumn(
        "_cuts", F.when(F.col("_strict"), F.array(high)).otherwise(F.col("_cuts"))
    ).drop("_parts", *[f"_q_{f}" for f in features])


def _narrow(df: DataFrame, level: int) -> DataFrame:
    """A table with a row per cell of a level: small enough for every task on the first levels."""
    return F.broadcast(df) if level < NARROW_LEVELS else df


def build_tree(fitted: DataFrame, queries: DataFrame | None, features: list[str], leaf_vectors: int) -> Tree:
    """Divide ``fitted`` until no leaf has more than ``leaf_vectors``, and send ``queries`` along, if any."""
    rows = fitted.select(*features, F.col("weight").cast("bigint").alias("weight"))
    if queries is not None:
        rows = rows.unionByName(queries.select(*features, F.lit(None).cast("bigint").alias("weight")))
    rows = rows.withColumn("_node", F.lit("0"))
    levels, done, open_ = [], [], settle(rows)
    while True:
        cells = settle(_cells(open_, features, leaf_vectors))
        boxes = cells.select(
            "_node", F.regexp_replace("_node", r"\.?[0-9]+$", "").alias("_parent"), "_n",
            *[f"_{side}_{f}" for f in features for side in ("low", "high")])
        levels.append(boxes)
        splits = cells.where(F.col("_n") > leaf_vectors).select(F.col("_node").alias("_of"), "_feature", "_cuts", "_strict")
        if splits.isEmpty():
            return Tree(levels, reduce(DataFrame.unionByName, [*done, open_]))
        value = F.get(F.array(*features), F.col("_feature"))
        child = F.when(F.col("_strict"), (value >= F.get("_cuts", F.lit(0))).cast("int")).otherwise(
            F.size(F.filter("_cuts", lambda c: c < value)))
        joined = open_.join(_narrow(splits, len(levels) - 1), F.col("_node") == F.col("_of"), "left")
        moved = settle(joined.select(
            *features, "weight", F.col("_of").isNotNull().alias("_split"),
            F.when(F.col("_of").isNull(), F.col("_node")).otherwise(F.concat_ws(".", "_node", child)).alias("_node")))
        done.append(moved.where("NOT _split").drop("_split"))
        open_ = moved.where("_split").drop("_split")


def _nearest(queries: np.ndarray, fitted: np.ndarray, k: int):
    """Positions and squared distances of the ``k`` nearest rows; ties by position."""
    for start in range(0, len(queries), 256):
        part = queries[start:start + 256]
        d2 = np.zeros((len(part), len(fitted)))
        for j in range(fitted.shape[1]):
            d2 += (part[:, j, None] - fitted[None, :, j]) ** 2
        if k < d2.shape[1]:
            # All rows within the k-th distance, ties included, are then ordered by distance and position.
            reach = np.partition(d2, k - 1, axis=1)[:, k - 1]
            order = np.empty((len(part), k), int)
            for i, row in enumerate(d2):
                near = np.flatnonzero(row <= reach[i])
                order[i] = near[np.argsort(row[near], kind="stable")[:k]]
        else:
            order = np.argsort(d2, axis=1, kind="stable")
        yield part, order, np.take_along_axis(d2, order, axis=1)


def _search(queries: DataFrame, fitted: DataFrame, features: list[str], k: int) -> DataFrame:
    """Search one leaf for each row of ``queries``: the ``k`` nearest, no farther than ``_reach`` (squared).

    Both sides carry ``_node``; crowds of queries are dealt out in chunks.
    """
    n = len(features)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        points, queries = (np.column_stack([t.column(f).to_numpy() for f in features]) for t in (held, asked))
        order = np.lexsort(points.T[::-1])
        points, weights = points[order], held.column("weight").to_numpy()[order]
        limits, out, at = asked.column("_reach").to_numpy(), [], 0
        for part, near, d2 in _nearest(queries, points, k):
            within = d2 <= limits[at : at + len(part), None]
            at += len(part)
            out.append((within.sum(axis=1), d2[within], near[within]))
        sizes, d2, near = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int),) * 3
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        lists = [pa.array(d2, pa.float64()), *[pa.array(points[near, j]) for j in range(n)], pa.array(weights[near], pa.int64())]
        return pa.table(
            [*(asked.column(c) for c in [*features, "_node"]), *(pa.ListArray.from_arrays(ends, x) for x in lists)], names=columns)

    columns = [*features, "_node", "_d2", *[f"_n{j}" for j in range(n)], "_w"]
    fields = [f"`{f}` double" for f in features] + ["_node string", "_d2 array<double>"]
    fields += [f"_n{j} array<double>" for j in range(n)] + ["_w array<bigint>"]
    # Fresh column identities, as both sides come from one tree.
    queries, fitted = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (queries, fitted))
    chunks = queries.groupBy("_node").agg(F.ceil(F.count(F.lit(1)) / CHUNK_QUERIES).cast("int").alias("_chunks"))
    asked = queries.join(chunks, "_node").withColumn("_c", F.pmod(F.xxhash64(*features), F.col("_chunks")).cast("int"))
    held = fitted.join(chunks, "_node").withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    found = asked.drop("_chunks").groupBy("_node", "_c").cogroup(
        held.drop("_chunks").groupBy("_node", "_c")).applyInArrow(search, ", ".join(fields))
    zipped = F.arrays_zip("_d2", *[f"_n{j}" for j in range(n)], "_w")
    entry = F.transform(zipped, lambda e: F.struct(
        e["_d2"].alias("d2"),
        *[e[f"_n{j}"].alias(f"n_{f}") for j, f in enumerate(features)],
        e["_w"].alias("w"),
    ))
    return found.select(*features, "_node", entry.alias("near"))


def _merged(found: DataFrame, features: list[str], k: int) -> DataFrame:
    """The ``k`` nearest of several searches; structs sort by distance, then vector.

    At most ``k`` entries per searched leaf come together here, all within the first leaf's reach.
    Most vectors come with their own leaf's list only, which is in order.
    """
    lists = found.groupBy(*features).agg(F.collect_list("near").alias("_lists"))
    merged = F.slice(F.array_sort(F.flatten("_lists")), 1, k)
    return lists.select(*features, F.when(F.size("_lists") == 1, F.get("_lists", F.lit(0))).otherwise(merged).alias("near"))


def _box_distance(features: list[str], farthest: bool = False) -> Column:
    """Squared distance from a vector to the nearest (or farthest) point of a cell's box."""
    def away(f: str) -> Column:
        below, above = F.col(f"_low_{f}") - F.col(f), F.col(f) - F.col(f"_high_{f}")
        most = F.greatest(F.abs(below), F.abs(above)) if farthest else F.greatest(below, above, F.lit(0.0))
        return most * most

    return reduce(lambda x, y: x + y, [away(f) for f in features])


def nearest_vectors(
    queries: DataFrame,
    fitted: DataFrame,
    features: list[str],
    k: int,
    leaf_vectors: int = LEAF_VECTORS,
) -> DataFrame:
    """The ``k`` nearest distinct fitted vectors of every distinct query, exactly.

    Euclidean and unscaled. Adds ``near``, an array of structs (d2, n_<feature>,
    w) ordered by distance, then by vector. ``fitted`` is a settled
    ``distinct_vectors`` table, ``queries`` has the same features; the table itself, given
    for both, goes through the tree once.
    """
    same = queries is fitted
    tree = build_tree(fitted, None if same else queries, features, max(leaf_vectors, 2 * k))
    held = tree.rows.where("weight is not null")
    asked = (held if same else tree.rows.where("weight is null")).drop("weight")
    own = _search(asked.withColumn("_reach", F.lit(float("inf"))), held, features, k)
    if len(tree.levels) == 1:
        return own.drop("_node")
    # A leaf with too few vectors bounds nothing: the box of the smallest cell around it that has enough does.
    # The margin covers rounding.
    own = settle(own)
    last = F.when(F.size("near") >= k, F.element_at("near", -1)["d2"])
    steps = own.select(*features, (last * (1 + 1e-9)).alias("_reach"), "_node")
    lone = steps.where("_reach is null").drop("_reach")
    around = lone.withColumn("_leaf", F.col("_node")).withColumn("_step", F.explode(F.sequence(
        F.lit(1), F.size(F.split("_node", r"\."))))).withColumn("_node", F.call_function(
            "substring_index", F.col("_leaf"), F.lit("."), F.col("_step")))
    boxes = reduce(DataFrame.unionByName, tree.levels).where(F.col("_n") >= k)
    bounds = around.join(boxes, "_node").groupBy(*features, F.col("_leaf").alias("_node")).agg(
        (F.min_by(_box_distance(features, True), -F.col("_step")) * (1 + 1e-9)).alias("_reach"))
    reached = steps.where("_reach is not null").unionByName(
        lone.join(bounds, [*features, "_node"], "left").withColumn("_reach", F.coalesce("_reach", F.lit(float("inf")))))
    # Down the tree: to every cell whose box a nearer vector could lie in.
    walk = reached.select(*features, "_reach", F.col("_node").alias("_leaf"), F.lit("0").alias("_node"))
    leaves = []
    for level, cells in enumerate(tree.levels[1:]):
        step = walk.withColumnRenamed("_node", "_at").join(
            _narrow(cells, level), F.col("_at") == F.col("_parent"), "left")
        leaves.append(step.where(F.col("_node").isNull()).withColumn("_node", F.col("_at")))
        walk = step.where(F.col("_node").isNotNull() & (_box_distance(features) <= F.col("_reach"))).select(
            *features, "_reach", "_leaf", "_node")
    kept = [*features, "_reach", "_leaf", "_node"]
    others = reduce(DataFrame.unionByName, [df.select(*kept) for df in [*leaves, walk]])
    # The search reads them twice; the walk meets every cell below a query's, few of which stay.
    others = settle(others.where(F.col("_node") != F.col("_leaf")).drop("_leaf"))
    return _merged(own.unionByName(_search(others, held, features, k)).drop("_node"), features, k)


def neighbour_rows(near: DataFrame, features: list[str], ks: list[int], rows: Column, leave_self: bool) -> DataFrame:
    """One row per (k, vector, neighbour vector) with the copies ``take`` it contributes.

    A vector's ``k`` neighbours are rows, so a neighbour vector counts as often
    as it occurs until ``k`` are reached. With ``leave_self`` a fitted row is
    not its own neighbour. ``rows`` is the number of fitted rows: never more
    than ``rows`` - 1 neighbours are used.
    """
    columns = [*features, "distance", *[f"n_{f}" for f in features], "k", "take"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, NEAR_VECTORS):
                yield from expanded(whole.slice(start, NEAR_VECTORS))

    def expanded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        near = batch.column("near")
        entries, sizes = near.flatten(), near.value_lengths().to_numpy()
        own, first = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
        d2, w = entries.field("d2").to_numpy(), entries.field("w").to_numpy()
        w = w - (d2 == 0) if leave_self else w
        before = np.cumsum(w) - w
        before = before - before[first]
        most = batch.column("_rows").to_numpy()[own] - 1
        for k in ks:
            take = np.minimum(w, np.maximum(1, np.minimum(k, most)) - before)
            kept = np.flatnonzero(take > 0)
            at, of = pa.array(kept), pa.array(own[kept])
            yield pa.RecordBatch.from_arrays([
                *[batch.column(f).take(of) for f in features], pa.array(np.sqrt(d2[kept])),
                *[entries.field(f"n_{f}").take(at) for f in features],
                pa.array(np.full(len(kept), k, np.int32)), pa.array(take[kept])], columns)

    kinds = [*["double"] * (2 * len(features) + 1), "int", "bigint"]
    return near.select(*features, "near", rows.cast("bigint").alias("_rows")).mapInArrow(
        work, ", ".join(f"`{c}` {kind}" for c, kind in zip(columns, kinds)))


# --- Local Outlier Factor -------------------------------------------------


@dataclass
class LofModel:
    """Fitted vectors with their density, for one or more neighbour counts."""

    table: DataFrame  # k, features, weight, k_distance, density, factor
    vectors: DataFrame  # features, weight
    features: list[str]
    ks: list[int]
    rows: int
    leaf_vectors: int = LEAF_VECTORS


def _neighbour_side(table: DataFrame, features: list[str], column: str) -> DataFrame:
    return table.select("k", *[F.col(f).alias(f"n_{f}") for f in features], F.col(column).alias("_v"))


def _densities(rows: DataFrame, k_distances: DataFrame, features: list[str]) -> DataFrame:
    """Local reachability density per (k, vector).

    The join names ``k`` last: rows are sorted by their first key, and all share a few ``k``.
    """
    joined = rows.join(
        _neighbour_side(k_distances, features, "k_distance"), [*[f"n_{f}" for f in features], "k"])
    reach = F.sum(F.col("take") * F.greatest("_v", "distance")) / F.sum("take")
    return joined.groupBy("k", *features).agg((1.0 / (reach + LRD_GUARD)).alias("density"))


def _factors(rows: DataFrame, own: DataFrame, fitted: DataFrame, features: list[str]) -> DataFrame:
    """Negative factor per (k, vector): minus the mean neighbour density over the own density.

    Factors are compared with quantiles of themselves, so they are kept in
    single precision: that drops the noise of the order of summation.
    """
    joined = rows.join(
        _neighbour_side(fitted, features, "density"), [*[f"n_{f}" for f in features], "k"])
    mean = joined.groupBy("k", *features).agg((F.sum(F.col("take") * F.col("_v")) / F.sum("take")).alias("_m"))
    return mean.join(own, [*features, "k"]).select(
        "k", *features, "density", (-F.col("_m") / F.col("density")).cast("float").cast("double").alias("factor"))


def fit_lof(
    df: DataFrame, features: list[str] = tuple(schema.FEATURES), ks: list[int] = (20,),
    leaf_vectors: int = LEAF_VECTORS,
) -> LofModel:
    """Fit for all neighbour counts ``ks`` from one search with the largest."""
    features, ks = list(features), sorted(ks)
    vectors = settle(distinct_vectors(df, features))
    rows = vectors.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    near = nearest_vectors(vectors, vectors, features, max(ks) + 1, leaf_vectors)
    pairs = settle(neighbour_rows(near, features, ks, F.lit(rows), leave_self=True))
    k_distances = pairs.groupBy("k", *features).agg(F.max("distance").alias("k_distance"))
    density = settle(_densities(pairs, k_distances, features))
    factors = _factors(pairs, density, density, features)
    table = factors.join(k_distances, [*features, "k"]).join(vectors, features)
    table = table.select("k", *features, "weight", "k_distance", "density", "factor")
    return LofModel(settle(table), vectors, features, ks, rows, leaf_vectors)


def lof_vector_scores(model: LofModel, queries: DataFrame) -> DataFrame:
    """Rows (k, features, factor) for the distinct vectors of new rows.

    A fitted row scored as a new one counts itself among its neighbours.
    """
    f = model.features
    near = nearest_vectors(queries, model.vectors, f, max(model.ks) + 1, model.leaf_vectors)
    pairs = settle(neighbour_rows(near, f, model.ks, F.lit(model.rows), leave_self=False))
    own = _densities(pairs, model.table, f)
    return _factors(pairs, own, model.table, f).select("k", *f, "factor")


def lof_offset(model: LofModel, k: int, contamination: float) -> float:
    """The quantile of the fitted factors that flags the given share."""
    fitted = model.table.where(F.col("k") == k)
    counts = settle(value_counts_of(fitted, F.col("factor"), weight="weight"))
    return quantiles_of_counts(counts, [contamination]).first()["quantiles"][0]


def score_lof(
    df: DataFrame, model: LofModel, k: int, contamination: float, offset: float | None = None
) -> DataFrame:
    """Add ``lof_factor``, ``lof_score`` (lower is more anomalous) and ``lof_anomaly`` (-1 or 1).

    Rows look their vector's factor up. A vector that makes up much of the table would
    meet its factor in one task, so both sides carry a salt, which equal rows of
    different partitions do not share.
    """
    f = model.features
    scores = lof_vector_scores(model, distinct_vectors(df, f)).where(F.col("k") == k)
    keyed = df.withColumns({f"_{c}": F.col(c).cast("double") + F.lit(0.0) for c in f}).withColumn(
        "_salt", F.pmod(F.xxhash64(*df.columns) + F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    scores = scores.select(
        *[F.col(c).alias(f"_{c}") for c in f], F.col("factor").alias("lof_factor"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = keyed.join(scores, [*[f"_{c}" for c in f], "_salt"], "left")
    if offset is None:
        offset = lof_offset(model, k, contamination)
    score = F.col("lof_factor") - F.lit(offset)
    return joined.withColumn("lof_score", score).withColumn(
        "lof_anomaly", F.when(F.col("lof_score") < 0, -1).otherwise(1)
    ).select(*df.columns, "lof_factor", "lof_score", "lof_anomaly")


def lof_label_scores(model: LofModel, df: DataFrame, label: str) -> DataFrame:
    """Compact scored rows (k, factor, label, rows) for evaluation."""
    f = model.features
    compact = settle(
        df.select(label, *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in f])
        .groupBy(label, *f).agg(F.count(F.lit(1)).alias("rows")))
    scores = lof_vector_scores(model, compact.select(*f).distinct())
    return compact.join(scores, f).select("k", "factor", label, "rows")


def sweep_lof_contamination(
    model: LofModel, val: DataFrame, label: str, contaminations: list[float], k: int = 20
) -> DataFrame:
    """Rows (contamination, f1, precision, recall, flagged) from one fit."""
    train = model.table.where(F.col("k") == k).select("factor", F.col("weight").alias("rows"))
    scored = lof_label_scores(model, val, label).where(F.col("k") == k)
    return contamination_sweep(train, scored, "factor", label, contaminations, weight="rows")


def sweep_lof_neighbours(
    model: LofModel, val: DataFrame, label: str, contamination: float, digits: int | None = 4
) -> DataFrame:
    """Rows (n_neighbors, contamination, f1, precision, recall, flagged) from one search."""
    counts = settle(value_counts_of(model.table, F.col("factor"), ["k"], "weight"))
    # One row per neighbour count.
    cuts = F.broadcast(quantiles_of_counts(counts, [contamination], ["k"]).select(
        "k", F.col("quantiles")[0].alias("_cut")))
    scored = lof_label_scores(model, val, label).join(cuts, "k")
    hit = (F.col("factor") < F.col("_cut")).cast("int")
    cells = confusion_of(F.col(label), hit, F.col("rows"))
    per_k = scored.groupBy("k").agg(*[c.alias(n) for n, c in cells.items()])
    return precision_recall_f1(per_k, digits).select(
        F.col("k").alias("n_neighbors"), F.lit(contamination).alias("contamination"),
        "f1", "precision", "recall", "flagged")


def cross_validate_lof(
    df: DataFrame, key: str, label: str, n_neighbors: int, contamination: float, k: int = 5, seed: int = 42,
    features: list[str] = tuple(schema.FEATURES),
) -> DataFrame:
    """Rows (fold, f1, precision, recall): fitted without labels, scored with them.

    The folds run side by side.
    """
    folds = settle(stratified_folds(df, key, label, k, seed))

    def one(i: int) -> DataFrame:
        model = fit_lof(folds.where(F.col("fold") != i), features, [n_neighbors])
        test = folds.where(F.col("fold") == i)
        return sweep_lof_neighbours(model, test, label, contamination, None).withColumn("fold", F.lit(i))

    rows = reduce(DataFrame.union, side_by_side(df.sparkSession, one, list(range(k))))
    return rows.select("fold", "f1", "precision", "recall")


# --- storage --------------------------------------------------------------


def save_lof(model: LofModel, path: str) -> None:
    """Store the fitted vectors and the parameters as a new version of ``path``."""
    spark = model.table.sparkSession
    write_version(spark, path, {"vectors": model.table, "params": spark.createDataFrame(
        [(model.features, model.ks, model.rows)], "features array<string>, ks array<int>, rows bigint").coalesce(1)})


def load_lof(spark: SparkSession, path: str) -> LofModel | None:
    """Read the current version of a stored model; a missing or unreadable one gives None."""
    stored = read_stored(spark, current_version(spark, path), "params", "vectors")
    if stored is None:
        return None
    p, table = stored[0].first(), stored[1]
    vectors = table.where(F.col("k") == p.ks[0]).select(*p.features, "weight")
    return LofModel(table, vectors, list(p.features), list(p.ks), p.rows)
