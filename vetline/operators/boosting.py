"""Gradient-boosted trees over binned features, with exact attributions.

Features are cut at exact quantiles, and a row counts through its bins only, so rows meet as
one per set of bins and label counts. Each level of each tree needs the gradients summed by
(node, feature, bin); they are summed as whole numbers, so the order of rows and tasks does
not matter. A model has at most rounds * 2 ** depth leaves, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.operators.ordered import quantiles_of_counts, value_counts_of
from vetline.runtime import current_version, read_stored, settle, write_version

SCALE = float(1 << 30)  # gradients are rounded to multiples of 1 / SCALE


@dataclass
class Boosted:
    """Trees of equal depth; the children of node n are 2n and 2n + 1, the root is 1.

    A node sends bins above ``bin`` to the right; without a feature (-1) it sends all rows left.
    """

    features: list[str]
    cuts: list[list[float]]  # per feature, rising; a value's bin is the number of cuts below it
    feature: np.ndarray  # tree, node
    bin: np.ndarray  # tree, node
    value: np.ndarray  # tree, leaf
    depth: int
    background: list[int]  # bins of the mean of each feature in training


def bins_of(features: list[str], cuts: list[list[float]]) -> Column:
    """The bins of a row; a null falls into the first bin."""
    def bin_of(value: Column, own: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in own]), lambda c: c < value)) if own else F.lit(0)

    return F.array(*[bin_of(F.col(f).cast("double"), own) for f, own in zip(features, cuts)])


def quantile_cuts(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Exact quantiles of each feature, equal ones once; at most ``bins`` - 1 a feature."""
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("at"), F.col(f).cast("double").alias("x")) for i, f in enumerate(features)
    ])).alias("_v")).select("_v.at", "_v.x")
    counts = settle(value_counts_of(values, F.col("x"), ["at"]))
    found = {r["at"]: r["quantiles"] for r in quantiles_of_counts(counts, [i / bins for i in range(1, bins)], ["at"]).collect()}
    return [sorted(set(found.get(i, []))) for i in range(len(features))]


def _nodes_at(model: Boosted, tree: int, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row in a tree after ``depth`` steps."""
    node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        feature = model.feature[tree, node]
        right = (feature >= 0) & (bins[rows, np.maximum(feature, 0)] > model.bin[tree, node])
        node = 2 * node + right
    return node


def margins(model: Boosted, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
    """Log-odds by the first ``trees`` trees."""
    total, leaves = np.zeros(len(bins)), 1 << model.depth
    for tree in range(len(model.value) if trees is None else trees):
        total = total + model.value[tree, _nodes_at(model, tree, bins, model.depth) - leaves]
    return total


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(-1, width).astype(np.int64)


def _gradients(model: Boosted, batch: pa.RecordBatch, tree: int, level: int) -> pa.RecordBatch:
    """(place, g, h): sums of a batch by node of the level, feature and bin, as whole numbers."""
    width, most = len(model.features), max(map(len, model.cuts), default=0) + 1
    bins = _matrix(batch, "bins", width)
    n, positive = batch.column("n").to_numpy(), batch.column("positive").to_numpy()
    p = 1.0 / (1.0 + np.exp(-margins(model, bins, tree)))
    g = positive * np.rint((1.0 - p) * SCALE).astype(np.int64) + (n - positive) * np.rint(-p * SCALE).astype(np.int64)
    h = n * np.rint(p * (1.0 - p) * SCALE).astype(np.int64)
    node = _nodes_at(model, tree, bins, level) - (1 << level)
    place = ((node[:, None] * width + np.arange(width)) * most + bins).ravel()
    kinds, at = np.unique(place, return_inverse=True)
    sums = np.zeros((2, len(kinds)), np.int64)
    for out, values in zip(sums, (g, h)):
        np.add.at(out, at, np.repeat(values, width))
    return pa.record_batch([pa.array(kinds), *map(pa.array, sums)], ["place", "g", "h"])


def _split(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[int, int]:
    """(feature, bin) of the best split of a node from its sums by feature and bin; (-1, 0) without gain.

    Equal gains go to the first feature, then the first bin.
    """
    below = np.cumsum(g, axis=1).astype(float), np.cumsum(h, axis=1).astype(float)
    total = float(g[0].sum()), float(h[0].sum())
    above = total[0] - below[0], total[1] - below[1]
    gain = below[0] * below[0] / (below[1] + penalty) + above[0] * above[0] / (above[1] + penalty) \
        - total[0] * total[0] / (total[1] + penalty)
    at = int(np.argmax(gain))
    return divmod(at, gain.shape[1]) if gain.ravel()[at] > 0 else (-1, 0)


def fit_boosted(
    df: DataFrame, features: list[str], label: str, rounds: int = 10, depth: int = 3, bins: int = 32,
    rate: float = 0.5, penalty: float = 1.0,
) -> Boosted:
    """Logistic loss, Newton steps of ``rate``, hessians raised by ``penalty``.

    Rows without a label take no part. One pass over the compact table per level of a tree.
    """
    df = df.where(F.col(label).isNotNull())
    cuts = quantile_cuts(df, features, bins)
    binned = df.select(bins_of(features, cuts).alias("bins"), F.col(label).cast("bigint").alias("y"))
    compact = settle(binned.groupBy("bins").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive")))
    means = df.select(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    background = list(means.select(bins_of(features, cuts)).first()[0])
    model = Boosted(
        list(features), cuts, np.full((rounds, 1 << depth), -1), np.zeros((rounds, 1 << depth), np.int64),
        np.zeros((rounds, 1 << depth)), depth, background,
    )
    width, most = len(features), max(map(len, cuts), default=0) + 1

    def sums(tree: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _gradients(model, batch, tree, level)

        parts = compact.mapInArrow(work, "place bigint, g bigint, h bigint")
        # At most 2 ** level * features * bins rows.
        found = np.zeros((2, (1 << level) * width * most), np.int64)
        for place, g, h in parts.groupBy("place").agg(F.sum("g"), F.sum("h")).collect():
            found[:, place] = g, h
        return tuple(found.reshape(2, 1 << level, width, most))

    for tree in range(rounds):
        for level in range(depth):
            g, h = sums(tree, level)
            for i in range(1 << level):
                node = (1 << level) + i
                feature, cut = _split(g[i], h[i], penalty * SCALE)
                model.feature[tree, node], model.bin[tree, node] = feature, cut
                if level == depth - 1:
                    feature = max(feature, 0)
                    cut = cut if model.feature[tree, node] >= 0 else most - 1
                    sides = [(g[i, feature, : cut + 1].sum(), h[i, feature, : cut + 1].sum()),
                             (g[i, feature, cut + 1 :].sum(), h[i, feature, cut + 1 :].sum())]
                    for side, (a, b) in enumerate(sides):
                        model.value[tree, 2 * i + side] = rate * (float(a) / (float(b) + penalty * SCALE))
    return model


def attributions(model: Boosted, bins: np.ndarray) -> np.ndarray:
    """Exact Shapley values of the log-odds against the background, per row and feature.

    A leaf counts for a set of features if the row meets its conditions on them and the
    background those on all others. Of the features on the path, ``a`` are met by the row
    alone and ``b`` by the background alone; that gives each one's share in closed form.
    """
    out, leaves = np.zeros((len(bins), len(model.features))), 1 << model.depth
    n = model.depth + 1
    gain = np.array([[factorial(a - 1) * factorial(b) / factorial(a + b) if a else 0.0 for b in range(n)] for a in range(n)])
    loss = np.array([[factorial(a) * factorial(b - 1) / factorial(a + b) if b else 0.0 for b in range(n)] for a in range(n)])
    both = np.vstack([bins, model.background])
    for tree in range(len(model.value)):
        for leaf in range(leaves):
            value = model.value[tree, leaf]
            if value == 0.0:
                continue
            met: dict[int, np.ndarray] = {}
            node = leaves + leaf
            reachable = True
            while node > 1:
                right, node = node & 1, node >> 1
                feature = int(model.feature[tree, node])
                if feature < 0:
                    reachable = reachable and not right
                    continue
                fits = (both[:, feature] > model.bin[tree, node]) == bool(right)
                met[feature] = met[feature] & fits if feature in met else fits
            if not reachable or not met:
                continue
            mine = np.array([fits[:-1] for fits in met.values()])
            theirs = np.array([fits[-1] for fits in met.values()])[:, None]
            a, b = (mine & ~theirs).sum(axis=0), (~mine & theirs).sum(axis=0)
            counts = (mine | theirs).all(axis=0)
            for feature, x, y in zip(met, mine, theirs):
                change = np.where(x & ~y, gain[a, b], 0.0) - np.where(~x & y, loss[a, b], 0.0)
                out[:, feature] += np.where(counts, value * change, 0.0)
    return out


def score_boosted(df: DataFrame, model: Boosted, margin: str = "margin", shares: str = "shares") -> DataFrame:
    """Add the log-odds and the attributions (array of double, in the order of the features)."""
    kept, width = df.columns, len(model.features)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch, "_bins", width)
            found = attributions(model, bins)
            listed = pa.ListArray.from_arrays(
                pa.array(np.arange(len(bins) + 1, dtype=np.int32) * width), pa.array(found.ravel() + 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["_bins"]).columns, pa.array(margins(model, bins)), listed], [*kept, margin, shares])

    schema = T.StructType([
        *df.schema.fields, T.StructField(margin, T.DoubleType()), T.StructField(shares, T.ArrayType(T.DoubleType()))])
    return df.withColumn("_bins", bins_of(model.features, model.cuts)).mapInArrow(work, schema)


def base_margin(model: Boosted) -> float:
    """The log-odds of the background."""
    return float(margins(model, np.array([model.background]))[0])


# --- storage --------------------------------------------------------------


def save_boosted(spark: SparkSession, model: Boosted, path: str) -> None:
    """Store trees and cuts as a new version of ``path``."""
    trees = [(t, int(n), int(model.feature[t, n]), int(model.bin[t, n]), float(model.value[t, n]))
             for t in range(len(model.value)) for n in range(1 << model.depth)]
    write_version(spark, path, {
        "trees": spark.createDataFrame(trees, "tree int, node int, feature int, bin int, value double").coalesce(1),
        "params": spark.createDataFrame(
            [(model.features, model.cuts, model.depth, [int(b) for b in model.background], len(model.value))],
            "features array<string>, cuts array<array<double>>, depth int, background array<int>, rounds int").coalesce(1),
    })


def load_boosted(spark: SparkSession, path: str) -> Boosted | None:
    """The current version of stored trees; a missing or unreadable one gives None."""
    stored = read_stored(spark, current_version(spark, path), "params", "trees")
    if stored is None:
        return None
    p, rows = stored[0].first(), stored[1].orderBy("tree", "node").collect()
    shape = (p.rounds, 1 << p.depth)
    feature, cut, value = (np.array([r[c] for r in rows]).reshape(shape) for c in ("feature", "bin", "value"))
    return Boosted(list(p.features), [list(c) for c in p.cuts], feature, cut, value, p.depth, list(p.background))
