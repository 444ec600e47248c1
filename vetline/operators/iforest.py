"""Isolation Forest: trees grown in parallel, rows scored in Arrow batches.

The model is a table of tree nodes. It has at most trees * (2 * sample - 1)
rows (51,100 by default) whatever the size of the training table, so it is
shipped to every task when scoring.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetline import schema
from vetline.functions.scalars import flagged
from vetline.operators.metrics import confusion, precision_recall_f1
from vetline.operators.ordered import quantiles_of_counts, value_counts_of
from vetline.operators.sampling import first_by_digest, stratified_folds
from vetline.runtime import current_version, read_stored, settle, side_by_side, write_version

NODE_SCHEMA = "tree int, node int, feature int, threshold double, category string, path double"
POOL = 100 * 256  # rows that the trees draw from, at least
SCORE_DIGITS = 12  # of a raw score: equal vectors then compare as equal, in whatever order paths were added


def average_path(n):
    """Expected path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        many = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


@dataclass
class Forest:
    """A fitted forest: its nodes, its inputs, its decision offset.

    ``scores`` are the settled counts per distinct raw score of the training rows, from
    the fit; a loaded forest has none.
    """

    nodes: pd.DataFrame
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    sample: int = 256
    contamination: float = 0.05
    offset: float = -0.5
    scores: DataFrame | None = None

    @property
    def inputs(self) -> list[str]:
        return [*self.numeric, *self.categorical]


# --- fitting --------------------------------------------------------------


def _tree_samples(df: DataFrame, key: str, trees: int, sample: int, seed: int) -> tuple[DataFrame, int]:
    """Rows with a ``_tree`` number, ``sample`` rows per tree without repeats.

    A pool of POOL or trees * ``sample`` rows (all, if fewer) is drawn first, by one digest a row;
    each tree takes the rows of the pool whose digest of (seed, tree, key) is smallest. So
    the digests per tree are bounded, whatever the size of the table. A bound on the digest,
    eight deviations above what is needed, leaves some ``sample`` rows per tree to rank.
    """
    rows = df.count()
    size, pool = min(sample, rows), min(max(trees * sample, POOL), rows)
    drawn_from = df if pool == rows else first_by_digest(df, key, pool, rows, seed)
    wanted = size + 8 * size**0.5 + 8
    bound = f"{min(int(wanted / max(pool, 1) * 16**32), 16**32 - 1):032x}"
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_tree"), F.col(key).cast("string")).cast("binary"))
    drawn = drawn_from.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_h", draw)
    order = Window.partitionBy("_tree").orderBy("_h", key)
    drawn = drawn.where(F.col("_h") <= bound).withColumn("_i", F.row_number().over(order))
    return drawn.where(F.col("_i") <= size).drop("_i", "_h"), size


def node_draw(seed: int, tree: int, node: int, what: str) -> float:
    """A number in [0, 1) given by a digest: which split (``s``) or where (``c``) a node cuts."""
    return int(hashlib.md5(f"{seed}:{tree}:{node}:{what}".encode()).hexdigest()[:13], 16) / 16.0**13


def _grow(rows: pd.DataFrame, numeric: list[str], bases: dict[str, str | None], depth_limit: int, seed: int):
    """Nodes of one tree over at most ``sample`` rows.

    The children of node n are 2n and 2n + 1; the root is 1. A split is drawn among all
    columns that vary within the node: numeric ones in their order, then categories by
    column and value.
    """
    tree = int(rows["_tree"].iloc[0])
    values = rows[numeric].to_numpy(dtype=float) if numeric else np.empty((len(rows), 0))
    texts = {c: rows[c].to_numpy(dtype=object) for c in bases}
    out: list[list] = []
    todo = [(np.arange(len(rows)), 0, 1)]
    while todo:
        members, depth, node = todo.pop()
        splits = []
        if depth < depth_limit and len(members) > 1:
            part = values[members]
            lo, hi = part.min(axis=0), part.max(axis=0)
            splits = [(i, None) for i in np.flatnonzero(lo < hi)]
            # A category that only part of the node has is a 0/1 column that varies.
            for j, c in enumerate(bases):
                present, counts = np.unique(texts[c][members].astype(str), return_counts=True)
                splits += [
                    (len(numeric) + j, v) for v, n in zip(present, counts)
                    if n < len(members) and v != bases[c]
                ]
        if not splits:
            path = depth + float(average_path(len(members)))
            out.append([tree, node, -1, None, None, path])
            continue
        feature, category = splits[int(node_draw(seed, tree, node, "s") * len(splits))]
        if category is None:
            cut = lo[feature] + node_draw(seed, tree, node, "c") * (hi[feature] - lo[feature])
            cut = lo[feature] if cut >= hi[feature] else cut
            right = part[:, feature] > cut
        else:
            cut = None
            right = texts[list(bases)[feature - len(numeric)]][members].astype(str) == category
        out.append([tree, node, int(feature), cut, category, None])
        todo.append((members[right], depth + 1, 2 * node + 1))
        todo.append((members[~right], depth + 1, 2 * node))
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def fit_forest(
    df: DataFrame,
    key: str,
    numeric: list[str] = tuple(schema.FEATURES),
    categorical: list[str] = (),
    trees: int = 100,
    sample: int = 256,
    contamination: float = 0.05,
    seed: int = 42,
) -> Forest:
    """Fit on the columns ``numeric`` and, one-hot, ``categorical``.

    A categorical column stands for its 0/1 columns without the alphabetically
    first; the matrix itself is never built. The offset is the exact
    ``contamination`` quantile of the training scores.
    """
    numeric, categorical = list(numeric), list(categorical)
    rows = df.select(
        key,
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.coalesce(F.col(c).cast("string"), F.lit(schema.MISSING_CATEGORY)).alias(c) for c in categorical],
    )
    bases = rows.agg(*[F.min(c).alias(c) for c in categorical]).first().asDict() if categorical else {}
    samples, size = _tree_samples(rows, key, trees, sample, seed)
    depth_limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        return _grow(group.sort_values(key), numeric, bases, depth_limit, seed)

    # Every group is one tree's sample, at most ``sample`` rows.
    nodes = samples.groupBy("_tree").applyInPandas(grow, NODE_SCHEMA)
    model = Forest(
        nodes.toPandas().sort_values(["tree", "node"], ignore_index=True),
        numeric, categorical, size, contamination,
    )
    model.scores = training_scores(rows, model)
    model.offset = forest_offsets(model.scores, [contamination])[0]
    return model


def score_vectors(df: DataFrame, model: Forest, keys: list[str]) -> DataFrame:
    """Compact scored rows (keys, score, rows): each distinct vector is scored once."""
    vectors = df.groupBy(*keys, *model.inputs).agg(F.count(F.lit(1)).alias("rows"))
    return vectors.select(*keys, raw_score(model).alias("score"), "rows")


def training_scores(df: DataFrame, model: Forest) -> DataFrame:
    """Settled counts per distinct raw score."""
    return settle(value_counts_of(score_vectors(df, model, []), F.col("score"), weight="rows"))


def forest_offsets(scores: DataFrame, contaminations: list[float]) -> list[float]:
    """The score quantiles that flag the given shares of the training table."""
    return list(quantiles_of_counts(scores, contaminations).first()["quantiles"])


# --- scoring --------------------------------------------------------------


def raw_score(model: Forest) -> Column:
    """Column with -2 ** (-mean path / expected path); lower is more anomalous."""
    sc = SparkContext.getOrCreate()
    nodes = model.nodes
    place = {n: i for i, n in enumerate(zip(nodes["tree"], nodes["node"]))}
    child = np.array([
        [place.get((t, 2 * n), 0), place.get((t, 2 * n + 1), 0)] for t, n in zip(nodes["tree"], nodes["node"])
    ]).reshape(-1, 2)
    roots = np.flatnonzero(nodes["node"].to_numpy() == 1)
    words = {
        c: {v: float(i) for i, v in enumerate(
            nodes.loc[nodes["feature"] == len(model.numeric) + j, "category"].unique())}
        for j, c in enumerate(model.categorical)
    }
    is_category = nodes["category"].notna().to_numpy()
    cut = nodes["threshold"].to_numpy(dtype=float).copy()
    for i in np.flatnonzero(is_category):
        column = model.categorical[nodes["feature"].iat[i] - len(model.numeric)]
        cut[i] = words[column][nodes["category"].iat[i]]
    feature = nodes["feature"].to_numpy()
    shipped = sc.broadcast({
        "roots": roots, "feature": feature, "leaf": feature < 0, "cut": cut, "equal": is_category,
        "left": child[:, 0], "right": child[:, 1],
        "path": nodes["path"].to_numpy(dtype=float), "words": words,
        "scale": float(max(average_path(model.sample), 1e-300)),
    })
    n_numeric = len(model.numeric)
    categorical = model.categorical

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = shipped.value
        for batch in batches:
            coded = [s.to_numpy(dtype=float) for s in batch[:n_numeric]]
            coded += [
                s.map(m["words"][c]).fillna(-1.0).to_numpy(dtype=float)
                for c, s in zip(categorical, batch[n_numeric:])
            ]
            vectors, place = np.unique(np.column_stack(coded), axis=0, return_inverse=True)
            at = np.tile(m["roots"], (len(vectors), 1))
            row = np.arange(len(vectors))[:, None]
            while True:
                inner = ~m["leaf"][at]
                if not inner.any():
                    break
                x = vectors[row, np.maximum(m["feature"][at], 0)]
                go_right = np.where(m["equal"][at], x == m["cut"][at], x > m["cut"][at])
                at = np.where(inner, np.where(go_right, m["right"][at], m["left"][at]), at)
            result = np.round(-(2.0 ** (-m["path"][at].mean(axis=1) / m["scale"])), SCORE_DIGITS)
            yield pd.Series(result[place.ravel()])

    return score(
        *[F.col(c).cast("double") for c in model.numeric],
        *[F.coalesce(F.col(c).cast("string"), F.lit(schema.MISSING_CATEGORY)) for c in categorical],
    )


def outlier_label(score: Column) -> Column:
    """-1 below zero, else 1."""
    return F.when(score < 0, -1).otherwise(1)


def score_outliers(df: DataFrame, model: Forest | None, convention: str = "anomaly") -> DataFrame:
    """Add ``anomaly_score`` and ``anomaly_label``; works on batch and streaming tables.

    ``anomaly``: lower is more anomalous, label -1 or 1. ``fraud``: higher is
    more suspicious, label 1 or 0. Without a model every row is neutral.
    """
    if convention not in ("anomaly", "fraud"):
        raise ValueError(f"unknown convention {convention!r}")
    score = F.lit(0.0) if model is None else raw_score(model) - F.lit(model.offset)
    scored = df.withColumn("anomaly_score", score)
    scored = scored.withColumn("anomaly_label", outlier_label(F.col("anomaly_score")))
    if convention == "fraud":
        scored = scored.withColumns({
            "anomaly_score": -F.col("anomaly_score"), "anomaly_label": flagged(F.col("anomaly_label")),
        })
    return scored


# --- evaluation -----------------------------------------------------------


def cross_validate_forest(
    df: DataFrame, key: str, label: str = "fraudulent", k: int = 5, seed: int = 42, **params
) -> DataFrame:
    """Rows (fold, f1, precision, recall): fitted without labels, scored with them.

    Runs one distributed fit per fold, the folds side by side.
    """
    folds = settle(stratified_folds(df, key, label, k, seed))

    def one(i: int) -> DataFrame:
        model = fit_forest(folds.where(F.col("fold") != i), key, seed=seed, **params)
        scored = score_outliers(folds.where(F.col("fold") == i), model, "fraud")
        return confusion(scored, label, "anomaly_label", ["fold"])

    cells = reduce(DataFrame.union, side_by_side(df.sparkSession, one, list(range(k))))
    return precision_recall_f1(cells, None).select("fold", "f1", "precision", "recall")


# --- storage --------------------------------------------------------------


def save_forest(spark: SparkSession, model: Forest, path: str) -> None:
    """Store the node table and the one-row parameter table as a new version of ``path``."""
    nodes = model.nodes.astype(object).where(model.nodes.notna(), None)
    write_version(spark, path, {
        "nodes": spark.createDataFrame(nodes, NODE_SCHEMA).coalesce(1),
        "params": spark.createDataFrame(
            [(model.numeric, model.categorical, model.sample, model.contamination, model.offset)],
            "numeric array<string>, categorical array<string>, sample int, contamination double, offset double",
        ).coalesce(1),
    })


def load_forest(spark: SparkSession, path: str) -> Forest | None:
    """Read the current version of a stored forest; a missing or unreadable one gives None."""
    stored = read_stored(spark, current_version(spark, path), "params", "nodes")
    if stored is None:
        return None
    p, nodes = stored[0].first(), stored[1].toPandas()
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    return Forest(nodes, list(p.numeric), list(p.categorical), p.sample, p.contamination, p.offset)
