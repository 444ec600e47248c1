"""From training and validation rows to the winning, refitted outlier model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline import schema
from vetline.operators import iforest, metrics, neighbours, tuning
from vetline.runtime import current_version, publish, read_stored, settle, version_folder


@dataclass
class Winner:
    """A model ready to score: what it is, its settings, and the score below which a row is flagged."""

    kind: str  # IsolationForest or LOF
    model: iforest.Forest | neighbours.LofModel
    contamination: float
    n_neighbors: int | None
    offset: float


@dataclass
class Selection:
    """The sweeps, the recommendation, and the winner fitted on all training rows."""

    forest_sweep: DataFrame
    lof_sweep: DataFrame
    neighbour_sweep: DataFrame
    recommendation: DataFrame
    winner: Winner


def sweep_forest(
    train: DataFrame, val: DataFrame, key: str, label: str, contaminations: list[float], seed: int = 42
) -> tuple[DataFrame, iforest.Forest]:
    """Rows (contamination, f1, precision, recall, flagged) from one fit and one scoring pass."""
    model = iforest.fit_forest(train, key, seed=seed)
    new = iforest.score_vectors(val, model, [label])
    sweep = metrics.contamination_sweep(
        None, new, "score", label, contaminations, weight="rows", train_counts=model.scores)
    return sweep, model


def select_model(
    train: DataFrame, val: DataFrame, key: str, label: str = "fraudulent",
    contaminations=tuple(schema.CONTAMINATIONS), ks=tuple(schema.NEIGHBOUR_COUNTS), seed: int = 42,
) -> Selection:
    """Sweep both models, let the better one win, and set it up on all training rows.

    The forest and the densities do not depend on the contamination, so the
    winner needs its offset only, not another fit. The factor model takes the
    best contamination first (at 20 neighbours), then the best neighbour count.
    """
    contaminations, ks = list(contaminations), sorted({*ks, 20})
    forest_sweep, forest = sweep_forest(train, val, key, label, contaminations, seed)
    forest_sweep = settle(forest_sweep)
    lof = neighbours.fit_lof(train, schema.FEATURES, ks)
    lof_sweep = settle(neighbours.sweep_lof_contamination(lof, val, label, contaminations, 20))
    best_c = tuning.best_row(lof_sweep, "contamination").first()["contamination"]
    neighbour_sweep = settle(neighbours.sweep_lof_neighbours(lof, val, label, best_c))
    both = tuning.best_of_both(
        tuning.best_row(forest_sweep, "contamination"), tuning.best_row(neighbour_sweep, "n_neighbors"))
    recommendation = settle(tuning.recommend(both))
    chosen = recommendation.first()
    n = tuning.best_row(neighbour_sweep, "n_neighbors").first()["n_neighbors"]
    if chosen["model"] == "IsolationForest":
        forest.contamination = chosen["contamination"]
        forest.offset = iforest.forest_offsets(forest.scores, [forest.contamination])[0]
        winner = Winner("IsolationForest", forest, forest.contamination, None, forest.offset)
    else:
        winner = Winner("LOF", lof, chosen["contamination"], n, neighbours.lof_offset(lof, n, chosen["contamination"]))
    return Selection(forest_sweep, lof_sweep, neighbour_sweep, recommendation, winner)


def save_winner(spark: SparkSession, winner: Winner, path: str) -> None:
    """Store the winner with its settings as a new version, compare it with what was meant, then publish it.

    Until it is published readers see the version before.
    """
    forest = winner.kind == "IsolationForest"
    folder = version_folder(path)
    if forest:
        iforest.save_forest(spark, winner.model, f"{folder}/model")
    else:
        neighbours.save_lof(winner.model, f"{folder}/model")
    spark.createDataFrame(
        [(winner.kind, winner.contamination, winner.n_neighbors, winner.offset)],
        "kind string, contamination double, n_neighbors int, offset double",
    ).coalesce(1).write.parquet(f"{folder}/winner")
    again = _winner_in(spark, folder)
    same = again is not None and (again.kind, again.contamination, again.n_neighbors, again.offset) == (
        winner.kind, winner.contamination, winner.n_neighbors, winner.offset)
    if same:
        same = (
            len(again.model.nodes) == len(winner.model.nodes) if forest
            else again.model.rows == winner.model.rows and again.model.table.count() == winner.model.table.count()
        )
    if not same:
        raise OSError(f"what is stored at {folder} is not what was to be stored")
    publish(spark, path, folder)


def load_winner(spark: SparkSession, path: str) -> Winner | None:
    """The published winner; a missing or unreadable one gives None."""
    return _winner_in(spark, current_version(spark, path))


def _winner_in(spark: SparkSession, path: str | None) -> Winner | None:
    stored = read_stored(spark, path, "winner")
    if stored is None:
        return None
    p = stored[0].first()
    load = iforest.load_forest if p.kind == "IsolationForest" else neighbours.load_lof
    model = load(spark, f"{path}/model")
    return None if model is None else Winner(p.kind, model, p.contamination, p.n_neighbors, p.offset)


def score_with_winner(df: DataFrame, winner: Winner | None) -> DataFrame:
    """Add ``outlier_score`` (higher is more suspicious) and ``outlier_predict`` (1 = fraud).

    Without a winner every row is neutral.
    """
    if winner is None or winner.kind == "IsolationForest":
        return iforest.score_outliers(df, winner and winner.model, "fraud").withColumnsRenamed(
            {"anomaly_score": "outlier_score", "anomaly_label": "outlier_predict"})
    scored = neighbours.score_lof(df, winner.model, winner.n_neighbors, winner.contamination, winner.offset)
    return scored.select(
        *df.columns, (-F.col("lof_score")).alias("outlier_score"),
        (F.col("lof_anomaly") == -1).cast("int").alias("outlier_predict"))
