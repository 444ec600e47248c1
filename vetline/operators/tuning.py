"""Picking parameters and comparing the two outlier models."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["f1", "precision", "recall"]


def best_row(sweep: DataFrame, parameter: str, metric: str = "f1") -> DataFrame:
    """The row with the best metric; equal metrics go to the lowest parameter."""
    return sweep.orderBy(F.desc(metric), F.asc(parameter)).limit(1)


def compare_sweeps(forest: DataFrame, lof: DataFrame) -> DataFrame:
    """Both sweeps side by side, joined on contamination.

    The key is cast to a decimal, so that equal settings are equal exactly.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        named = df.withColumnsRenamed({c: f"{prefix}_{c}" for c in [*METRICS, "flagged"]})
        return named.withColumn("contamination", F.col("contamination").cast("decimal(4,2)"))

    joined = side(forest, "IF").join(side(lof, "LOF"), "contamination")
    return joined.withColumn("contamination", F.col("contamination").cast("double"))


def best_of_both(forest_best: DataFrame, lof_best: DataFrame) -> DataFrame:
    """One row with the best row of each model as the structs ``a`` and ``b``."""
    b = lof_best.select(F.struct("*")).scalar()
    return forest_best.select(F.struct("*").alias("a")).withColumn("b", b)


def head_to_head(both: DataFrame) -> DataFrame:
    """Rows (metric, IF, LOF, winner); the winner must be strictly better."""
    rows = both.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").alias("IF"), F.col(f"b.{m}").alias("LOF"))
        for m in METRICS
    ])))
    winner = F.when(F.col("IF") > F.col("LOF"), "IF").when(F.col("LOF") > F.col("IF"), "LOF")
    return rows.withColumn("winner", F.coalesce(winner, F.lit("Tie")))


def recommend(both: DataFrame, margin: float = 0.005) -> DataFrame:
    """One row (model, contamination, if_f1, lof_f1, reason).

    The better F1 wins; within ``margin`` the better recall does, and the
    forest wins a draw.
    """
    lead = F.col("a.f1") - F.col("b.f1")
    close = F.abs(lead) < margin
    forest = F.when(close, F.col("a.recall") >= F.col("b.recall")).otherwise(lead > 0)
    return both.select(
        F.when(forest, "IsolationForest").otherwise("LOF").alias("model"),
        F.when(forest, F.col("a.contamination")).otherwise(F.col("b.contamination")).alias("contamination"),
        F.col("a.f1").alias("if_f1"), F.col("b.f1").alias("lof_f1"),
        F.when(close, "recall").otherwise("f1").alias("reason"),
    )
