"""Exact top-k by inner product: columnar branch and bound over dimension blocks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetline.llm.common import stored

#: Candidates of a cell and queries of a block, about; a task holds one of each.
CELL, BLOCK = 32768, 32768
#: Dimensions added before survivors are looked for again, and candidates scored in full first.
STEP, OPENING = 8, 256
#: Sums below this are exact in doubles.
EXACT = 1 << 53


def scaled(vector: Column) -> Column:
    """floor(256 * x) of each component, as long (saturating)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    """A vector that is not null and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & finite


class Columns:
    """A cell's vectors by dimension, the most widely spread first, with their remaining mass."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, names: np.ndarray | None = None):
        self.ids, self.names = ids, ids if names is None else names
        self.order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable") if len(rows) else np.arange(rows.shape[1])
        self.values = np.ascontiguousarray(rows.T[self.order])
        self.most = int(np.abs(self.values).max(initial=0))
        self.mass = self._mass(self.values)
        heavy = np.argsort(-self.mass[0], kind="stable")[:OPENING]
        self.opening = np.sort(heavy)

    @staticmethod
    def _mass(values: np.ndarray) -> np.ndarray:
        """Length of what is left of each vector at every block of dimensions."""
        squares = values.astype(np.float64) ** 2
        ends = [squares[at:].sum(axis=0) for at in range(0, len(values), STEP)]
        return np.sqrt(np.array(ends)) * (1 + 1e-9) if ends else np.zeros((1, values.shape[1]))

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors that are not named ``own``, ties to the smaller id."""
        query = query[self.order]
        most = max(1, len(query)) * max(1, int(np.abs(query).max(initial=0))) * max(1, self.most)
        kind = np.float64 if most < EXACT else np.int64 if most < 1 << 62 else object
        values, query = self.values.astype(kind, copy=False), query.astype(kind)
        opening = self.opening[self.names[self.opening] != own]
        opened = query @ values[:, opening] if len(query) else np.zeros(len(opening), kind)
        least = np.sort(opened)[-k] if len(opened) >= k else None
        left, sums = np.flatnonzero(self.names != own), None
        mine = self._mass(query[:, None])[:, 0] if len(query) else [0]
        for block, at in enumerate(range(0, len(query), STEP)):
            part = values[at : at + STEP]
            part = part if len(left) == part.shape[1] else part[:, left]
            added = query[at : at + STEP] @ part
            sums = added if sums is None else sums + added
            if least is not None and at + STEP < len(query):
                bound = sums.astype(np.float64) + mine[block + 1] * self.mass[block + 1][left]
                keep = bound >= float(least) - 1e-6 * (1 + abs(float(least)))
                if not keep.all():
                    left, sums = left[keep], sums[keep]
        if sums is None:
            sums = np.zeros(len(left), kind)
        if len(sums) > k:
            bar = np.sort(sums)[-k]
            left, sums = left[sums >= bar], sums[sums >= bar]
        order = np.lexsort((self.ids[left], [-s for s in sums] if kind is object else -sums))[:k]
        scores = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in sums[order]]
        return self.ids[left[order]], np.array(scores, np.int64)


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, names, vectors) in the order of ids and names; vectors filled up with zeros to ``width``."""
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    held = table.column("vector").combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    sizes = np.diff(held.offsets.to_numpy())
    out = np.zeros((len(held), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = held.flatten().to_numpy()
    return table.column("vec_id").to_numpy(), table.column("row").to_numpy(), out


def top_k(vectors: DataFrame, queries: Column, k: int = 5, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best scores of every row that ``queries`` selects.

    ``vectors`` has vec_id and embedding. Components become floor(256 * x); a score is the
    inner product with another row's vector, all of them if fewer than k, ties to the
    smaller vec_id. Rows with a null vec_id, a null vector or a null or non-finite
    component take no part. Rows that share a vec_id are rows of their own, as queries too,
    told apart by their place in the stored table. The shorter of two vectors ends in zeros. Scores saturate at the limits of a long, and
    which of several saturated ones are listed is left open. Other
    columns are ignored, an empty table gives an empty result.

    Candidates fall into cells and queries into blocks of bounded size, by hash. Each
    task meets one cell with one block: it adds up the score dimension block by
    dimension block, and after each keeps only candidates whose sum, with the longest
    product that the remaining dimensions allow, can still reach the k-th best score.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    whole = whole.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = stored(whole.select(
        "vec_id", scaled(F.col("vector")).alias("vector"), F.monotonically_increasing_id().alias("row")), "vectors")
    asked = rows.where(queries)
    n, width, n_asked = rows.agg(
        F.count(F.lit(1)), F.max(F.size("vector")), F.count_if(queries)
    ).first()
    cells = max(-(-n // cell), 2 * spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-n_asked // block))
    width = width or 0

    def spread(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    def search(_: tuple, held: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, names, matrix = _matrix(held, width)
        columns, found = Columns(ids, matrix, names), []
        for q, name, vector in zip(*_matrix(wanted, width)):
            best, scores = columns.best(vector, int(name), k)
            found.append((np.full(len(best), q), np.full(len(best), name), best, scores))
        parts = [np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(4)]
        return pa.table([pa.array(p, pa.int64()) for p in parts], names=["query_id", "query_row", "vec_id", "score"])

    candidates = spread(rows, "cell", cells, "block", blocks).groupBy("cell", "block")
    found = candidates.cogroup(spread(asked, "block", blocks, "cell", cells).groupBy("cell", "block")).applyInArrow(
        search, "query_id long, query_row long, vec_id long, score long"
    )
    best_first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


ORACLE = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
