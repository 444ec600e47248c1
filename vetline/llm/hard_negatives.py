"""Hard negatives: candidates whose scores fall into windows below an anchor's positive scores.

Anchors of a block hang in a tree of least total edge length. What a candidate can score at
an anchor follows from its score at the parent: the two differ by at most the length of the
edge times the length of the candidate. Only candidates whose bounds meet the windows of
the anchor are scored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetline.llm.common import stored
from vetline.llm.topk import scaled, usable

#: Candidates of a cell and anchors of a block, about; a task holds one of each.
CELL, BLOCK = 32768, 1024
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive score that a negative's score has at least and at most.
LEAST, MOST = 30, 90
LONG = (1 << 63) - 1
#: Products and sums below this are exact in doubles.
EXACT = 1 << 53


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a least spanning tree of the rows of ``points``.

    Rows in ``order`` come after their parents; the root is its own parent.
    """
    n = len(points)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf)
    out = np.ones(n, bool)
    at = 0
    for step in range(n):
        if step:
            at = int(np.argmin(np.where(out, edge, np.inf)))
            if not out[at]:  # only lengths beyond a double are left
                at = int(np.argmax(out))
        order[step], out[at] = at, False
        away = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        nearer = out & (away < edge)
        edge[nearer], parent[nearer] = away[nearer], at
    if n:
        edge[0] = 0.0
    return order, parent, edge


class Cell:
    """The candidates of a task."""

    def __init__(self, table: pa.Table, width: int):
        self.ids = table.column("vec_id").to_numpy()
        self.rows = table.column("row").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.vectors = matrix(table.column("vector"), width)
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        self.most = int(np.abs(self.vectors).max(initial=0))

    def kind(self, anchors: np.ndarray) -> np.dtype:
        """The cheapest type that holds every product and sum exactly."""
        most = max(1, anchors.shape[1]) * max(1, self.most) * max(1, int(np.abs(anchors).max(initial=0)))
        return np.dtype(np.float64 if most < EXACT else np.int64 if most < LONG else object)


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Equal rows of integers, filled up with zeros to ``width``."""
    held = lists.combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    sizes = np.diff(held.offsets.to_numpy())
    out = np.zeros((len(held), width), np.int64)
    values = held.flatten().to_numpy()
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


class Walk:
    """Scores of a cell's candidates along an anchor tree; ``scored`` counts products made."""

    def __init__(self, cell: Cell, anchors: np.ndarray, order: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        kind = cell.kind(anchors)
        self.cell, self.order, self.parent, self.edge = cell, order, parent, edge
        self.vectors, self.anchors = cell.vectors.astype(kind), anchors.astype(kind)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.children = np.bincount(parent[order[1:]], minlength=len(order)) if len(order) else np.zeros(0, np.int64)
        self.scored = 0

    def bounds(self, at: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of every candidate at an anchor, from its parent's."""
        n = len(self.cell.ids)
        if step == 0:
            return np.full(n, -np.inf), np.full(n, np.inf)
        above = int(self.parent[at])
        low, high = self.held[above]
        with np.errstate(invalid="ignore"):
            reach = self.edge[at] * self.cell.norms
        reach = np.where(np.isnan(reach), np.inf, reach)
        slack = reach * (1 + 1e-9) + 1e-6 + 1e-12 * np.maximum(np.abs(low), np.abs(high))
        self.children[above] -= 1
        if not self.children[above]:
            del self.held[above]
        return low - slack, high + slack

    def meet(self, at: int, step: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all candidates whose scores may lie from ``least`` to ``most``."""
        low, high = self.bounds(at, step)
        places = np.flatnonzero((high >= float(least)) & (low <= float(most)))
        part = self.vectors if len(places) == len(low) else self.vectors[places]
        scores = part @ self.anchors[at] if self.vectors.shape[1] else np.zeros(len(places), self.vectors.dtype)
        self.scored += len(places)
        if self.children[at]:
            low[places] = high[places] = scores.astype(np.float64)
            self.held[at] = low, high
        return places, scores


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    kept = np.arange(len(scores))
    if len(scores) > k:
        bar = np.sort(scores)[-k]
        kept = np.flatnonzero(scores >= bar)
    falling = np.array([-s for s in scores[kept]]) if scores.dtype == object else -scores[kept]
    return kept[np.lexsort((ids[kept], falling))[:k]]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array([max(-LONG - 1, min(LONG, int(v))) for v in values], pa.int64())


def _anchors(table: pa.Table, width: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's anchors in the order of their positions, with the tree."""
    table = table.sort_by("position")
    return (table, matrix(table.column("vector"), width), np.argsort(table.column("step").to_numpy(), kind="stable"),
            table.column("parent").to_numpy(), table.column("edge").to_numpy())


def _trees(anchors: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``anchors`` with position, step, parent and edge in the tree of their block (``keys``)."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        order, parent, edge = spanning_tree(matrix(table.column("vector"), width).astype(np.float64))
        step = np.empty(len(order), np.int64)
        step[order] = np.arange(len(order))
        for name, values in (("position", np.arange(len(order))), ("step", step), ("parent", parent), ("edge", edge)):
            table = table.append_column(name, pa.array(values))
        return table

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.groupBy(*keys).applyInArrow(grow, f"{fields}, position long, step long, parent long, edge double")


def _spread(df: DataFrame, own: str, count: Column, other: str, others: Column) -> DataFrame:
    """Deal rows into ``count`` groups by hash and copy them to all ``others``."""
    return df.withColumn(own, F.pmod(F.xxhash64("row"), count).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), others - 1)))


def _positives(rows: DataFrame, anchors: DataFrame, width: int, k: int, cell: int, block: int) -> DataFrame:
    """(anchor, score, positive_id, positive_row): the k best other rows of the anchor's label."""

    def search(_: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        own, found = Cell(held, width), []
        table, vectors, order, parent, edge = _anchors(asked, width)
        walk, names = Walk(own, vectors, order, parent, edge), table.column("row").to_numpy()
        opening = np.arange(min(len(own.ids), 64))
        opened = walk.vectors[opening] @ walk.anchors.T if width else np.zeros((len(opening), len(names)), np.int64)
        for step, at in enumerate(order):
            first = opened[own.rows[opening] != names[at], at]
            least = np.sort(first)[-k] if len(first) >= k else -np.inf
            places, scores = walk.meet(at, step, least, np.inf)
            other = own.rows[places] != names[at]
            places, scores = places[other], scores[other]
            best = _best(own.ids[places], scores, k)
            found.append((np.full(len(best), names[at]), places[best], scores[best]))
        if not found:
            return _pairs_table([], own)
        return _pairs_table(found, own)

    sizes = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells"))
    asked = anchors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sizes = sizes.join(asked, "label")
    blocks = anchors.join(asked, "label").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    trees = _trees(blocks.select("row", "vec_id", "label", "vector", "block"), ["label", "block"], width)
    left = _spread(rows.join(sizes, "label"), "cell", F.col("cells"), "block", F.col("blocks"))
    right = trees.join(sizes.select("label", "cells"), "label").withColumn(
        "cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    by = ["label", "block", "cell"]
    found = left.select(*by, "row", "vec_id", "vector").withColumn("label", F.col("label")).groupBy(*by).cogroup(
        right.select(*by, "row", "vector", "position", "step", "parent", "edge").groupBy(*by)
    ).applyInArrow(search, "anchor long, id long, row long, score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _pairs_table(found: list[tuple], own: Cell) -> pa.Table:
    anchors = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
    places = np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])
    scores = [s for f in found for s in f[2]]
    return pa.table([pa.array(anchors), pa.array(own.ids[places]), pa.array(own.rows[places]), _long(scores)],
                    names=["anchor", "id", "row", "score"])


def _negatives(rows: DataFrame, anchors: DataFrame, width: int, k: int, window: tuple[int, int],
               cells: int, blocks: int) -> DataFrame:
    """(anchor, place, negative_id, negative_row, score): rows of other labels in the window of a positive."""
    least, most = window

    def search(_: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        own, found = Cell(held, width), []
        table, vectors, order, parent, edge = _anchors(asked, width)
        walk, names = Walk(own, vectors, order, parent, edge), table.column("row").to_numpy()
        labels, positives = table.column("label").to_numpy(), table.column("positives").to_pylist()
        for step, at in enumerate(order):
            # 100 n >= least p and 100 n <= most p, for integers n
            windows = [(-(-least * p // 100), most * p // 100) for p in positives[at]]
            open_ = [w for w in windows if w[0] <= w[1]]
            low, high = (min(w[0] for w in open_), max(w[1] for w in open_)) if open_ else (np.inf, -np.inf)
            places, scores = walk.meet(at, step, low, high)
            fits = own.labels[places] != labels[at]
            places, scores = places[fits], scores[fits]
            for place, (a, b) in enumerate(windows):
                inside = np.flatnonzero((scores >= a) & (scores <= b))
                best = inside[_best(own.ids[places[inside]], scores[inside], k)]
                found.append((names[at], place, places[best], scores[best]))
        sizes = [len(f[2]) for f in found]
        places = np.concatenate([f[2] for f in found] or [np.empty(0, np.int64)])
        return pa.table([
            pa.array(np.repeat(np.array([f[0] for f in found], np.int64), sizes)),
            pa.array(np.repeat(np.array([f[1] for f in found], np.int32), sizes)),
            pa.array(own.ids[places]), pa.array(own.rows[places]), _long([s for f in found for s in f[3]]),
        ], names=["anchor", "place", "negative_id", "negative_row", "score"])

    trees = _trees(anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), ["block"], width)
    left = _spread(rows, "cell", F.lit(cells), "block", F.lit(blocks))
    right = trees.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    by = ["cell", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        search, "anchor long, place int, negative_id long, negative_row long, score long")


def labelled(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the rows that take part; every seventh label is shifted by one."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").alias("vector"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", shifted.alias("label"), scaled(F.col("vector")).alias("vector"))


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = (LEAST, MOST), cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and vector (array of long), none of them null, for instance
    from ``labelled``; ``anchors`` selects the anchors. A score is the integer inner
    product with the anchor, higher ones first, ties to the smaller vec_id. An anchor's
    positives are its first other rows of the same label. For each positive, the first rows
    of other labels whose score is from ``window[0]`` to ``window[1]`` percent of the
    positive's; without any there is no row.

    Rows that share a vec_id are rows of their own (as anchors too), told apart by their
    place in the stored table. The shorter of two vectors ends in zeros. Scores saturate at
    the limits of a long. Other columns are ignored; without anchors, without rows of
    another label, or with an empty table the result is empty.
    """
    rows = stored(rows.select("vec_id", "label", "vector").withColumn("row", F.monotonically_increasing_id()), "candidates")
    asked = rows.where(anchors)
    n, n_asked, width = rows.agg(F.count(F.lit(1)), F.count_if(anchors), F.max(F.size("vector"))).first()
    width, cells, blocks = width or 0, int(max(1, -(-n // cell))), int(max(1, -(-n_asked // block)))
    found = stored(_positives(rows, asked, width, positives, cell, block), "positives")
    by_place = F.sort_array(F.collect_list(F.struct("place", "score")))
    windows = found.groupBy(F.col("anchor").alias("row")).agg(F.transform(by_place, lambda x: x["score"]).alias("positives"))
    kept = _negatives(rows, asked.join(windows, "row"), width, negatives, window, cells, blocks)
    positive = found.select("anchor", (F.col("place") - 1).alias("place"), F.col("id").alias("positive_id"),
                            F.col("score").alias("positive_score"))
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "negative_id", "negative_row")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    names = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(positive, ["anchor", "place"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS MATERIALIZED (
    SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same,
        list_inner_product(a.e, c.e)::BIGINT AS score
    FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0
), p AS (
    SELECT a, anchor_id, c AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY a, p ORDER BY score DESC, vec_id)::INT AS rank
    FROM p JOIN s USING (a, anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
