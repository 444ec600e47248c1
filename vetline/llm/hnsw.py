"""Approximate nearest neighbours by inner product: one navigable small-world graph per shard.

Equal vectors are one point of the index, with the ids that can be among the nearest.
Points are dealt into shards by hash; each shard becomes a hierarchical graph kept as flat
arrays, every query walks every shard's graph, and the shards' results are merged.

Within a shard, vectors are divided by the greatest length and get one more component that
brings all of them to length one. A query has 0 there, so the largest inner product with a
query is the nearest point, and the graph is built among points of one length.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetline.llm.common import stored
from vetline.llm.topk import usable

#: Points of a shard and queries of a block, about; a task holds one of each.
SHARD, BLOCK = 8192, 8192
#: Links of a point (twice as many on the ground layer), and points kept in sight while building and searching.
LINKS, BUILD, SEARCH = 16, 64, 192
#: Points handled at once.
BATCH = 512
SEED = 42


class Layer:
    """Points of a layer (numbers of the shard) and their links, a row each, filled up with -1."""

    def __init__(self, nodes: np.ndarray, links: np.ndarray):
        self.nodes, self.links = nodes, links


def _levels(n: int) -> np.ndarray:
    """The highest layer of each point: a LINKS-th of the points of a layer is in the next one."""
    draws = np.random.default_rng(SEED).random(n)
    return np.floor(-np.log(np.maximum(draws, 1e-300)) / np.log(LINKS)).astype(np.int64)


def _walk(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, sight: int,
          steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, scores): the best ``sight`` points that each query meets, best first, -1 where there are fewer.

    All queries go side by side; each opens its ``steps`` best unopened points at a time and
    stops when all it keeps in sight are open. ``entries`` has some starting points a query.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(points)), bool)
    seen[rows, entries] = True
    ids = np.full((n, sight), -1, np.int64)
    scores = np.full((n, sight), -np.inf, np.float32)
    opened = np.ones((n, sight), bool)
    width = min(sight, entries.shape[1])
    ids[:, :width] = entries[:, :width]
    scores[:, :width] = np.einsum("qkd,qd->qk", points[entries[:, :width]], queries)
    opened[:, :width] = False
    while True:
        waiting = np.where(opened, -np.inf, scores)
        best = np.argpartition(-waiting, min(steps, sight) - 1, axis=1)[:, :steps]
        live = np.take_along_axis(waiting, best, 1) > -np.inf
        active = np.flatnonzero(live.any(axis=1))
        if not len(active):
            break
        best, live, at = best[active], live[active], active[:, None]
        opened[at, best] |= live
        fresh = []
        for k in range(best.shape[1]):
            near = links[ids[active, best[:, k]]].astype(np.int64)
            near[~live[:, k]] = -1
            near[seen[at, near]] = -1  # -1 reads the last point's mark; such places stay -1
            i, j = np.nonzero(near >= 0)
            seen[active[i], near[i, j]] = True
            fresh.append(near)
        new = np.concatenate(fresh, axis=1)
        i, j = np.nonzero(new >= 0)
        found = np.full(new.shape, -np.inf, np.float32)
        found[i, j] = np.einsum("fd,fd->f", points[new[i, j]], queries[active[i]])
        all_ids = np.concatenate((ids[active], new), axis=1)
        all_scores = np.concatenate((scores[active], found), axis=1)
        all_open = np.concatenate((opened[active], found == -np.inf), axis=1)
        keep = np.argpartition(-all_scores, sight - 1, axis=1)[:, :sight]
        ids[active] = np.take_along_axis(all_ids, keep, 1)
        scores[active] = np.take_along_axis(all_scores, keep, 1)
        opened[active] = np.take_along_axis(all_open, keep, 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    return np.where(scores > -np.inf, ids, -1), scores


def _diverse(points: np.ndarray, own: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` links for each point of ``own`` out of ``near`` (best first, -1 at the end).

    A candidate is taken if no taken one is nearer to it than the point itself; places
    left over go to the best of the others.
    """
    out = np.full((len(own), most), -1, np.int32)
    for at in range(0, len(own), BATCH):
        cand, me = near[at : at + BATCH], points[own[at : at + BATCH]]
        here = points[cand]
        mine = np.einsum("bcd,bd->bc", here, me)
        between = here @ here.transpose(0, 2, 1)
        valid, taken = cand >= 0, np.zeros(cand.shape, bool)
        count = np.zeros(len(cand), np.int64)
        for c in range(cand.shape[1]):
            closer = (taken & (between[:, c] > mine[:, c : c + 1])).any(axis=1)
            taken[:, c] = valid[:, c] & ~closer & (count < most)
            count += taken[:, c]
        # Taken ones first, then the rest in order.
        rank = np.where(taken, 0, np.where(valid, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        chosen = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(cand, order, 1), -1)
        out[at : at + BATCH, : chosen.shape[1]] = chosen
    return out


def _ranked(points: np.ndarray, own: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Each row of ``near`` by falling score at its point, -1 last."""
    out = np.empty_like(near)
    for at in range(0, len(own), BATCH):
        cand = near[at : at + BATCH]
        scores = np.einsum("bcd,bd->bc", points[cand], points[own[at : at + BATCH]])
        order = np.argsort(np.where(cand >= 0, -scores, np.inf), axis=1, kind="stable")
        out[at : at + BATCH] = np.take_along_axis(cand, order, 1)
    return out


def _add_back(points: np.ndarray, links: np.ndarray, added: np.ndarray) -> None:
    """Links from the neighbours of the points ``added`` back to them; full lists are thinned out."""
    most = links.shape[1]
    k, j = np.nonzero(links[added] >= 0)
    source, target = added[k], links[added][k, j].astype(np.int64)
    order = np.lexsort((-np.einsum("fd,fd->f", points[source], points[target]), target))
    source, target = source[order], target[order]
    first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
    place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    nearest = place < most  # of those that come in at once, the best
    source, target, place = source[nearest], target[nearest], place[nearest]
    own, at = np.unique(target, return_inverse=True)
    coming = np.full((len(own), most), -1, np.int64)
    coming[at, place] = source
    held = links[own].astype(np.int64)
    coming[(coming[:, :, None] == held[:, None, :]).any(axis=2)] = -1  # linked already
    room = (held >= 0).sum(axis=1) + (coming >= 0).sum(axis=1) <= most
    both = np.concatenate((held, coming), axis=1)
    order = np.argsort(both[room] < 0, axis=1, kind="stable")
    links[own[room]] = np.take_along_axis(both[room], order, 1)[:, :most]
    if not room.all():
        full, near = own[~room], both[~room]
        links[full] = _diverse(points, full, _ranked(points, full, near), most)


def build(points: np.ndarray) -> list[Layer]:
    """The layers of a shard's graph, the ground layer first.

    Layers are made from the top. The points of the layer above come first, linked to
    each other; the others follow in batches no larger than what is linked already:
    each batch finds its way down the layers, sees the other points of its batch as well,
    and is linked in both directions.
    """
    levels, layers = _levels(len(points)), []
    for level in range(int(levels.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(levels >= level)
        most = 2 * LINKS if level == 0 else LINKS
        links = np.full((len(points), most), -1, np.int32)
        linked = np.flatnonzero(levels > level) if layers else nodes[:1]
        for done in (linked[at : at + BATCH] for at in range(0, len(linked), BATCH)):
            scores = points[done] @ points[linked].T
            scores[done[:, None] == linked[None, :]] = -np.inf
            width = min(BUILD, len(linked) - 1)
            if width:
                top = np.argsort(-scores, axis=1, kind="stable")[:, :width]
                links[done] = _diverse(points, done, linked[top], most)
        waiting = np.setdiff1d(nodes, linked)
        n = len(linked)
        while len(waiting):
            batch, waiting = waiting[: min(BATCH, n)], waiting[min(BATCH, n) :]
            start = descend(points, layers, points[batch]) if layers else np.repeat(linked[:1][None], len(batch), 0)
            near, scores = _walk(points, links, points[batch], start, BUILD)
            among = points[batch] @ points[batch].T
            np.fill_diagonal(among, -np.inf)
            width = min(len(batch) - 1, LINKS)
            if width:
                top = np.argsort(-among, axis=1, kind="stable")[:, :width]
                near = np.concatenate((near, batch[top]), axis=1)
                scores = np.concatenate((scores, np.take_along_axis(among, top, 1)), axis=1)
                order = np.argsort(-scores, axis=1, kind="stable")
                near = np.take_along_axis(near, order, 1)
            links[batch] = _diverse(points, batch, near, most)
            _add_back(points, links, batch)
            n += len(batch)
        layers.insert(0, Layer(nodes, links))
    return layers


def descend(points: np.ndarray, layers: list[Layer], queries: np.ndarray) -> np.ndarray:
    """Some good starting points of each query on the layer below ``layers``."""
    start = np.repeat(layers[-1].nodes[:1][None], len(queries), 0)
    for layer in reversed(layers):
        found, _ = _walk(points, layer.links, queries, start, 4)
        start = np.where(found >= 0, found, found[:, :1])
    return start


class Shard:
    """One shard's points, their graph and the ids of their rows."""

    def __init__(self, vectors: np.ndarray, layers: list[Layer] | None = None):
        self.vectors = vectors
        most = np.abs(vectors).max(initial=0)
        unit = vectors / (most or 1)
        lengths = (unit * unit).sum(axis=1)
        longest = lengths.max(initial=0) or 1
        more = np.sqrt(np.maximum(0, 1 - lengths / longest))
        self.points = np.concatenate((unit / np.sqrt(longest), more[:, None]), axis=1).astype(np.float32)
        self.layers = build(self.points) if layers is None else layers

    def search(self, queries: np.ndarray, k: int, sight: int = SEARCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, scores) of the points found for each query, at least k if there are, with exact scores."""
        sight = max(sight, 2 * k)
        for at in range(0, len(queries), BATCH):
            own = queries[at : at + BATCH]
            unit = own / (np.abs(own).max(axis=1, keepdims=True) + (own == 0).all(axis=1, keepdims=True))
            unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True).clip(1e-300))
            unit = np.concatenate((unit, np.zeros((len(own), 1))), axis=1).astype(np.float32)
            start = descend(self.points, self.layers[1:], unit) if len(self.layers) > 1 else np.repeat(
                self.layers[0].nodes[:1][None], len(own), 0)
            found, _ = _walk(self.points, self.layers[0].links, unit, start, sight)
            for query, near in zip(own, found):
                near = near[near >= 0]
                yield near, (self.vectors[near] * query).sum(axis=1)


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros to ``width``."""
    held = lists.combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    sizes = np.diff(held.offsets.to_numpy())
    out = np.zeros((len(held), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = held.flatten().to_numpy()
    return out


INDEX = ("shard int, vectors array<double>, k1 array<long>, k2 array<long>, ids array<long>, id_sizes array<int>, "
         "layers array<struct<nodes:array<int>,links:array<int>>>")


def build_index(points: DataFrame, shards: int, width: int) -> DataFrame:
    """One row per shard: vectors, graph and ids as flat arrays.

    ``points`` has k1, k2 (which stand for a vector), vector and ids. ``layers`` goes from
    the ground up: point numbers, and as many links for each of them (-1: none).
    """

    def make(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("k1", "ascending"), ("k2", "ascending")])
        vectors = matrix(table.column("vector"), width)
        graph = Shard(vectors)
        ids = table.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        row = {
            "shard": key[0].as_py(), "vectors": vectors.ravel(), "k1": table.column("k1").to_numpy(),
            "k2": table.column("k2").to_numpy(), "ids": ids.flatten().to_numpy(),
            "id_sizes": np.diff(ids.offsets.to_numpy()).astype(np.int32),
            "layers": [{"nodes": la.nodes.astype(np.int32), "links": la.links[la.nodes].ravel()} for la in graph.layers],
        }
        kinds = {"vectors": pa.float64(), "k1": pa.int64(), "k2": pa.int64(), "ids": pa.int64(), "id_sizes": pa.int32()}
        layer = pa.struct([("nodes", pa.list_(pa.int32())), ("links", pa.list_(pa.int32()))])
        return pa.table({
            "shard": pa.array([row["shard"]], pa.int32()),
            **{c: pa.array([row[c]], pa.list_(t)) for c, t in kinds.items()},
            "layers": pa.array([row["layers"]], pa.list_(layer)),
        })

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)).cast("int"))
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(make, INDEX)


def read_shard(row: dict, width: int) -> Shard:
    """A shard from its row of the index."""
    vectors = np.asarray(row["vectors"], np.float64).reshape(-1, width)
    layers = []
    for at, layer in enumerate(row["layers"]):
        nodes = np.asarray(layer["nodes"], np.int64)
        links = np.full((len(vectors), 2 * LINKS if at == 0 else LINKS), -1, np.int32)
        links[nodes] = np.asarray(layer["links"], np.int32).reshape(len(nodes), -1)
        layers.append(Layer(nodes, links))
    return Shard(vectors, layers)


def _search(index: DataFrame, asked: DataFrame, shards: int, blocks: int, width: int, keep: int, sight: int) -> DataFrame:
    """(k1, k2, vec_id, score, own): for each query vector the ``keep`` best ids of each shard."""

    def look(_: tuple, held: pa.Table, wanted: pa.Table) -> pa.Table:
        queries = matrix(wanted.column("vector"), width)
        k1, k2 = wanted.column("k1").to_numpy(), wanted.column("k2").to_numpy()
        parts = [[], [], [], []]
        for at in range(held.num_rows):
            row = {c: held.column(c)[at].values if c != "layers" else held.column(c)[at].as_py()
                   for c in held.column_names if c not in ("shard", "block")}
            graph = read_shard({c: v if c == "layers" else v.to_numpy() for c, v in row.items()}, width)
            ids, own1, own2 = row["ids"].to_numpy(), row["k1"].to_numpy(), row["k2"].to_numpy()
            ends = np.cumsum(row["id_sizes"].to_numpy())
            starts = np.concatenate(([0], ends[:-1]))
            for q, (near, scores) in enumerate(graph.search(queries, keep, sight)):
                sizes = ends[near] - starts[near]
                point = np.repeat(np.arange(len(near)), sizes)
                places = np.arange(len(point)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[near][point]
                best = np.lexsort((ids[places], -scores[point]))[:keep]
                point = point[best]
                parts[0].append(np.full(len(best), q))
                parts[1].append(ids[places[best]])
                parts[2].append(scores[point])
                parts[3].append((own1[near[point]] == k1[q]) & (own2[near[point]] == k2[q]))
        asker, found, scores, own = (np.concatenate(p) if p else np.empty(0) for p in parts)
        asker = asker.astype(np.int64)
        return pa.table([pa.array(k1[asker]), pa.array(k2[asker]), pa.array(found.astype(np.int64)),
                         pa.array(scores.astype(np.float64)), pa.array(own.astype(bool))],
                        names=["k1", "k2", "vec_id", "score", "own"])

    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    left, right = (df.repartition(shards * blocks, "shard", "block") for df in (left, right))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        look, "k1 long, k2 long, vec_id long, score double, own boolean")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, sight: int = SEARCH, shard: int = SHARD,
            block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row that ``queries`` selects.

    ``vectors`` has vec_id and embedding. Nearness is the inner product in double
    precision, larger is nearer, ties to the smaller vec_id; candidates are all rows but the
    query's own, all of them if fewer than k. The search is approximate: ``sight`` points
    are kept in sight on a shard's ground layer; every score is exact.

    Rows with a null vec_id, a null or zero vector or a null or non-finite component take
    no part. Rows that share a vec_id are rows of their own, as queries too. The shorter of
    two vectors ends in zeros. Equal vectors are one point of the graph; it holds their
    k + 1 smallest ids, as no others can be among the k nearest. Other columns are ignored, an
    empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    # Two independent hashes that stand for a vector.
    rows = rows.withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector"))
    asked = rows.where(queries).select("vec_id", "k1", "k2")
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    points = stored(
        rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("k1", "k2")
        .agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    wanted = points.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "vector")
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    n_asked, width = wanted.count(), width or 1
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_asked // block))
    index = stored(build_index(points, shards, width), "graphs")
    found = _search(index, wanted, shards, blocks, width, k + 1, sight)
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    answers = first.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct("at", "vec_id", "score", "own"))).alias("found"))
    joined = asked.withColumnRenamed("vec_id", "query_id").join(answers, ["k1", "k2"])
    # Of the entries with the query's own vector and id one is the query itself.
    itself = F.array_position(
        F.transform("found", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), F.lit(True))
    others = F.slice(F.filter("found", lambda x, i: i + 1 != itself), 1, k)
    return joined.select("query_id", F.posexplode(others).alias("place", "entry")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "entry.vec_id", "entry.score")
