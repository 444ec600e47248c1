"""SimHash near-duplicates: fingerprints, blocks that close pairs share, components."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.llm.common import hex64, slices, stored, texts_of
from vetline.llm.graph import components

SEED = 42
#: Shingles whose bits are counted at once.
PIECE = 1 << 15
#: Members of a block compared in one piece; a larger block is cut into pairs of pieces.
CHUNK = 2048
#: Rows of sorted blocks handled at once, unless one block alone has more.
WINDOW = 1 << 16


def fingerprint(text: str, words: int = 4) -> int:
    """The 64-bit SimHash of a text, unsigned.

    A-Z in lower case, words between ASCII white space, shingles of ``words`` words
    with repeats (fewer words: the whole sequence; none: 0). A bit is 1 if it is
    set in over half the shingle hashes.
    """
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    width = min(words, len(tokens))
    starts = np.concatenate(([0], ends[: len(ends) - width] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), PIECE):
        hashes = b"".join(
            [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + PIECE], stops[at : at + PIECE])]
        )
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed long; a null text counts as the empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks such that two fingerprints within ``distance`` agree under at least one.

    The 64 bits fall into ``blocks`` blocks; ``distance`` differing bits touch at most
    that many, so some choice of the remaining ones agrees in full.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(each, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(block, fp): one row per fingerprint and mask, large blocks as pairs of pieces.

    A block key is a hash of mask number and masked bits; a collision only adds
    candidates.
    """
    keys = F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for i, m in enumerate(masks)
    ])
    rows = prints.select("fp", F.explode(keys).alias("block"))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > CHUNK).select(
        "block", F.ceil(F.col("n") / CHUNK).cast("int").alias("pieces")
    )
    rows = rows.join(large, "block", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("pieces")).cast("int")
    return rows.withColumn("mine", mine).select(
        "fp", "block", "pieces", "mine", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    ).select(
        F.when(F.col("pieces") == 1, F.col("block")).otherwise(
            F.xxhash64("block", F.least("mine", "other"), F.greatest("mine", "other"))
        ).alias("block"),
        "fp",
    )


def _least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indices over links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def _close_pairs(block: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows that share a block and differ in at most ``distance`` bits; of crowded blocks a spanning forest."""
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    size = np.diff(np.append(first, len(block)))
    left, right = [], []
    small = np.repeat(size <= 32, size)
    for step in range(1, 32):  # neighbours in the sorted order, all small blocks at once
        i = np.flatnonzero((block[step:] == block[:-step]) & small[step:])
        if not len(i):
            break
        near = np.bitwise_count(fp[i] ^ fp[i + step]) <= distance
        left.append(i[near])
        right.append(i[near] + step)
    for at, n in zip(first[size > 32], size[size > 32]):
        own, a, b = fp[at : at + n], np.empty(0, np.int64), np.empty(0, np.int64)
        for i in range(0, n, 256):
            x, y = np.nonzero(np.bitwise_count(own[i : i + 256, None] ^ own[None, i:]) <= distance)
            keep = x < y
            root = _least_reachable(n, np.concatenate((a, i + x[keep])), np.concatenate((b, i + y[keep])))
            a = np.flatnonzero(root != np.arange(n))
            b = root[a]
        left.append(at + a)
        right.append(at + b)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _spanning(block: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each block, what close pairs connect: fewer than rows."""
    a, b = _close_pairs(block, fp, distance)
    root = _least_reachable(len(fp), a, b)
    i = np.flatnonzero(root != np.arange(len(fp)))
    return fp[i], fp[root[i]]


def fingerprint_links(prints: DataFrame, distance: int = 4, blocks: int = 7) -> DataFrame:
    """(a, b): links between different fingerprints, with the components of all close pairs.

    Rows are dealt by block and compared there; of a block's close pairs only a
    spanning forest leaves the task, so a crowded block gives no more links than it
    has members. No link between components is lost.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_block, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def linked(block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _spanning(block, fp, distance)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held_block = np.concatenate((held_block, batch.column("block").to_numpy()))
            held_fp = np.concatenate((held_fp, batch.column("fp").to_numpy().view(np.uint64)))
            while len(held_block) >= WINDOW:
                last = held_block[-1]
                cut = np.searchsorted(held_block, last)  # the last block may go on
                if cut == 0:
                    break
                yield linked(held_block[:cut], held_fp[:cut])
                held_block, held_fp = held_block[cut:], held_fp[cut:]
        if len(held_block):
            yield linked(held_block, held_fp)

    rows = _blocks(prints.select("fp").distinct(), block_masks(blocks, distance))
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(work, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 4, distance: int = 4, blocks: int = 7
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Fingerprints link at ``distance`` or fewer differing bits. Copies meet as one
    fingerprint, so links are only sought between different fingerprints. Null texts
    count as empty, empty texts have fingerprint 0 and link like any other. Rows
    without a doc_id link nothing and have a null component_id; rows that share one
    are one document each and link like others. Further columns are ignored. An empty
    table gives an empty result.
    """
    prints = stored(fingerprints(docs, words), "simhash")
    named = prints.where("doc_id is not null")
    first = named.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(first, distance, blocks))
    first = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = first.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = first.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def fingerprint_text(fp: Column) -> Column:
    return hex64(fp)


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` without all but the first document of each component.

    A row without doc_id stays. Of rows that share a doc_id, and so cannot be told
    apart, those of the first document stay.
    """
    found = near_duplicates(docs, **parameters)
    dropped = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
