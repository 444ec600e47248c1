"""Benchmark items found again inside documents: signatures by item size, exact check."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.llm.common import free_names, slices, stored, texts_of

WORD = re.compile(r"[^\W_]+")
#: Words hashed at once; longer texts go in overlapping pieces.
PIECE = 1 << 16
#: Bits of the signature filter that goes to all tasks: 64 per entry, at most 8 MB in all.
#: Six probes let about one foreign shingle in two million pass, so few documents do.
BITS_PER_ENTRY, MAX_FILTER_BITS, PROBES = 64, 1 << 26, 6
BASE = 0x9E3779B97F4A7C15 | 1


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def shingles(words: list[str], width: int) -> list[str]:
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as far as asked for."""

    inverse = pow(BASE, -1, 1 << 64)
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", cls.inverse)):
                steps = np.full(max(n, 1 << 16), base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[str], width: int) -> np.ndarray:
    """64-bit hashes of all shingles of ``width`` words, from prefix sums over the bytes."""
    found = []
    for at in range(0, max(len(words) - width + 1, 0), PIECE):
        data = np.frombuffer((" ".join(words[at : at + PIECE + width - 1]) + " ").encode(), np.uint8)
        up, down = _Powers.upto(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + 1) * up[: len(data)])))
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends) - width + 1]
        found.append(_mixed((sums[ends[width - 1 :]] - sums[starts]) * down[starts]))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def required(n: int, least: float) -> int:
    """Matches that ``n`` distinct shingles need for a containment of ``least``."""
    return int(np.ceil(least * n - 1e-9))


def signature_length(n: int, least: float) -> int:
    """MinHash values that an item with ``n`` distinct shingles keeps.

    Items fall into size classes (n up to u, u a power of two). A document that holds
    enough of an item lacks at most ``u * (1 - least)`` of its shingles; one value more
    than that cannot all be lacking, so no match escapes.
    """
    upper = 1 << max(n - 1, 0).bit_length()
    return min(n, int(upper * (1 - least) + 1e-9) + 1)


def signatures(items: DataFrame, width: int, least: float) -> DataFrame:
    """(iid, gram, n, need, hashes): the signature of each different item text.

    ``hashes`` are the smallest of the item's shingle hashes (bottom-k MinHash) and
    ``need`` the number of them that a document with enough of the item has at least.
    An item of fewer than ``width`` words is one shingle; one without words is skipped.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for iid, text in zip(batch.column("iid").to_pylist(), texts_of(batch)):
                words = words_of(text)
                if not words:
                    continue
                gram = min(width, len(words))
                hashes = np.unique(shingle_hashes(words, gram))
                n = len(hashes)
                k = signature_length(n, least)
                need = max(1, k - (n - required(n, least)))
                rows.append((iid, gram, n, need, hashes[:k].view(np.int64).tolist()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("iid", "gram", "n", "need", "hashes"), r)) for r in rows], schema=arrow
            )

    arrow = pa.schema([("iid", pa.int64()), ("gram", pa.int32()), ("n", pa.int32()), ("need", pa.int32()),
                       ("hashes", pa.list_(pa.int64()))])
    return items.mapInArrow(work, "iid long, gram int, n int, need int, hashes array<long>")


def _filter_words(entries: DataFrame) -> np.ndarray:
    """A Bloom filter over (hash), as 64-bit words; its size has a fixed bound."""
    count = entries.count()
    bits = min(MAX_FILTER_BITS, 1 << max(10, (BITS_PER_ENTRY * count - 1).bit_length()))
    mask = F.lit(bits - 1).cast("long")
    first, step = F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseOR(F.lit(1).cast("long"))
    bit = F.explode(F.array(*[(first + k * step).bitwiseAND(mask) for k in range(PROBES)]))
    words = np.zeros(bits // 64, np.uint64)
    filled = (
        entries.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits"))
    ).toPandas()
    words[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def _passing(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hashes that the filter may hold, each once."""
    mask = np.uint64(len(words) * 64 - 1)
    for k in range(PROBES):
        at = ((hashes & mask) + np.uint64(k) * (hashes >> np.uint64(32) | np.uint64(1))) & mask
        hashes = hashes[(words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return np.unique(hashes)


def _suspects(docs: DataFrame, grams: list[int], words) -> DataFrame:
    """Documents with a shingle that passes the filter, and the hashes that do."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep, hits = [], []
            for i, text in enumerate(texts_of(batch)):
                own = words_of(text)
                passed = np.concatenate([_passing(words.value, shingle_hashes(own, g)) for g in grams]).view(np.int64)
                if len(passed):
                    keep.append(i)
                    hits.append(passed)
            if keep:
                kept = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(hits, pa.list_(pa.int64()))], [*kept.schema.names, "hits"]
                )

    schema = T.StructType([*docs.schema.fields, T.StructField("hits", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(work, schema)


def _verified(pairs: DataFrame, width: int, least: float) -> DataFrame:
    """Keep the items of each document whose shingles it really holds, compared as text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32):
            row, iids, sizes, matched = [], [], [], []
            for i, (text, items) in enumerate(zip(texts_of(batch), batch.column("items").to_pylist())):
                own, held = words_of(text), {}
                for item in items:
                    theirs = words_of(item["text"])
                    gram = min(width, len(theirs))
                    if gram not in held:
                        held[gram] = set(shingles(own, gram))
                    wanted = set(shingles(theirs, gram))
                    both = len(wanted & held[gram])
                    if both >= required(len(wanted), least):
                        row.append(i)
                        iids.append(item["iid"])
                        sizes.append(len(wanted))
                        matched.append(both)
            kept = batch.select(["doc_id", "rid"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(iids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(matched, pa.int32())],
                ["doc_id", "rid", "iid", "n_shingles", "n_matched"],
            )

    schema = T.StructType([
        pairs.schema["doc_id"], T.StructField("rid", T.LongType()), T.StructField("iid", T.LongType()),
        T.StructField("n_shingles", T.IntegerType()), T.StructField("n_matched", T.IntegerType()),
    ])
    return pairs.mapInArrow(work, schema)


def find_items(docs: DataFrame, items: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, rid, item_id, n_shingles, n_matched): items that documents contain.

    A document contains an item if it holds at least ``least`` of the item's different
    shingles of ``width`` words (letters and digits in lower case; an item with fewer
    words is one shingle of all its words, one without words is never found). ``rid``
    is a hash of the document's text; rows equal in doc_id and text are reported once.

    Each different item text keeps a bottom-k MinHash signature whose length depends on
    its size class. Documents are read once against a filter of bounded size over all
    signatures; what passes is joined with the signatures, and whatever shares enough
    of one is compared shingle by shingle. Null texts count as empty, null keys are
    carried along, other columns are ignored, empty tables give an empty result.
    """
    own = items.select("item_id", "text", F.xxhash64("text").alias("iid")).where("text is not null")
    texts = own.groupBy("iid").agg(F.min("text").alias("text"))
    signed = stored(signatures(texts, width, least), "signatures")
    entries = signed.select("iid", "need", F.explode("hashes").alias("hash"))
    grams = [r.gram for r in signed.select("gram").distinct().collect()]  # at most ``width``
    narrow = docs.select("doc_id", F.xxhash64("text").alias("rid"), "text")
    if grams:
        words = docs.sparkSession.sparkContext.broadcast(_filter_words(entries))
        suspects = stored(_suspects(narrow, sorted(grams), words), "suspects")
    else:
        suspects = narrow.withColumn("hits", F.array().cast("array<long>")).limit(0)
    candidates = (
        suspects.select("doc_id", "rid", F.explode("hits").alias("hash")).distinct()
        .join(entries, "hash")
        .groupBy("doc_id", "rid", "iid").agg(F.count(F.lit(1)).alias("shared"), F.first("need").alias("need"))
        .where("shared >= need").select("doc_id", "rid", "iid")
    )
    pairs = candidates.join(texts, "iid").groupBy(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid")).agg(
        F.collect_list(F.struct("iid", "text")).alias("items")
    )
    pairs = suspects.select("doc_id", "rid", "text").dropDuplicates(["doc_id", "rid"]).join(
        pairs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rid") == F.col("_rid"))
    ).select("doc_id", "rid", "text", "items")
    found = stored(_verified(pairs, width, least), "contained")
    return found.join(own.select("item_id", "iid").distinct(), "iid").select(
        "doc_id", "rid", "item_id", "n_shingles", "n_matched"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    its_id, its_rid = free_names(docs.columns, "its_id", "its_rid")
    found = find_items(docs, items, **parameters).select(
        F.col("doc_id").alias(its_id), F.col("rid").alias(its_rid)
    ).distinct()
    return docs.join(
        found, F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.xxhash64("text") == F.col(its_rid)), "left_anti"
    )


ORACLE = r"""
WITH iw AS (
    SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark
), ig AS (
    SELECT item_id, ws, least(5, len(ws)) AS g FROM iw WHERE len(ws) > 0
), ish AS (
    SELECT DISTINCT item_id, g, array_to_string(ws[i:i + g - 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, len(ws) - g + 2)) AS i FROM ig)
), dw AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents
), dg AS (
    SELECT doc_id, ws, g FROM dw, (SELECT DISTINCT g FROM ig) WHERE len(ws) >= g
), dsh AS (
    SELECT DISTINCT doc_id, g, array_to_string(ws[i:i + g - 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, len(ws) - g + 2)) AS i FROM dg)
), sizes AS (
    SELECT item_id, count(*) AS n FROM ish GROUP BY item_id
)
SELECT d.doc_id, i.item_id, any_value(z.n)::INT AS n_shingles, count(*)::INT AS n_matched,
    count(*) / any_value(z.n) AS containment
FROM ish i JOIN dsh d USING (g, s) JOIN sizes z USING (item_id)
GROUP BY d.doc_id, i.item_id HAVING count(*) >= ceil(0.8 * any_value(z.n) - 1e-9)
"""
