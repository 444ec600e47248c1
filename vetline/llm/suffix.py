"""Repeated byte strings: suffixes of candidate segments, sorted shard by shard.

1. Every window of ``width`` bytes selects the least hashed piece in it, its anchor. Equal
   windows select equal anchors at equal offsets, so windows with different anchors never
   need to meet. The windows of one place's anchor, one after another, form a segment.
2. Segments meet by anchor. Of equal segments only the first one's windows can be first;
   all windows of the others are repeats. Anchors with one segment left are done.
3. The remaining segments are cut out of the texts and dealt to shards by anchor. Windows
   whose first and last pieces no other one of the shard has are left out. The suffixes of
   the rest are ordered by external induced sorting (see ``induced``); windows that share
   their whole width stand next to each other, and all but the first are repeats.
"""

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.llm.common import slices, stored
from vetline.llm.induced import suffix_order

#: Bytes of a piece, as a power of two, and bits of a place within a block of texts.
GRAM_LOG2, PLACE_BITS = 4, 24
#: Bytes of texts hashed together, segments held back to find equal ones among them.
BLOCK, HELD = 1 << 19, 1 << 18
#: Segments of one anchor beyond which its windows are compared singly, by hash; bytes of a shard.
CROWDED, SHARD_BYTES = 1 << 13, 1 << 19
#: A segment's place: its first window, then its number of windows, as one long.
LENGTH_BITS = 31
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Powers:
    """Powers of each base and of its inverse modulo 2^64, for one block."""

    made: list[tuple[np.ndarray, np.ndarray]] = []

    @classmethod
    def get(cls, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not cls.made or len(cls.made[0][0]) < n:
            cls.made = []
            for base in BASES:
                pair = []
                for b in (base, pow(base, -1, 1 << 64)):
                    steps = np.full(max(n, BLOCK + 1), b, np.uint64)
                    steps[0] = 1
                    pair.append(np.cumprod(steps))
                cls.made.append(tuple(pair))
        return cls.made


def _sums(data: np.ndarray) -> list[np.ndarray]:
    """Per base, sums over all prefixes, from which any stretch's hash follows."""
    wide = data.astype(np.uint64) + np.uint64(1)
    return [
        np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide * up[: len(wide)]))) for up, _ in _Powers.get(len(data) + 1)
    ]


def _stretch(sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    powers = _Powers.get(len(sums[0]))
    return [(s[end] - s[start]) * down[start] for s, (_, down) in zip(sums, powers)]


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces that begin at each byte."""
    h = data.astype(np.uint64) + np.uint64(1)
    for k in range(GRAM_LOG2):
        h = h[: -(1 << k)] * FACTORS[k] + h[1 << k :]
    return _mixed(h)


def segments(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, hash) of each segment of a block.

    ``data`` holds texts one after another, ``ends`` where each ends. The last hash covers
    a segment's bytes, its length and the offset of its anchor; with the anchor's own hash
    that makes 128 bits.
    """
    n, gram = len(data), 1 << GRAM_LOG2
    none = np.empty(0, np.int64)
    if n < width:
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    h = _grams(data)
    low = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    pieces, span = width - gram + 1, 1
    while 2 * span <= pieces:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if pieces > span:
        low = np.minimum(low[: len(low) - (pieces - span)], low[pieces - span :])
    anchor = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(n + 1, np.int8)
    long = ends - starts >= width
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - width + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: len(anchor)]) > 0)
    if not len(window):
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    own = anchor[window]
    new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    first, last = window[new], window[np.append(new[1:], len(window)) - 1]
    at = own[new]
    shape = ((at - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
    a, b = _stretch(_sums(data), first, last + width)
    return h[at], first, last, _mixed(a + _mixed(b ^ _mixed(shape)))


def joined(places: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where a new run begins in places sorted by document, each one more than the last."""
    return np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (places[1:] != places[:-1] + 1))))


_FIELDS = ("shard", "seg", "doc", "place")
_ROWS = "shard long, seg long, doc long, place long, done boolean"


def _place(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (s.astype(np.int64) << LENGTH_BITS) | (e - s + 1)


def _windows(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) window of a place."""
    s = place >> LENGTH_BITS
    return s, s + (place & ((1 << LENGTH_BITS) - 1)) - 1


def _segment_rows(docs: DataFrame, width: int) -> DataFrame:
    """Segments of all texts; ``done`` ones have an equal one before them nearby.

    Equal segments are looked for among a task's last HELD ones, so that copies are few
    before anything is shuffled.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
        """Texts of about BLOCK bytes in all, with id and place; long ones in overlapping parts."""
        texts, ids, at, size = [], [], [], 0
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                data = (text or "").encode()
                for begin in range(0, max(1, len(data) - width + 1), BLOCK):
                    part = data[begin : begin + BLOCK + width - 1]
                    texts.append(part)
                    ids.append(doc)
                    at.append(begin)
                    size += len(part)
                    if size >= BLOCK:
                        yield texts, ids, at
                        texts, ids, at, size = [], [], [], 0
        if texts:
            yield texts, ids, at

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, seg, doc, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, doc, seg, key))
        key, seg, doc, place = (c[order] for c in (key, seg, doc, place))
        copy = np.concatenate(([False], (key[1:] == key[:-1]) & (seg[1:] == seg[:-1])))
        back, open_ = np.flatnonzero(copy), np.flatnonzero(~copy)
        back = back[np.lexsort((place[back], doc[back]))]
        own, (s, e) = doc[back], _windows(place[back])
        run = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (s[1:] > e[:-1] + 1)))) if len(back) else back
        stop = np.append(run[1:], len(back))[: len(run)] - 1
        columns = [
            np.concatenate((key[open_].view(np.int64), own[run])),
            np.concatenate((seg[open_].view(np.int64), np.zeros(len(run), np.int64))),
            np.concatenate((doc[open_], own[run])), np.concatenate((place[open_], _place(s[run], e[stop]))),
            np.concatenate((np.zeros(len(open_), bool), np.ones(len(run), bool))),
        ]
        return pa.record_batch([pa.array(c) for c in columns], names=[*_FIELDS, "done"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for texts, ids, at in blocks(batches):
            ends = np.cumsum([len(t) for t in texts])
            key, first, last, seg = segments(np.frombuffer(b"".join(texts), np.uint8), ends, width)
            number = np.searchsorted(ends, first, "right")
            shift = np.array(at, np.int64) - np.concatenate(([0], ends[:-1]))
            held.append((key, seg, np.array(ids, np.int64)[number], _place(first + shift[number], last + shift[number])))
            count += len(key)
            if count >= HELD:
                yield sent(held)
                held, count = [], 0
        if count:
            yield sent(held)

    return docs.select("doc", "text").mapInArrow(work, _ROWS)


def _judged(rows: DataFrame) -> DataFrame:
    """(doc, place, key): repeated windows (key null), and first segments still to compare."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Carried over: the last first segment, whether it was given out, whether its anchor has others.
        carried, given, several = None, False, False
        for batch in batches:
            if not batch.num_rows:
                continue
            done, *cols = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("done", *_FIELDS))
            out = [(cols[2][done], cols[3][done], cols[0][done], np.ones(int(done.sum()), bool))]
            cols = [c[~done] for c in cols]
            if carried is not None:
                cols = [np.concatenate((a, b)) for a, b in zip(carried, cols)]
            key, seg, doc, place = cols
            if len(key):
                same_key = np.concatenate(([False], key[1:] == key[:-1]))
                same = same_key & np.concatenate(([False], seg[1:] == seg[:-1]))
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))  # first of the equal ones
                copy = same & ((doc != doc[lead]) | (place != place[lead]))
                group = np.cumsum(~same_key) - 1
                kinds = np.bincount(group, ~same)
                if several:
                    kinds[0] += 1
                open_ = ~same & (kinds[group] >= 2)
                several, tail = bool(kinds[-1] >= 2), int(lead[-1])
                if given:
                    open_[0] = False
                given = several
                carried = [c[tail : tail + 1].copy() for c in cols]
                for chosen, gone in ((copy, True), (open_, False)):
                    out.append((doc[chosen], place[chosen], key[chosen], np.full(int(chosen.sum()), gone)))
            doc, place, key, gone = (np.concatenate(c) for c in zip(*out))
            yield pa.record_batch([pa.array(doc), pa.array(place), pa.array(key, pa.int64(), mask=gone)], ["doc", "place", "key"])

    dealt = rows.repartition("shard").sortWithinPartitions(*_FIELDS)
    return dealt.mapInArrow(work, "doc long, place long, key long")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, packed): the UTF-8 bytes of each text, compressed before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            data = pa.array([pack((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, data], [*rest, "packed"])

    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField("packed", T.BinaryType())])
    return docs.select(*rest, "text").mapInArrow(work, schema)


def _open_segments(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """(doc, packed, wanted): each text that has opened segments, beside their keys and places."""
    wanted = opened.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("key", "place")).alias("wanted"))
    return _packed(docs.select("doc", "text")).join(wanted, F.col("doc") == F.col("_doc")).select("doc", "packed", "wanted")


def _crowded(opened: DataFrame) -> DataFrame:
    """(key): the anchors with more segments than a shard is to hold."""
    return opened.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("key")


def _cut(docs: DataFrame, opened: DataFrame, width: int) -> DataFrame:
    """(shard, doc, s, bytes): the segments still to compare, as bytes, without those of crowded anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 64):
            out = []
            for doc, packed, own in zip(*(batch.column(c).to_pylist() for c in ("doc", "packed", "wanted"))):
                data = unpack(packed)
                for w in own:
                    s, e = _windows(w["place"])
                    out.append((w["key"], doc, s, data[s : e + width]))
            if out:
                shard, doc, s, piece = zip(*out)
                yield pa.record_batch(
                    [pa.array(shard, pa.int64()), pa.array(doc, pa.int64()), pa.array(s, pa.int32()), pa.array(piece, pa.binary())],
                    ["shard", "doc", "s", "bytes"],
                )

    few = opened.join(_crowded(opened), "key", "left_anti")
    return _open_segments(docs, few).mapInArrow(work, "shard long, doc long, s int, bytes binary")


def _crowded_repeats(docs: DataFrame, opened: DataFrame, width: int) -> DataFrame:
    """(doc, place): the repeated windows of crowded anchors, singly.

    The first place of each different window, by a 128-bit hash, is found by an
    aggregation that combines before the shuffle; the later ones by a join with it, whose
    large keys can be split. No task holds all copies of a window.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 64):
            out = []
            for doc, packed, own in zip(*(batch.column(c).to_pylist() for c in ("doc", "packed", "wanted"))):
                data = unpack(packed)
                for w in own:
                    s, e = _windows(w["place"])
                    for at in range(s, e + 1):
                        digest = hashlib.blake2b(data[at : at + width], digest_size=16).digest()
                        out.append((int.from_bytes(digest[:8], "little", signed=True),
                                    int.from_bytes(digest[8:], "little", signed=True), doc, at))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["h1", "h2", "doc", "s"])

    many = opened.join(_crowded(opened), "key", "left_semi")
    rows = _open_segments(docs, many).mapInArrow(work, "h1 long, h2 long, doc long, s long")
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "s")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = rows.join(first.where("n > 1"), ["h1", "h2"]).where(F.struct("doc", "s") != F.col("first"))
    windows = later.select("doc", "s").distinct()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("s").to_numpy()
            yield pa.record_batch([batch.column("doc"), pa.array(_place(s, s))], ["doc", "place"])

    return windows.mapInArrow(placed, "doc long, place long")


def _possible(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(index, first byte within, bytes): the runs of windows whose ends another window has too.

    Equal windows begin and end with equal pieces, so windows alone with theirs cannot
    repeat and need not be sorted.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    count = sizes - width + 1
    index = np.repeat(np.arange(len(pieces)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = begins[index] + offset
    h = _grams(np.frombuffer(b"".join(pieces), np.uint8))
    both = h[at] * FACTORS[0] + h[at + width - (1 << GRAM_LOG2)]
    order = np.argsort(both)
    alike = both[order][1:] == both[order][:-1]
    kept = np.zeros(len(both), bool)
    kept[order] = np.concatenate(([False], alike)) | np.concatenate((alike, [False]))
    index, offset = index[kept], offset[kept]
    if not len(index):
        return index, offset, []
    run = joined(offset, index)
    stop = np.append(run[1:], len(index)) - 1
    cut = [pieces[i][a : b + width] for i, a, b in zip(index[run].tolist(), offset[run].tolist(), offset[stop].tolist())]
    return index[run], offset[run], cut


def repeated_windows(doc: np.ndarray, start: np.ndarray, pieces: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(doc, first, last): runs of windows that an earlier place of the shard holds too."""
    index, offset, pieces = _possible(pieces, width)
    if not pieces:
        return (np.empty(0, np.int64),) * 3
    doc, start = doc[index], start[index] + offset
    sizes = np.array([len(p) for p in pieces], np.int64)
    count, total = len(pieces), int(sizes.sum()) + len(pieces)
    # Byte b becomes b + count; segment i ends in the symbol count - 1 - i, which occurs once.
    text = np.empty(total, np.int32)
    stops = np.cumsum(sizes + 1) - 1
    body = np.ones(total, bool)
    body[stops] = False
    text[body] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32) + count
    text[stops] = np.arange(count - 1, -1, -1)
    order, shared = suffix_order(text, width)
    number = np.searchsorted(stops, order)
    offset = order - (stops[number] - sizes[number])
    group = np.cumsum(shared < width)
    window = offset <= sizes[number] - width
    group, number, offset = group[window], number[window], offset[window]
    place, own = start[number] + offset, doc[number]
    rank = np.lexsort((place, own, group))
    group, place, own = group[rank], place[rank], own[rank]
    lead = np.maximum.accumulate(
        np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(len(group)), 0)
    ) if len(group) else group
    later = (own != own[lead]) | (place != place[lead])
    place, own = place[later], own[later]
    rank = np.lexsort((place, own))
    place, own = place[rank], own[rank]
    again = np.concatenate(([True], (own[1:] != own[:-1]) | (place[1:] != place[:-1]))) if len(own) else np.empty(0, bool)
    place, own = place[again], own[again]
    if not len(own):
        return own, place, place
    run = joined(place, own)
    return own[run], place[run], place[np.append(run[1:], len(place)) - 1]


def _sorted_shards(cut: DataFrame, width: int) -> DataFrame:
    """(doc, place): repeated windows found by sorting the suffixes of each shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            doc, s, e = repeated_windows(
                table.column("doc").to_numpy(), table.column("s").to_numpy().astype(np.int64),
                table.column("bytes").to_pylist(), width,
            )
            return pa.record_batch([pa.array(doc), pa.array(_place(s, e))], ["doc", "place"])

        size = 0
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            # A shard takes whole anchors until it is large enough.
            edges = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
            for at, end in pairwise(edges.tolist()):
                if held and size >= SHARD_BYTES and held[-1].column("shard")[-1].as_py() != shard[at]:
                    yield result(held)
                    held, size = [], 0
                part = batch.slice(at, end - at)
                held.append(part)
                size += sum(len(b) for b in part.column("bytes").to_pylist())
        if held:
            yield result(held)

    return cut.repartition("shard").sortWithinPartitions("shard").mapInArrow(work, "doc long, place long")


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): ``doc`` is a number of the row's own, in the order of doc_id.

    doc_id itself, unless rows share one or several have none. Then rows are dealt into
    ranges and numbered in them, by doc_id, by a hash of the text, and by place in the table.
    """
    docs = docs.select("doc_id", "text")
    alone = docs.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if alone:
        return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))))
    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("place")]
    placed = docs.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.select("doc_id", "text", F.monotonically_increasing_id().alias("doc")), "numbered")


def remove_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Removes each byte (UTF-8; a null text is empty) covered by a string of ``width`` bytes
    that also starts earlier, in a smaller doc_id or earlier in the same document. Strings
    lie within documents, overlaps count, and all are judged on the input. ``n_spans``
    counts the maximal runs removed; ``kept`` is the rest, as bytes.

    doc_id is an integer key. Every row is a document of its own: rows without one come
    before all others, and rows that share one follow each other by the xxhash64 of their
    texts, so of equal rows one counts as the first. Texts shorter
    than ``width`` stay whole. Other columns are ignored; an empty table gives an empty
    result.
    """
    keyed = _ordered(docs)
    judged = stored(_judged(_segment_rows(keyed, width)), "segments")
    opened = judged.where("key is not null")
    found = judged.where("key is null").select("doc", "place").unionByName(
        _sorted_shards(_cut(keyed, opened, width), width)
    ).unionByName(_crowded_repeats(keyed, opened, width))
    windows = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("place").alias("windows"))
    rows = _packed(keyed).join(windows, F.col("doc") == F.col("_doc"), "left").select("doc_id", "packed", "windows")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches):
            out = []
            lists = batch.column("windows")
            for i, packed in enumerate(batch.column("packed").to_pylist()):
                data = unpack(packed)
                own = lists[i].values
                if own is None or not len(own):
                    out.append((data, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                s, e = _windows(own.to_numpy())
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, s, 1)
                np.add.at(change, np.minimum(e + width, len(data)), -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((kept, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch(
                [batch.column("doc_id"), *columns],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.mapInArrow(work, T.StructType([
        docs.schema["doc_id"], T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]))
