"""How far the sources of each language differ in their words.

Term frequencies come from single-pass in-memory indexing: a task gathers postings (term ->
sources and counts) until a block is full, sends it on as a term-sorted run cut by hash
shard, and the runs of a shard are merged with a heap. Divergences of pairs start from what
two sources without any term would have; the terms then pass by and correct it.
"""

import heapq
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetline.llm.common import pieces_of, release, stored

#: Bytes of the texts that a block holds before it becomes a run, and of those that are indexed at once.
BLOCK, PORTION = 12_000_000, 2_000_000
#: Characters of the input for each hash shard, about, and shards at most.
SHARD_CHARS, SHARDS = 64_000_000, 4096
#: Runs of a shard that one merge takes, more in several passes; terms of all its runs that it looks at together.
FAN, STRETCH = 256, 1 << 17
#: Sources of a block of the pair table, and postings that one of its tasks meets, about.
SOURCES, POSTINGS = 512, 500_000

MIN_DOCS, SCALE, TERM_RANKS = 10, 1_000_000_000, 10

#: Bytes of a text: A-Z in lower case, what is no part of a term as a blank.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)

RUN = "shard int, run string, sources array<struct<lang:string,source:string>>, postings binary"
_GROUP = pa.struct([("lang", pa.string()), ("source", pa.string())])
Source = tuple[str, str]


class Postings(NamedTuple):
    """Terms in order with their postings.

    A key is a term, a zero byte (which no term has) and the language. ``sizes`` tells how
    many of ``owners`` (numbers of sources) and ``counts`` belong to each key.
    """

    keys: pa.Array
    docs: np.ndarray
    sizes: np.ndarray
    owners: np.ndarray
    counts: np.ndarray

    def chosen(self, which: np.ndarray) -> "Postings":
        """The keys that ``which`` marks."""
        own = np.repeat(which, self.sizes)
        return Postings(self.keys.filter(pa.array(which)), self.docs[which], self.sizes[which], self.owners[own], self.counts[own])

    def packed(self) -> bytes:
        ends = pa.array(np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int32))
        batch = pa.record_batch([
            self.keys, pa.array(self.docs), pa.ListArray.from_arrays(ends, pa.array(self.owners.astype(np.int32))),
            pa.ListArray.from_arrays(ends, pa.array(self.counts)),
        ], ["key", "docs", "owners", "counts"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def unpacked(data: bytes) -> "Postings":
        batch = pa.ipc.open_stream(data).read_next_batch()
        owners = batch.column("owners")
        return Postings(
            batch.column("key"), batch.column("docs").to_numpy(), np.diff(owners.offsets.to_numpy()).astype(np.int64),
            owners.flatten().to_numpy(), batch.column("counts").flatten().to_numpy(),
        )


def terms_of(texts: pa.Array) -> pa.Array:
    """The terms of each text, repeats included, between empty strings that are none."""
    held = texts.cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = held.buffers()[2]
    plain = (memoryview(data)[offsets[0] : offsets[-1]].tobytes() if data else b"").translate(_LETTERS)
    # What changes are single ASCII bytes, so the text stays what it was in length and in UTF-8.
    same = pa.Array.from_buffers(pa.large_string(), len(held), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain)])
    return pc.ascii_split_whitespace(same)


def _keyed(terms: pa.Array, langs: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(terms.cast(pa.large_binary()), langs.cast(pa.large_binary()), pa.scalar(b"\0", pa.large_binary()))


def index(langs: pa.Array, owners: np.ndarray, texts: pa.Array, n_sources: int) -> Postings:
    """The postings of some texts; ``owners`` has the number of each one's source."""
    split = terms_of(texts)
    coded = split.flatten().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    empty = pc.index(terms, pa.scalar("", terms.type)).as_py()
    if empty >= 0:
        code, doc = code[code != empty], doc[code != empty]
    lang = langs.dictionary_encode()
    of_doc, n_langs = lang.indices.to_numpy().astype(np.int64), max(1, len(lang.dictionary))
    # One pair for each term of a document; then one for each term and language.
    once = np.unique(code * len(texts) + doc)
    pair, docs = np.unique(once // max(1, len(texts)) * n_langs + of_doc[once % max(1, len(texts))], return_counts=True)
    keys = _keyed(terms.take(pa.array(pair // n_langs)), lang.dictionary.take(pa.array(pair % n_langs)))
    order = pc.sort_indices(keys).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of_owner = np.zeros(n_sources, np.int64)
    of_owner[owners] = of_doc
    posted, counts = np.unique(code * n_sources + owners[doc], return_counts=True)
    code, owner = posted // max(1, n_sources), posted % max(1, n_sources)
    at = place[np.searchsorted(pair, code * n_langs + of_owner[owner])]
    by_key = np.lexsort((owner, at))
    return Postings(keys.take(pa.array(order)), docs[order].astype(np.int64), np.bincount(at, minlength=len(order)),
                    owner[by_key], counts[by_key].astype(np.int64))


def merge(runs: list[Postings], n_sources: int, stretch: int = STRETCH) -> Iterator[Postings]:
    """Several runs as one, in stretches of keys.

    A heap holds each run's next keys, its part of some ``stretch``, by the last of them. The
    least of these ends the next stretch of the result: up to it, every run gives what it has.
    """
    at, stretch = [0] * len(runs), max(1, stretch // max(1, len(runs)))
    begins = [np.concatenate(([0], np.cumsum(r.sizes))) for r in runs]

    def last(i: int) -> tuple[bytes, int]:
        return runs[i].keys[min(at[i] + stretch, len(runs[i].keys)) - 1].as_py(), i

    heap = [last(i) for i, r in enumerate(runs) if len(r.keys)]
    heapq.heapify(heap)
    while heap:
        bound, parts = heap[0][0], []
        for _, i in heap:
            keys = runs[i].keys
            end = bisect_right(range(len(keys)), bound, at[i], min(at[i] + stretch, len(keys)), key=lambda j, k=keys: k[j].as_py())
            if end > at[i]:
                parts.append((i, at[i], end))
        for i, _, end in parts:
            at[i] = end
        heap = [last(i) for _, i in heap if at[i] < len(runs[i].keys)]
        heapq.heapify(heap)
        yield _summed([
            Postings(r.keys[a:b], r.docs[a:b], r.sizes[a:b], r.owners[e[a] : e[b]], r.counts[e[a] : e[b]])
            for r, e, a, b in ((runs[i], begins[i], a, b) for i, a, b in parts)
        ], n_sources)


def _summed(parts: list[Postings], n_sources: int) -> Postings:
    """Parts of equal keys added up, in order of the keys."""
    if len(parts) == 1:
        return parts[0]
    coded = pa.concat_arrays([p.keys for p in parts]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    at = place[coded.indices.to_numpy()]
    docs = np.zeros(len(order), np.int64)
    np.add.at(docs, at, np.concatenate([p.docs for p in parts]))
    pair = np.repeat(at, np.concatenate([p.sizes for p in parts])) * n_sources + np.concatenate([p.owners for p in parts])
    pair, where = np.unique(pair, return_inverse=True)
    counts = np.zeros(len(pair), np.int64)
    np.add.at(counts, where, np.concatenate([p.counts for p in parts]))
    return Postings(coded.dictionary.take(order), docs, np.bincount(pair // n_sources, minlength=len(order)), pair % n_sources, counts)


def _joined(parts: list[Postings]) -> Postings:
    """Stretches one after another."""
    return Postings(pa.concat_arrays([p.keys for p in parts]), *[np.concatenate(c) for c in list(zip(*parts))[1:]])


def _run(shard: int, sources: list[Source], postings: Postings) -> pa.RecordBatch:
    return pa.record_batch([
        pa.array([shard], pa.int32()), pa.array([uuid.uuid4().hex]),
        pa.array([[{"lang": a, "source": b} for a, b in sources]], pa.list_(_GROUP)), pa.array([postings.packed()], pa.binary()),
    ], ["shard", "run", "sources", "postings"])


def _parts(text: str, size: int) -> list[str]:
    """A long text cut at blanks into parts of some ``size`` characters."""
    parts, start = [], 0
    while start < len(text):
        end = text.find(" ", start + size)
        end = len(text) if end < 0 else end
        parts.append(text[start:end])
        start = end
    return parts


def block_postings(batch: pa.RecordBatch, portion: int = PORTION) -> tuple[list[Source], Postings]:
    """(sources, postings) of a block: only some ``portion`` bytes of its texts are spread out as words at a time."""
    number: dict[Source, int] = {}
    of_doc = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
    owners = np.array([number.setdefault(s, len(number)) for s in of_doc], np.int64)
    n, at, found = max(1, len(number)), 0, []
    for few in pieces_of([batch], portion):
        langs, texts, own = few.column("lang"), few.column("text"), owners[at : at + len(few)]
        at += len(few)
        if len(few) > 1 or len(text := texts[0].as_py()) <= portion:
            found.append(index(langs, own, texts, n))
            continue
        parts = [index(langs, own, pa.array([part], pa.string()), n) for part in _parts(text, portion)]
        whole = _whole(parts, n)
        found.append(whole._replace(docs=np.ones(len(whole.docs), np.int64)))
    return list(number), _whole(found, n)


def _whole(parts: list[Postings], n_sources: int) -> Postings:
    """Some postings as one."""
    return parts[0] if len(parts) == 1 else _joined(list(merge(parts, n_sources)) or parts[:1])


def block_runs(docs: DataFrame, shards: int, block: int = BLOCK) -> DataFrame:
    """One row per run and hash shard, from one pass over the texts; the terms of a run are in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(_together(batches, block), block):
            sources, postings = block_postings(batch, min(block, PORTION))
            shard = np.array([zlib.crc32(k[: k.index(b"\0")]) % shards for k in postings.keys.to_pylist()], np.int64)
            for at in np.unique(shard).tolist():
                yield _run(at, sources, postings.chosen(shard == at))
            del postings, shard

    return docs.select("lang", "source", "text").mapInArrow(work, RUN)


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Small batches joined until their texts have some ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column("text").nbytes
        if total >= size:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def _merged(rows: list[dict]) -> tuple[list[Source], Iterator[Postings]]:
    """(sources, stretches) of the runs in some rows."""
    number: dict[Source, int] = {}
    runs = []
    for row in rows:
        own = np.array([number.setdefault((s["lang"], s["source"]), len(number)) for s in row["sources"]], np.int32)
        run = Postings.unpacked(row.pop("postings"))
        runs.append(run._replace(owners=own[run.owners]))
    return list(number), merge(runs, max(1, len(number)))


def _by_key(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Rows of equal keys together; the batches are sorted by them."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, same in groupby(rows, key=itemgetter(*keys)):
        yield list(same)


def merge_pass(runs: DataFrame, parts: int) -> DataFrame:
    """Fewer runs: those of a shard that fall into the same of ``parts`` parts become one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "shard", "part"):
            sources, stretches = _merged(rows)
            yield _run(rows[0]["shard"], sources, _joined(list(stretches)))
            del stretches
            release()

    dealt = runs.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(parts)).cast("int"))
    return dealt.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(work, RUN)


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK,
                shard_chars: int = SHARD_CHARS, fan: int = FAN) -> DataFrame:
    """(lang, term, postings): terms in at least ``min_docs`` documents of a language.

    ``postings`` lists (source, n), the occurrences in each source that has any. ``docs`` has
    non-null lang, source and text.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(min(SHARDS, max(1, -(-chars // shard_chars))))
    runs = stored(block_runs(docs, shards, block), "runs")
    while (most := runs.groupBy("shard").count().agg(F.max("count")).first()[0] or 0) > fan:
        runs = stored(merge_pass(runs, int(-(-most // (fan // 2)))), "runs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "shard"):
            sources, stretches = _merged(rows)
            names = pa.array([s for _, s in sources], pa.string())
            for found in stretches:
                kept = found.chosen(found.docs >= min_docs)
                if not len(kept.keys):
                    continue
                both = [k.split(b"\0", 1) for k in kept.keys.to_pylist()]
                offsets = pa.array(np.concatenate(([0], np.cumsum(kept.sizes))).astype(np.int32))
                postings = pa.StructArray.from_arrays([names.take(pa.array(kept.owners)), pa.array(kept.counts)], ["source", "n"])
                yield pa.record_batch(
                    [*(pa.array([b[i] for b in both], pa.binary()).cast(pa.string()) for i in (1, 0)),
                     pa.ListArray.from_arrays(offsets, postings)],
                    ["lang", "term", "postings"],
                )
            del stretches
            release()

    schema = "lang string, term string, postings array<struct<source:string,n:long>>"
    merged = runs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(work, schema)
    return stored(merged, "frequencies")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exactly."""
    wide = [c.cast("decimal(20,0)") for c in (count + 2, total + 2 * kept)]
    return F.call_function("div", F.lit(SCALE).cast("decimal(11,0)") * wide[0], wide[1]) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exactly; p and q are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(key: tuple, groups: pa.Table, postings: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one block pair over one part of the terms."""
    lang, low, high, part = (k.as_py() for k in key)
    names = groups.column("source").combine_chunks()
    block = groups.column("block").to_numpy()
    zero = groups.column("zero").to_numpy()
    kept = int(groups.column("kept")[0].as_py())
    base = _gaps(zero[:, None], zero[None, :])
    one, both = np.zeros(base.shape, np.int64), np.zeros(base.shape, np.int64)
    postings = postings.sort_by("term")
    owner = pc.index_in(postings.column("source"), value_set=names).to_numpy().astype(np.int64)
    p = postings.column("p").to_numpy()
    terms = postings.column("term").combine_chunks().dictionary_encode() if len(owner) else None
    code = terms.indices.to_numpy() if terms is not None else np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else []
    for start, end in zip(first, np.append(first[1:], len(code)) if len(code) else []):
        own, mine = owner[start:end], p[start:end]
        here = zero.copy()
        here[own] = mine
        change = _gaps(mine[:, None], here[None, :]) - base[own]
        one[own] += change
        both[np.ix_(own, own)] += change[:, own]
    total = one + one.T - both
    if part == 0:
        total += kept * base
    wanted = (block[:, None] == low) & (block[None, :] == high)
    wanted = (wanted | wanted.T) & ~np.eye(len(names), dtype=bool)
    g, h = np.nonzero(wanted)
    return pa.table([pa.array([lang] * len(g), pa.string()), names.take(pa.array(g)), names.take(pa.array(h)),
                     pa.array(total[g, h])], ["lang", "source", "item", "value"])


def pair_divergences(groups: DataFrame, shares: DataFrame, sources: int = SOURCES, postings: int = POSTINGS) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language.

    ``groups`` has lang, source, zero (the share of a term that the source lacks) and kept
    (terms of the language); ``shares`` has lang, term, source and p for terms that occur.
    Sources fall into blocks of some ``sources``; a task takes two blocks and a part of the terms.
    """
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / sources).cast("int").alias("blocks"))
    amounts = shares.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / postings).cast("int").alias("parts"))
    sizes = sizes.join(amounts, "lang", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    keys = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(sizes, "lang").withColumn("block", block).withColumn("other", other).select("*", *keys)

    left = dealt(groups).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "lang", "low", "high", "part", "source", "block", "zero", "kept")
    right = dealt(shares).withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")).select(
        "lang", "low", "high", "part", "source", "term", "p")
    by = ["lang", "low", "high", "part"]
    sums = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _pair_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): which sources differ, and by which terms.

    Terms are runs of ASCII letters (A-Z in lower case) and characters beyond ASCII. A
    language keeps the V terms in at least ``min_docs`` of its documents. A source gives
    each kept term the share p = 1 + floor(10^9 (n + 2) / (N + 2V)), n its occurrences, N
    those of all kept terms; a language likewise. Two shares are floor((p - q)^2 / (p + q))
    apart. Part ``pair``: every other source of the language, with the sum over all kept
    terms. Part ``term``: the ``term_ranks`` terms that a source has and uses more than its
    language does, furthest apart first. Ranks count from 1; equal values by item.

    A null text, lang or source counts as ''. Every source that occurs takes part, also
    without a term; without kept terms all values are 0, and a lone source has no rows.
    Rows count as often as they occur; doc_id and other columns are ignored. Texts of any
    length are read whole. An empty table gives an empty result.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = frequencies(docs, min_docs)
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    posted = kept.select(
        "lang", "term", F.aggregate("postings", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_lang"),
        F.inline("postings"),
    )
    found = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(found, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = stored(groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")
    ).withColumn("zero", F.when(F.col("kept") == 0, F.lit(1)).otherwise(
        share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).cast("long")), "groups")
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    shares = posted.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    pairs = pair_divergences(groups, shares.select("lang", "term", "source", "p"))
    terms = shares.join(of_lang, "lang").withColumn(
        "q", share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))
    ).where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(first).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= term_ranks))


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS MATERIALIZED (
    SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS MATERIALIZED (
    SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10
), v AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), c AS MATERIALIZED (
    SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS MATERIALIZED (
    SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
    LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL) USING (lang, source)
), p AS MATERIALIZED (
    SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * v) AS p
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every_pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), q AS (
    SELECT lang, term, 1 + 1000000000 * (n + 2) // (total + 2 * v) AS q FROM kept JOIN v USING (lang)
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
    FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (FROM every_pair UNION ALL FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
