import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from awkward_rows import clashing, rows_of
from pyspark.sql import functions as F
from vetline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs=10, ranks=10):
    """The whole audit from (text, lang, source), straight from its definition."""
    groups, docs, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall(text.translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = sorted(s for a, s in groups if a == lang)
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in own}, shares(whole)
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in kept
                     if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(found)]
    return sorted(out, key=repr)


def corpus(n, seed, sources=7):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("lpha", "ÉTÉ", "漢", "Zz")] + ["x1y", "it's", "a-b", "\x00nul", "😀"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", None])
        source = None if rng.random() < 0.05 else f"s{min(rng.randrange(sources * 2), sources)}"
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), lang, source))
    return rows + [(None, None, None, None), (1, "", "xx", "lone"), (1, "", "xx", "other"), (2, "rare words", "yy", "lone")]


def of(rows):
    return [(t, lang, s) for _, t, lang, s in rows]


def test_against_the_definition(spark):
    rows = corpus(400, 1)
    assert rows_of(divergence.audit(spark.createDataFrame(rows, DOCS))) == brute(of(rows))


def test_small_blocks_many_passes(spark):
    """Runs of a few texts, several shards, merges in several passes, texts longer than a block."""
    rows = corpus(300, 2)
    docs = spark.createDataFrame(rows, DOCS).na.fill("")
    small = divergence.frequencies(docs, 10, block=60, shard_chars=2_000, fan=4)
    large = divergence.frequencies(docs, 10)

    def plain(df):
        return sorted((r.lang, r.term, sorted(map(tuple, r.postings))) for r in df.collect())

    runs = divergence.block_runs(docs.repartition(8), 3, 60)
    assert runs.groupBy("shard").count().agg(F.max("count")).first()[0] > 4
    assert plain(small) == plain(large) != []


def test_runs_are_sorted(spark):
    rows = spark.createDataFrame(corpus(200, 3), DOCS).na.fill("")
    for run in divergence.block_runs(rows, 2, 100).collect():
        found = divergence.Postings.unpacked(run.postings)
        keys = found.keys.to_pylist()
        assert keys == sorted(set(keys)) and found.sizes.sum() == len(found.owners) == len(found.counts)
        assert found.owners.max(initial=0) < len(run.sources) and found.sizes.min(initial=1) > 0


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_merge_in_stretches(stretch):
    """Any cut gives the same sums, in order."""
    rng = np.random.default_rng(9)
    runs, want = [], Counter()
    for _ in range(7):
        texts = [" ".join(f"t{chr(97 + i)}" for i in rng.integers(0, 26, rng.integers(0, 12))) for _ in range(9)]
        owners = rng.integers(0, 4, 9)
        runs.append(divergence.index(pa.array(["l"] * 9), owners, pa.array(texts), 4))
        for text, owner in zip(texts, owners.tolist()):
            want.update((t.encode() + b"\0l", owner) for t in text.split())
    runs.append(divergence.index(pa.array([], pa.string()), np.empty(0, np.int64), pa.array([], pa.string()), 4))
    got, last = {}, b""
    for part in divergence.merge(runs, 4, stretch):
        at = 0
        for key, size in zip(part.keys.to_pylist(), part.sizes.tolist()):
            assert key > last
            last = key
            got |= {(key, o): n for o, n in zip(part.owners[at : at + size].tolist(), part.counts[at : at + size].tolist())}
            at += size
    assert got == want


def test_terms_of_a_slice():
    texts = pa.array(["first", "The cat's HAT\x00-É2é", "", "  x  ", "漢字 Ab", "last"])
    want = [[t for t in TERM.findall(x.translate(LOWER))] for x in texts.to_pylist()]
    for part, expected in ((texts, want), (texts[1:5], want[1:5]), (texts[2:2], [])):
        assert [[t for t in x if t] for x in divergence.terms_of(part).to_pylist()] == expected


@pytest.mark.parametrize("sources,postings", [(2, 30), (3, 1000), (512, 10)])
def test_blocks_of_sources_and_parts_of_terms(spark, monkeypatch, sources, postings):
    rows = corpus(250, 4, sources=11)
    whole = divergence.pair_divergences
    monkeypatch.setattr(divergence, "pair_divergences", lambda g, s: whole(g, s, sources, postings))
    assert rows_of(divergence.audit(spark.createDataFrame(rows, DOCS))) == brute(of(rows))


def test_awkward_rows(odd, none):
    want = brute([(r.text, r.lang, r.source) for r in odd.collect()], 2)
    assert rows_of(divergence.audit(odd, min_docs=2)) == want and want
    assert rows_of(divergence.audit(clashing(odd).withColumn("term", F.lit("x")).withColumn("n", F.lit(1)), min_docs=2)) == want
    assert divergence.audit(none).count() == 0


def test_large_counts(spark):
    """Shares of counts whose product with 10^9 is beyond a long."""
    df = spark.sql("SELECT 20000000000L AS n, 30000000000L AS total, 5L AS kept")
    got = df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).first()[0]
    assert got == 1 + 10**9 * (2 * 10**10 + 2) // (3 * 10**10 + 10)


class Captured:
    """Stands for a DataFrame: keeps the function that would run in a task."""

    def select(self, *_):
        return self

    def mapInArrow(self, work, _):
        return work


def peak_of(work) -> int:
    """Bytes that numpy and Python hold at most while ``work`` runs."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_block():
    """The words of a block are not all spread out at once."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)])
    texts = [" ".join(words[rng.integers(0, 600, 700)]) for _ in range(2000)]
    batch = pa.record_batch([pa.array(["l"] * 2000), pa.array(["s", "t"] * 1000), pa.array(texts)], ["lang", "source", "text"])
    found = []
    work = divergence.block_runs(Captured(), 2)
    assert peak_of(lambda: found.extend(work(iter([batch])))) < 30_000_000
    want = Counter(w for t in texts for w in t.split())
    got = [divergence.Postings.unpacked(b.column("postings")[0].as_py()) for b in found]
    assert sum(len(p.keys) for p in got) == len(want) and sum(int(p.counts.sum()) for p in got) == sum(want.values())
    assert all(p.docs.max() <= 2000 for p in got)


def test_memory_of_a_merge():
    """Stretches of many runs together stay as small as that of a few."""
    names = np.array(sorted({f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij" for d in "abcdefghij"}))
    keys = pa.array([n.encode() + b"\0l" for n in names], pa.large_binary())
    ones = np.ones(len(names), np.int64)
    runs = [divergence.Postings(keys, ones, ones, ones * (i % 3), ones) for i in range(100)]
    total = []

    def work():
        total.extend((len(p.keys), int(p.docs.sum()), int(p.counts.sum())) for p in divergence.merge(runs, 3))

    assert peak_of(work) < 40_000_000
    assert [sum(t) for t in zip(*total)] == [len(names), 100 * len(names), 100 * len(names)]
