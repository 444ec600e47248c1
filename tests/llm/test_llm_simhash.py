import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from vetline.llm import graph, simhash

from awkward_rows import ROWS, clashing, long_text, rows_of


def brute_print(text, words=4):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not tokens:
        return 0
    width = min(words, len(tokens))
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + width]), 42) for i in range(len(tokens) - width + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs, distance):
    """doc -> smallest doc over links of at most ``distance`` bits."""
    least = {d: d for d, _ in pairs}
    changed = True
    while changed:
        changed = False
        for a, x in pairs:
            for b, y in pairs:
                if bin(x ^ y).count("1") <= distance and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


@pytest.mark.parametrize("text", [r[1] for r in ROWS] + ["A b\x1cc d E f", "É É é"])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == brute_print(text)


def test_spark_hash_is_the_same(spark):
    row = spark.createDataFrame([("über 4 words here",)], "t string").select(F.xxhash64("t")).first()
    assert row[0] % (1 << 64) == xxhash.xxh64_intdigest("über 4 words here", 42)


def test_masks_cover():
    rng = random.Random(1)
    for blocks, distance in ((7, 4), (9, 6), (5, 4)):
        masks = simhash.block_masks(blocks, distance)
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), distance):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("chunk", [2048, 8])
def test_components_of_crowded_prints(spark, frame, monkeypatch, chunk):
    """Chains and crowds of close prints, compared with all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng, prints = random.Random(5), []
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(40):
            prints.append(p)
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << bit
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    table = frame(signed, "doc_id long, fp long")
    links = simhash.fingerprint_links(table)
    roots = {r.node: r.root for r in graph.components(links).collect()}
    want = brute_components(list(enumerate(prints)), 4)
    groups = {}
    for i, s in signed:
        groups.setdefault(roots.get(s, s), []).append(i)
    assert sorted(map(sorted, groups.values())) == sorted(
        sorted(i for i in want if want[i] == r) for r in set(want.values())
    )


def test_links_are_fewer_than_members():
    block = np.zeros(500, np.int64)
    fp = np.arange(500, dtype=np.uint64) & np.uint64(15) | np.arange(500, dtype=np.uint64) << np.uint64(32)
    a, b = simhash._spanning(block, np.sort(fp), 64)
    assert len(a) == 499


def test_components_hub_and_chain(spark, frame):
    links = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    found = {r.node: r.root for r in graph.components(frame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(200)}, **{i: 1000 for i in range(1000, 1101)}}
    assert graph.components(frame([], "a long, b long")).count() == 0


def test_near_duplicates(odd, none):
    found = rows_of(simhash.near_duplicates(odd))
    named = [(d, simhash.fingerprint(t or "")) for d, t, *_ in ROWS if d is not None]
    least = brute_components(named, 4)
    want = sorted(
        ((d, int(np.uint64(brute_print(t)).view(np.int64)), None if d is None else least[d]) for d, t, *_ in ROWS),
        key=repr,
    )
    assert found == want
    assert rows_of(simhash.near_duplicates(clashing(odd))) == want
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(odd, none, frame):
    docs = frame([(i, long_text(3, 400) if i < 4 else long_text(i, 60), "en", "a", i) for i in range(8)])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 4, 5, 6, 7]
    kept = simhash.keep_one(clashing(odd))
    assert kept.columns == clashing(odd).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 2 not in ids and 1 in ids
    assert simhash.keep_one(none).count() == 0


def test_memory_of_crowded_blocks():
    """The close pairs of several crowded blocks are not held together; their links connect the same."""
    rng = np.random.default_rng(3)
    near = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 1200).astype(np.uint64))
                     ^ (np.uint64(1) << rng.integers(0, 64, 1200).astype(np.uint64)))
    far = np.uint64(0xFFFF0000FFFF0000) ^ near[:300]
    fp = np.sort(np.concatenate((near, far)))
    block = np.repeat(np.arange(8), len(fp))
    tracemalloc.start()
    try:
        a, b = simhash._spanning(block, np.tile(fp, 8), 4)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40_000_000
    assert len(a) == 8 * (len(fp) - 2)
    side = np.isin(a, near), np.isin(b, near)
    assert (side[0] == side[1]).all()
