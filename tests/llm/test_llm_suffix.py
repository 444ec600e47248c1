import hashlib
import random

import numpy as np
import pytest
import xxhash
from awkward_rows import ROWS, clashing, long_text, rows_of
from vetline.llm import induced, suffix

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, width=100):
    """Every row is its own document, in the order of doc_id and of the texts' hashes."""
    def place(row):
        text = None if row[1] is None else xxhash.xxh64_intdigest(row[1].encode(), 42)
        return row[0] is not None, row[0] or 0, 42 if text is None else text - (text >> 63 << 64)

    seen, out = set(), []
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=place):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            piece = data[i : i + width]
            if piece in seen:
                gone[i : i + width] = True
            seen.add(piece)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, width=100):
    return rows_of(suffix.remove_repeats(df, width).select(*COLUMNS))


def order_by_hand(text, limit):
    order = sorted(range(len(text)), key=lambda i: list(text[i:]))
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < limit and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("memory", [1 << 20, 150])
def test_suffix_order(memory):
    """Order and common prefixes, in memory and with queues that spill all the time."""
    rng = np.random.default_rng(0)
    for it in range(400):
        n = int(rng.integers(0, 60))
        own = rng.integers(1, [2, 3, 5, 20][it % 4] + 1, n)
        if it % 3 == 0 and n:
            own = np.tile(own[: max(1, n // 5)], 5)
        text, limit = np.append(own, 0), int(rng.integers(1, 20))
        order, shared = induced.suffix_order(text, limit, memory)
        assert (order.tolist(), shared.tolist()) == order_by_hand(text.tolist(), limit)


def test_queue_spills_and_keeps_order():
    key = np.repeat(np.arange(50), 100)
    queue = induced.MonotoneQueue(key, np.bincount(key), 600)
    rng = np.random.default_rng(1)
    places = rng.permutation(len(key))
    for part in np.array_split(places, 40):
        queue.push(part, part.astype(np.int32))
    out = []
    while len(queue.front()[0]):
        keys, own, common = queue.front()
        assert np.array_equal(own, common)
        out.extend(own.tolist())
        queue.drop(len(keys))
    want = sorted(range(len(places)), key=lambda i: key[places[i]])
    assert queue.spilled and out == places[want].tolist()


def documents(seed, n):
    rng = random.Random(seed)
    base = [long_text(rng.randint(1, 50), rng.randint(5, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(base) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), f"own {i} " + long_text(100 + i, 8))
        if rng.random() < 0.2:
            parts.append("ab " * 150)
        text = " ".join(parts)
        rows.append((i, text[rng.randint(0, 30) :], "en", "s", 1))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_all_strings(frame, monkeypatch, small):
    if small:  # many blocks, crowded anchors, tiny shards
        monkeypatch.setattr(suffix, "BLOCK", 512)
        monkeypatch.setattr(suffix, "HELD", 50)
        monkeypatch.setattr(suffix, "CROWDED", 2)
        monkeypatch.setattr(suffix, "SHARD_BYTES", 300)
        suffix._Powers.made = []
    rows = documents(3, 60)
    assert found(frame(rows).repartition(4)) == brute(rows)
    if small:
        suffix._Powers.made = []


def test_width(frame):
    rows = [(1, "0123456789" * 12, "en", "s", 1), (2, "abc" + "0123456789" * 3, "en", "s", 1), (3, "x" * 45, "en", "s", 1)]
    for width in (20, 40):
        assert found(frame(rows), width) == brute(rows, width)


def test_many_copies_and_one_passage_everywhere(frame):
    passage = long_text(7, 45)
    rows = [(i, long_text(3, 60), "en", "s", 1) for i in range(150)]
    rows += [(1000 + i, f"{long_text(20 + i, 25)} {passage} {long_text(400 + i, 25)}", "en", "s", 1) for i in range(150)]
    assert found(frame(rows).repartition(5)) == brute(rows)


def test_odd_rows(odd, none):
    assert found(odd) == brute(ROWS)
    assert found(clashing(odd)) == brute(ROWS)
    assert found(none) == []


def test_rows_that_share_an_id(frame):
    """Different texts, copies and short ones under one id, and several rows without any."""
    letters = "".join(f"{i:03d}" for i in range(283))
    rows = [(1, letters, "en", "s", 1), (1, "short", "en", "s", 1), (2, letters[300:450] + "x" * 40, "en", "s", 1)]
    assert found(frame(rows)) == brute(rows)
    rows += [(1, letters, "en", "t", 1), (1, long_text(5, 90), "en", "s", 1), (2, long_text(5, 70), "en", "s", 1)]
    rows += [(None, long_text(5, 60), "en", "s", 1), (None, letters[:200], "en", "s", 1), (None, None, "en", "s", 1)] * 2
    assert found(frame(rows).repartition(3)) == brute(rows)


def test_windows_of_copies_go_in_one_row(frame):
    """Equal texts near each other leave a task as one interval, not one per segment."""
    rows = [(i, long_text(3, 400), "en", "s", 1) for i in range(20)]
    out = suffix._segment_rows(frame(rows).withColumnRenamed("doc_id", "doc").coalesce(1), 100)
    assert out.where("done").count() == 19
