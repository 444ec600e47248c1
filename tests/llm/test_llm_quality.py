import zlib

import numpy as np
import pytest
from awkward_rows import ROWS, clashing, long_text, rows_of
from vetline.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def text_of(i, good):
    if good:
        return long_text(3 + i % 40, 40 + i % 30)
    return [" ".join(f"{w.upper()}!!" for w in long_text(3 + i, 30).split()), " ".join([f"w{i}"] * 40),
            " ".join(f"{w}###" for w in long_text(5 + i, 30).split())][i % 3]


def corpus(n):
    rows = [(i, text_of(i, i % 2), "en", "s", 1) for i in range(n)]
    return rows, [(i, i % 2, 0) for i in range(n)]


def test_log_count_ratio():
    rows = [np.array([1, 5], np.int32), np.array([5], np.int32), np.array([7], np.int32)]
    ratio = quality.log_count_ratio(rows, np.array([1, 1, 0]))
    n = quality.BUCKETS
    p = {1: 2, 5: 3}
    for b in (1, 5, 7, 9):
        want = np.log(p.get(b, 1) / (n + 3)) - np.log((2 if b == 7 else 1) / (n + 1))
        assert ratio[b] == pytest.approx(want)


def test_hinge_is_the_best_of_its_loss():
    """The dual steps end where moving the weights no longer lowers the primal loss."""
    rng = np.random.default_rng(2)
    ratio = rng.normal(size=quality.BUCKETS)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(60)]
    labels = (np.arange(60) % 2).astype(np.int64)
    weight, bias = quality.hinge(rows, labels, ratio, rounds=2000)

    def loss(w, b):
        total = 0.5 * (w @ w + b * b)
        for r, y in zip(rows, labels):
            x = ratio[r] / np.linalg.norm(ratio[r])
            total += max(0.0, 1 - (1 if y else -1) * (w[r] @ x + b))
        return total

    best = loss(weight, bias)
    for _ in range(200):
        step = np.zeros_like(weight)
        step[:12] = rng.normal(size=12) * 0.01
        assert loss(weight + step, bias + rng.normal() * 0.01) >= best - 1e-3


def test_indicators_in_pieces(monkeypatch):
    text = long_text(3, 900) + " same same SAME!! 12 a_b"
    whole = quality.indicators(text)
    assert len(whole) == len(set(whole.tolist())) and (np.diff(whole) > 0).all()
    monkeypatch.setattr(quality, "PIECE", 50)
    monkeypatch.setattr(quality, "REMEMBERED", 7)
    pieces = set(quality.indicators(text).tolist())
    assert set(whole.tolist()) <= pieces


def test_held_out_accuracy(frame):
    rows, labels = corpus(600)
    found = quality.quality_scores(frame(rows), frame(labels, LABELS)).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 600 and {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_held_out_labels_are_not_learned(frame):
    rows, labels = corpus(300)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    a, b = (rows_of(quality.quality_scores(frame(rows), frame(x, LABELS))) for x in (labels, flipped))
    assert a == b


def test_sample_is_bounded_and_balanced(frame):
    rows, labels = corpus(400)
    some = quality.training_rows(frame(rows), frame(labels, LABELS), per_class=30).collect()
    assert sorted(r.quality for r in some) == [0] * 30 + [1] * 30


def test_odd_rows(odd, none, frame):
    rows, labels = corpus(80)
    labels += [(1, 0, 0), (1, 1, 0), (None, 1, 0), (3, None, 0), (4, 5, 1), (6, 0, 0), (6, 0, 0)]
    docs = frame([*rows, *[(None if r[0] is None else 1000 + r[0], *r[1:]) for r in ROWS]])
    marks = frame(labels, LABELS)
    found = rows_of(quality.quality_scores(docs, marks))
    assert len(found) == 80 + len(ROWS)
    assert found == rows_of(quality.quality_scores(clashing(docs), clashing(marks)))
    assert quality.quality_scores(none, marks).count() == 0
    # Nothing to learn from: everything passes; only bad examples: nothing does.
    assert {r.score for r in quality.quality_scores(odd, marks.limit(0)).collect()} == {1.0}
    bad = frame([(d, 0, 0) for d in (1, 2, 4, 7)], LABELS)
    assert {r.score for r in quality.quality_scores(odd, bad).collect()} == {0.0}


def test_stage(frame, none):
    rows, labels = corpus(200)
    docs = clashing(frame(rows))
    kept = quality.keep_good(docs, frame(labels, LABELS))
    assert kept.dtypes == docs.dtypes
    good = {r.doc_id for r in quality.quality_scores(docs, frame(labels, LABELS)).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good and len(good) > 80
    assert quality.keep_good(none, frame(labels, LABELS)).count() == 0
