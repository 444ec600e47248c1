import re

import numpy as np
import pytest
from vetline.llm import decontaminate as d

from awkward_rows import ROWS, clashing, long_text, rows_of

ITEMS = [
    (1, long_text(3, 30)), (2, long_text(3, 30)), (3, None), (4, ""), (5, "two words"), (6, "word"),
    (7, long_text(17, 200)), (None, long_text(5, 12)), (8, "a a a a a a a a a"), (9, "!!! ..."),
]


def brute(docs, items, width=5, least=0.8):
    out = set()
    for doc, text, *_ in docs:
        own = re.findall(r"[^\W_]+", (text or "").lower())
        for item, theirs in items:
            words = re.findall(r"[^\W_]+", (theirs or "").lower())
            n = min(width, len(words))
            if not n:
                continue
            want = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            both = len(want & {tuple(own[i : i + n]) for i in range(len(own) - n + 1)})
            if both >= least * len(want) - 1e-9:
                out.add((doc, item, len(want), both))
    return sorted(out, key=repr)


def found(docs, items):
    return rows_of(d.find_items(docs, items).select("doc_id", "item_id", "n_shingles", "n_matched"))


def test_odd_rows(odd, none, frame):
    items = frame(ITEMS, "item_id long, text string")
    assert found(odd, items) == brute(ROWS, ITEMS)
    assert found(clashing(odd), clashing(items)) == brute(ROWS, ITEMS)
    assert found(none, items) == []
    assert found(odd, items.limit(0)) == []


def test_altered_passages(frame):
    """Items with ever more words replaced, around the containment of 0.8."""
    rng, docs, items = np.random.default_rng(3), [], []
    for i in range(60):
        words = long_text(19 + i, 10 + 3 * i).split()
        items.append((i, " ".join(words)))
        for k in range(6):
            own = list(words)
            for at in rng.choice(len(own), min(k, len(own)), replace=False):
                own[at] = f"new{k}"
            docs.append((100 * i + k, "before " + " ".join(own).upper() + " after.", "en", "a", 1))
    want = brute(docs, items)
    assert len(want) > 60
    assert found(frame(docs), frame(items, "item_id long, text string")) == want


def test_one_passage_in_most_documents(frame):
    passage = long_text(23, 40)
    docs = [(i, f"{long_text(i + 29, 20)} {passage if i % 3 else ''}", "en", "a", 1) for i in range(300)]
    items = [(1, passage)]
    assert found(frame(docs), frame(items, "item_id long, text string")) == brute(docs, items)


@pytest.mark.parametrize("n", [1, 2, 5, 9, 31, 32, 33, 500])
def test_signature_cannot_miss(n):
    k = d.signature_length(n, 0.8)
    assert 1 <= k <= n and k > n - d.required(n, 0.8)


def test_hashes_in_pieces(monkeypatch):
    words = long_text(3, 5000).split()
    whole = d.shingle_hashes(words, 5)
    monkeypatch.setattr(d, "PIECE", 64)
    assert np.array_equal(whole, d.shingle_hashes(words, 5))
    assert len(set(whole.tolist())) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_stage(odd, none, frame):
    items = frame(ITEMS, "item_id long, text string")
    docs = clashing(odd)
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = {x[0] for x in brute(ROWS, ITEMS)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in ROWS if r[0] not in bad), key=repr)
    assert d.drop_contaminated(none, items).count() == 0
