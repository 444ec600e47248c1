import hashlib
import random
import re

import numpy as np
import pytest
from awkward_rows import ROWS, clashing, rows_of
from vetline.llm import pii


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and sum(
            sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))
        ) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@pytest.mark.parametrize("signs", ["ab.@-1", "0123.. +()-", "+1 (23).-4", "0123456789 -", "a@b.c1+%", "45.6@x +"])
def test_base_like_the_patterns(signs):
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", [
    "1" * 300_000, "a" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "1 " * 150_000, "(at)" * 50_000,
    "1:" * 100_000, "x@" + "a." * 100_000, "0" * 5000 + "1.2.3.4",
])
def test_long_runs_end(text):
    base = pii.base_spans(text)
    pii.candidate_spans(text, base)
    assert all(0 <= s < e <= len(text) for s, _, e in base)


def test_candidates_keep_clear():
    text = "mail bob (at) site dot org, bob@site.org; call (030) 123 4567 or +1 (366) 555-9807, 4444.3333.2222.1111 fe80:0:0:0:1:2:3:4"
    base = pii.base_spans(text)
    found = pii.candidate_spans(text, base)
    assert {pii.KINDS[k] for _, k, _ in found} == {"email", "ip", "card", "phone"}
    spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, _, e in found])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    rates = [(0.95, 0.05), (0.9, 0.2), (0.6, 0.5), (0.8, 0.1)]
    votes = np.column_stack([np.where(rng.random(4000) < 0.3, -1, rng.random(4000) < np.where(truth, a, b)) for a, b in rates])
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, found = pii.reliabilities(patterns, counts.astype(float), np.zeros(len(patterns), bool))
    assert np.mean((share[inverse.ravel()] > 0.5) == truth) > 0.9
    for (a, b), (no, yes) in zip(rates, found):
        assert abs(yes - a) < 0.08 and abs(no - b) < 0.08


def test_classifier_learns_the_shares():
    codes = np.arange(64)
    share = np.where(codes >> 4 & 1, 0.95, 0.05)
    beta = pii.classifier(codes, np.full(64, 50.0), share)
    assert (np.column_stack((pii._bits(codes), np.ones(64))) @ beta >= 0).tolist() == (share > 0.5).tolist()


def made_up(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        kind = i % 6
        number = f"{rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        text = [
            f"please call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now", f"my phone {number} is here",
            f"order {number} was sent", f"write to user{i}@mail.example.com today", f"mail me at ann{i} (at) site dot com ok",
            f"server 10.{rng.randint(0, 255)}.3.{rng.randint(0, 255)} is up",
        ][kind]
        rows.append((i, text, "en", "s", 1))
    return rows


def test_added_spans(frame):
    """Phones and obfuscated addresses in a speaking context come in, order numbers do not."""
    found = {r.doc_id: r for r in pii.find_pii(frame(made_up(600))).collect()}
    added = {k: sum(bool(found[i].spans) and not (found[i].n_phone or found[i].n_email) for i in range(k, 600, 6)) for k in (1, 2, 4)}
    assert added[1] > 90 and added[4] > 90 and added[2] == 0


def rows_by_hand(rows):
    out = []
    for doc, text, *_ in rows:
        base = brute(text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        out.append((doc, *[sum(b[1] == k for b in base) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(odd, none, frame):
    more = [*ROWS, *made_up(30), (77, "é😀 bob@x.org 1.2.3.4, 4242 4242 4242 4242", None, None, 1)]
    docs = frame(more)
    found = pii.find_pii(docs)
    assert rows_of(found.drop("spans")) == rows_by_hand(more)
    assert rows_of(pii.find_pii(clashing(docs))) == rows_of(found)
    for r in found.collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)
    assert rows_of(pii.find_pii(odd).drop("spans")) == rows_by_hand(ROWS)
    assert pii.find_pii(none).count() == 0
