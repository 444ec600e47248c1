import numpy as np
import pyarrow as pa
from awkward_rows import ROWS, clashing, rows_of
from vetline.llm import langid

TEXTS = {
    "en": "the quick brown fox and the lazy dog that were with their friends when they thought about things which other people had",
    "de": "der schnelle braune fuchs und der faule hund die mit ihren freunden waren als sie über dinge nachdachten welche nicht",
    "fr": "le renard brun et rapide avec le chien paresseux qui étaient chez leurs amis quand ils pensaient aux choses que les autres",
}


def grams_of(word):
    """The n-grams of a word between two blanks; a lone blank is none."""
    padded = f" {word} "
    return [*word, *(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))]


def prose(lang, seed, n=60):
    words = TEXTS[lang].split()
    rng = np.random.default_rng(seed)
    return " ".join(words[i] for i in rng.integers(0, len(words), n))


def brute_profile(texts):
    """gram -> mean rank of the most frequent grams, counted one by one."""
    counts = {}
    for text in texts:
        for word in langid.LETTERS.findall(text.lower()):
            for gram in grams_of(word):
                counts[gram] = counts.get(gram, 0) + 1
    return brute_ranks(counts)


def brute_ranks(counts):
    ordered = sorted(counts.values(), reverse=True)
    least = ordered[min(len(ordered), langid.RANKS) - 1] if ordered else 0
    top = {g: n for g, n in counts.items() if n >= least}
    return {g: sum(m > n for m in top.values()) + (sum(m == n for m in top.values()) - 1) / 2 for g, n in top.items()}


def brute_predict(profiles, text):
    own = brute_profile([text])
    if not own or not profiles:
        return "und", 0.0
    mean = {
        lang: sum(min(abs(r - p[g]), langid.RANKS) if g in p else langid.RANKS for g, r in own.items()) / len(own)
        for lang, p in profiles.items()
    }
    best = min(sorted(mean), key=lambda x: mean[x])
    return best, 1 - mean[best] / langid.RANKS


def test_profiles_and_predictions_like_counting_by_hand(frame, monkeypatch):
    rows = [(i, prose(lang, 3 * i + k), lang, "s", 1) for i in range(30) for k, lang in enumerate(TEXTS)]
    monkeypatch.setattr(langid, "RANKS", 60)
    docs = frame(rows)
    profiles = langid.learn(docs)
    for lang in TEXTS:
        want = brute_profile([r[1] for r in rows if r[2] == lang])
        assert profiles[lang] == want
    own = langid.Identifier(profiles)
    for text in [r[1] for r in rows[:20]] + ["", "12 34 !", "ßß", "zzz qqq", prose("en", 5, 3) + prose("de", 6, 3)]:
        (lang,), (score,) = own.predict(pa.array([text]))
        want = brute_predict(profiles, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-6


def test_grams_of_whole_texts():
    """Counts over texts with marks, digits, long words, other scripts and letters that lower case lengthens."""
    texts = ["The cat's hat_rack, x2y: 3\tTHE\u00a0the", None, "", "12 34", "漢字 İstanbul ΟΔΟΣ ße\u0301 ½a", "a", " b  c\n\nd ",
             "w" * 300 + " " + "é" * 70, "\0 z\0z 😀q"]
    found = list(langid.counted(pa.array(texts)))
    assert len(found) == len(texts)
    for text, (keys, places, counts) in zip(texts, found):
        want = {}
        for word in langid.LETTERS.findall((text or "").lower()):
            for gram in grams_of(word):
                want[gram] = want.get(gram, 0) + 1
        got = {langid.gram_text(k): n for k, n in zip(keys[places].tolist(), counts.tolist())}
        assert got == want and all(langid.gram_key(g) in keys for g in got)


def test_held_out_accuracy(frame):
    rows = [(i, prose(lang, i, 25), lang, "s", 1) for i, lang in enumerate(list(TEXTS) * 60)]
    found = langid.identify(frame(rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in found if r.held_out]
    assert len(found) == len(rows) and 30 < len(held) < 90
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_language_source_and_id_are_no_inputs(frame):
    rows = [(i, prose(lang, i, 25), lang, "s", 1) for i, lang in enumerate(list(TEXTS) * 20)]
    profiles = langid.learn(frame(rows))
    a, b = langid.Identifier(profiles), langid.Identifier(profiles)
    text = pa.array([rows[0][1]])
    assert a.predict(text) == b.predict(text)


def test_small_memories_change_nothing(frame, monkeypatch):
    rows = [(i, prose(lang, i, 40), lang, "s", 1) for i, lang in enumerate(list(TEXTS) * 10)]
    whole = langid.learn(frame(rows))
    monkeypatch.setattr(langid, "HELD", 40)
    monkeypatch.setattr(langid, "TABLE", 10)
    monkeypatch.setattr(langid, "TOGETHER", 90)
    monkeypatch.setattr(langid, "PIECE", 8)
    assert langid.learn(frame(rows)) == whole
    small = langid.Identifier(whole)
    found = [tuple(x[0] for x in small.predict(pa.array([r[1]]))) for r in rows]
    monkeypatch.undo()
    large = langid.Identifier(whole)
    assert found == list(zip(*large.predict(pa.array([r[1] for r in rows]))))


def test_odd_rows(odd, none, frame):
    found = rows_of(langid.identify(odd))
    assert len(found) == len(ROWS)
    texts = {r[0]: r[1] for r in ROWS if r[0] is not None}
    for doc, held, lang, score in found:
        assert 0 <= score <= 1 and held in (True, False)
        if doc is not None and not any(c.isalpha() for c in texts[doc] or ""):
            assert (lang, score) == ("und", 0.0)
    assert found == rows_of(langid.identify(clashing(odd)))
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(frame([(1, "some words", None, "s", 1)])).collect()} == {"und"}
