import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from vetline.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_decoding_can_keep_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two  three\n"), (2, ""), (3, None)], "doc_id int, text string")
    encoded = pieces.encode_documents(docs, MODEL)
    rows = pieces.decode_documents(encoded, MODEL, "ids", "again", keep=True)
    assert rows.columns == ["doc_id", "n_pieces", "ids", "again"]
    assert [(r.ids, r.again) for r in rows.orderBy("doc_id").collect()] == [
        (e.ids, t) for e, t in zip(encoded.orderBy("doc_id").collect(), ["one two  three\n", "", ""])]


def test_decoding_builds_no_lexicon():
    with open(MODEL, "rb") as f:
        machine = pieces.Transducer(f.read())
    ids = machine.encode("so it is")
    with open(MODEL, "rb") as f:
        other = pieces.Transducer(f.read())
    assert other.decode(ids) == "so it is" and "lexicon" not in vars(other) and "lexicon" in vars(machine)


def test_new_words_are_composed_together(monkeypatch):
    """Words that come once are not walked one by one, and only words that come again are remembered."""
    with open(MODEL, "rb") as f:
        machine = pieces.Transducer(f.read())
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdehinorstuè.\n漢") for _ in range(rng.randint(1, 20))) for _ in range(3000)})
    want = [machine.encode(w).tolist() for w in words]
    monkeypatch.setattr(machine, "shortest", None)
    machine.chunks.clear()
    for together in (1 << 18, 50):
        monkeypatch.setattr(pieces, "COMPOSED", together)
        ids, sizes = machine.encode_column(pa.array([*words, "of of of"]))
        assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])][:-1] == want
        assert set(machine.words) == {"▁of"}


def test_few_pairs_remembered_change_nothing(monkeypatch):
    with open(MODEL, "rb") as f:
        model = f.read()
    texts = [f"some {w}ing of {w}s and  {w}{w}" for w in ("word", "piece", "ü漢", "text", "a" * 400)]
    machine, small = pieces.Transducer(model), pieces.Transducer(model)
    want = [machine.encode(t).tolist() for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 5)
    for t, ids in zip(texts, want):
        assert small.encode_column(pa.array([t]))[0].tolist() == ids
