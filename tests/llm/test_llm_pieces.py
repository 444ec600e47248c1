import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql.types import LongType, StructField
from vetline.llm import pieces

from awkward_rows import ROWS, clashing, rows_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    with open(PATH, "rb") as f:
        return pieces.Transducer(f.read())


def texts(machine):
    rng = random.Random(2)
    names = [p for p in machine.piece]
    made = ["".join(rng.choice(names) for _ in range(rng.randint(1, 30))).replace("▁", " ") for _ in range(1500)]
    made += ["".join(rng.choice("abcdeinorst  \n") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    made += [r[1] or "" for r in ROWS]
    return made + ["a" * 700, "ab" * 400 + " c", "  two  spaces ", "<s></s><unk><0x0A>", "\x00\x01\x85 ", "😀漢字𝔘", "▁x ▁", "\r\n\t\t"]


def test_same_as_library(machine, library):
    for text in texts(machine):
        assert machine.encode(text).tolist() == library.encode(text), text


def test_round_trip(machine, library):
    for text in texts(machine):
        ids = machine.encode(text)
        if "▁" not in text:
            assert machine.decode(ids) == text
        assert machine.decode(ids) == library.decode(ids.tolist())


def test_forgetting_changes_nothing(machine, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 5)
    with open(PATH, "rb") as f:
        small = pieces.Transducer(f.read())
    for text in texts(machine)[:300]:
        assert small.encode(text).tolist() == machine.encode(text).tolist()


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    with open(PATH, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError, match="BPE"):
        pieces.Transducer(proto.SerializeToString())
    proto.trainer_spec.model_type = 2
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="white space"):
        pieces.Transducer(proto.SerializeToString())


def test_documents(odd, none, library):
    want = []
    for doc, text, *_ in ROWS:
        ids = library.encode(text or "")
        want.append((doc, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), True))
    assert rows_of(pieces.check_documents(odd, PATH)) == sorted(want, key=repr)
    assert rows_of(pieces.check_documents(clashing(odd), PATH)) == sorted(want, key=repr)
    assert pieces.check_documents(none, PATH).count() == 0


def test_stage(odd, none, library):
    out = pieces.encode_documents(clashing(odd), PATH)
    assert out.columns == [c for c in clashing(odd).columns if c not in ("text", "ids")] + ["n_pieces", "ids"]
    found = sorted(((r.doc_id, r.n_pieces, r.ids) for r in out.collect()), key=repr)
    want = [(d, len(ids := library.encode(t or "")), ids) for d, t, *_ in ROWS]
    assert found == sorted(want, key=repr)
    assert pieces.encode_documents(none, PATH).count() == 0


def test_decoding_gives_the_texts_back(odd, none, frame):
    docs = clashing(odd)
    encoded = pieces.encode_documents(docs, PATH)
    decoded = pieces.decode_documents(encoded.drop("n_pieces"), PATH)
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.text) for r in decoded.collect()), key=repr) == want
    assert pieces.decode_documents(pieces.encode_documents(none, PATH), PATH).count() == 0
    ids = frame([(1, [1, 0, 2]), (2, None), (3, []), (4, [3 + 0xE9])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode_documents(ids, PATH).collect()} == {1: "", 2: "", 3: "", 4: "\ufffd"}
    for bad in ([99_999_999], [-1], [5, None]):
        with pytest.raises(Exception, match="outside the vocabulary|id is null"):
            pieces.decode_documents(frame([(1, bad)], "doc_id long, ids array<int>"), PATH).collect()


def test_columns_are_encoded_like_texts(machine, monkeypatch):
    """Words of many texts together give each text's own ids and bytes, also with small memories."""
    own = texts(machine) + ["", " ", "  a", "a ", "a  b", "▁", "a▁ b", "a ▁b", "x\n y", "\n", "é " * 50, "w" * 200 + " v", "\x00 \x00"]
    for size in (10**6, 7):
        monkeypatch.setattr(pieces, "REMEMBERED", size)
        column = pa.array([*own[:40], None, *own[40:]])
        ids, sizes = machine.encode_column(column.slice(3))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        spelled = list(machine.spell(ids, sizes))
        assert len(parts) == len(column) - 3 == len(spelled)
        for text, part, data in zip(column.slice(3).to_pylist(), parts, spelled):
            assert part.tolist() == machine.encode(text or "").tolist()
            assert bytes(data).decode(errors="replace") == machine.decode(part)


def test_workers_keep_no_words(machine, monkeypatch):
    """Whatever a worker goes on with after a task has the memory of the words to itself."""
    class Captured:
        columns, schema = ["doc_id", "text"], {"doc_id": StructField("doc_id", LongType())}

        def select(self, *_):
            return self

        def mapInArrow(self, work, _):
            return work

    monkeypatch.setattr(pieces, "compiled", lambda _: machine)
    monkeypatch.setattr(pieces, "_model", lambda *_: type("Shared", (), {"value": b""}))
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["some words here", "and more of them"])], ["doc_id", "text"])
    for make in (pieces.encode_documents, pieces.check_documents):
        machine.encode_column(pa.array(["one two"]))
        assert sum(b.num_rows for b in make(Captured(), PATH)(iter([batch]))) == 2
        assert not machine.words and not machine.older and not machine.chunks
