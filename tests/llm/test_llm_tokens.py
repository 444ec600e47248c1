import json
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from awkward_rows import ROWS, clashing, rows_of
from tokenizers import Tokenizer
from vetline.llm import arrow_tokens as t
from vetline.llm.common import pieces_of
from vetline.runtime import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def expected(rows, end=2):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(((d, x) for d, x, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "chars"), [(2048, 1 << 30), (7, 5000)])
def test_round_trip(spark, odd, vocabulary, length, chars):
    """One large shard and many small ones; documents that cross sequences and batches."""
    for docs in (odd, clashing(odd)):
        folder = fresh_path(spark, "tokens")
        shards = t.write_tokens(docs, vocabulary, 2, folder, length, chars)
        assert rows_of(t.read_documents(shards, folder)) == expected(ROWS)


def test_empty_table(spark, none, vocabulary):
    folder = fresh_path(spark, "tokens")
    shards = t.write_tokens(none, vocabulary, 2, folder)
    assert shards.count() == 0 and t.read_documents(shards, folder).count() == 0


def test_words_together_are_words_apart(vocabulary):
    """Encoding word by word gives what the library gives for the whole text."""
    encoder = t.encoder(vocabulary)
    assert encoder.by_word
    rng, signs = random.Random(2), "ab'sS 19.,!é́\t\x1c  \x85<|>endoftxstar漢字😀ﬁİßΣς\n"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    signs = "aEéÉßÿÞØ.,;!%$&*#@-_'\"()<|>~`^[]{}/\\ \u0301"
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(6000)]
    texts += ["<|endoftext|> a<|startoftext|>b", "x <|endoftext|>", "", "don't I'LL", " ́a \ńb", *[r[1] or "" for r in ROWS]]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [r.tolist() for r in encoder.encode(texts)] == want


def test_other_vocabularies_are_encoded_whole():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = t.Encoder(f.read())
    texts = ["two words\nand  more", "", " x"]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [r.tolist() for r in encoder.encode(texts)] == want


def test_a_vocabulary_with_other_rules_is_not_taken_word_by_word(vocabulary):
    """What the file says counts, whatever some words would give."""
    rules = json.loads(vocabulary)
    rules["normalizer"]["normalizers"].pop()
    other = t.Encoder(json.dumps(rules))
    assert not other.by_word
    texts = ["Two Words,\nand  more!", "", "ÉTÉ"]
    want = [e.ids for e in other.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [r.tolist() for r in other.encode(texts)] == want


def test_what_is_remembered_ages(vocabulary, monkeypatch):
    monkeypatch.setattr(t, "REMEMBERED", 40)
    encoder, whole = t.Encoder(vocabulary), Tokenizer.from_file(PATH)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{'x' * (j % 5)}," for j in range(9)) for i in range(300)] * 2
    for at in range(0, len(texts), 7):
        want = [e.ids for e in whole.encode_batch(texts[at : at + 7], add_special_tokens=False)]
        assert [r.tolist() for r in encoder.encode(texts[at : at + 7])] == want
    assert max(len(encoder.words), len(encoder.older), len(encoder.parts)) <= 120


def test_pieces_are_bounded_by_bytes():
    texts = ["abc", None, "defgh", "x" * 40, "", "ij", "k" * 9, "l"]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    cut = [p.column("text").to_pylist() for p in pieces_of(iter([batch, batch.slice(0, 0)]), 10)]
    assert [x for p in cut for x in p] == texts
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= 10 for p in cut)


def test_random_access(tmp_path):
    rng, rows = np.random.default_rng(1), []
    writer = t.ShardWriter(str(tmp_path), "s", np.dtype(np.uint16), 16)
    for size in (0, 5, 40_000, 16, 1, 9_000):
        rows.append(rng.integers(0, 60_000, size).astype(np.uint16))
    for at in (0, 3):
        writer.add([at, at + 1, at + 2], np.concatenate(rows[at : at + 3]), np.array([len(r) for r in rows[at : at + 3]]))
    writer.close()
    flat = np.concatenate(rows)
    reader = t.ShardReader(str(tmp_path), "s")
    for i in (0, 3, 255, 256, 257, len(flat) // 16):
        ids, mask = reader.sequence(i)
        assert len(ids) == len(mask) == 16 and ids.base is not None
        assert isinstance(mask, pa.BooleanArray) and mask.buffers()[1].address == reader._flat(i // 256, "mask").buffers()[1].address
        assert ids[mask.to_numpy(zero_copy_only=False)].tolist() == flat[16 * i : 16 * i + 16].tolist()
    at = 0
    for r in rows:
        assert np.array_equal(np.concatenate([*reader.tokens(at, len(r)), np.empty(0, np.uint16)]), r)
        at += len(r)
    table = pa.ipc.open_stream(pa.memory_map(f"{tmp_path}/s.tokens.arrow")).read_all()
    assert pa.types.is_fixed_size_list(table.schema.field("ids").type) and table.schema.field("mask").type.list_size == 16
