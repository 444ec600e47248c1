"""Token ids as Arrow stream files of equal-length sequences, written and read at random.

A shard is two files in the Arrow IPC stream format:

* ``<name>.tokens.arrow``: record batches with ``ids`` (fixed-size list of uint16 or
  uint32) and ``mask`` (fixed-size list of bool). The shard's documents follow each other
  without gaps; the last sequence is filled up with zeros that the mask marks as false.
* ``<name>.docs.arrow``: ``doc_id``, ``start`` (tokens of the shard before the document)
  and ``n_tokens``.

Nothing is compressed, so a reader maps the file and takes any sequence or document
without copying.
"""

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import Laid, pieces_of, words_of

LENGTH = 2048
#: Sequences of a record batch.
SEQUENCES = 256
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 600_000
#: Bytes of the texts encoded together, unless one alone is longer.
TOGETHER = 8_000_000
#: Characters of a shard's texts, about; the number of shards follows from the input.
SHARD_CHARS = 64_000_000

# How a vocabulary that can be encoded word by word normalises and splits.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
]}
_SPLIT = {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
    "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: A word of letters that lower case leaves single letters, and marks that stand together.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
_PLAIN = re.compile(rf"({_LETTERS}+)({_MARKS}*)\Z")

_encoders: dict[int, "Encoder"] = {}


def _byte_signs() -> list[str]:
    """The character that stands for each byte: itself if it can be seen, else one from 256 on, in order."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Whole texts to ids with a vocabulary of the ``tokenizers`` library.

    Where the vocabulary's own rules (read from the file) drop white space and split letters
    from marks, a text's ids are those of its words one after another. The words of many
    texts are then split and numbered in Arrow, each different one is looked up once, and
    the ids are gathered by number. New words of letters and marks go to the library's
    model in lower case, the others through all its steps. Other vocabularies encode whole
    texts. What is remembered ages in two generations: the older one goes when the younger is full.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        rules = json.loads(vocabulary)
        model = rules["model"]
        self.by_word = (
            rules.get("normalizer") == _NORMALIZER
            and rules.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
            and rules.get("post_processor") is None and rules.get("truncation") is None and rules.get("padding") is None
            and model["type"] == "BPE" and not model.get("dropout")
            and all(not t["lstrip"] and not t["rstrip"] and not re.search(r"\s", t["content"]) for t in rules["added_tokens"])
        )
        # Added tokens are looked for first; a plain word that one can be part of takes all steps.
        self.added = [t["content"] for t in rules["added_tokens"] if re.fullmatch(f"{_LETTERS}*{_MARKS}*", t["content"])]
        self.signs = _byte_signs()
        self.parts: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _part(self, part: str) -> bytes:
        """Ids of letters in lower case or of marks, from the model."""
        found = self.parts.get(part)
        if found is None:
            text = part if part.isascii() else "".join(map(self.signs.__getitem__, part.encode()))
            found = np.array([t.id for t in self.tokenizer.model.tokenize(text)], self.kind).tobytes()
            if len(self.parts) >= REMEMBERED:
                self.parts = {"": b""}
            self.parts[part] = found
        return found

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        if len(self.words) + len(words) > REMEMBERED:
            self.older, self.words = self.words, {"": b""}
        known, out, odd = self.words, list(map(self.words.get, words)), []
        for at, found in enumerate(out):
            if found is not None:
                continue
            word = words[at]
            found = self.older.get(word)
            if found is None:
                plain = _PLAIN.match(word)
                if plain is None or any(t in word for t in self.added):
                    odd.append(at)
                    continue
                found = self._part(plain[1].lower()) + self._part(plain[2])
            known[word] = out[at] = found
        for at, found in zip(odd, self._ids([words[at] for at in odd])):
            known[words[at]] = out[at] = found
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a null text is empty."""
        if not self.by_word:
            found = self._ids(pc.fill_null(texts, "").to_pylist())
            sizes = np.array([len(b) for b in found], np.int64) // self.kind.itemsize
            return np.frombuffer(b"".join(found), self.kind), sizes
        ends, numbers, words = words_of(texts)
        found = self._look_up(words)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        places, total = Laid(lengths).places(numbers)
        return np.frombuffer(b"".join(found), self.kind)[places], np.diff(total[ends], prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []


def encoder(vocabulary: str) -> Encoder:
    key = zlib.crc32(vocabulary.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


class ShardWriter:
    """Writes one shard; documents go in one after another."""

    def __init__(self, folder: str, name: str, kind: np.dtype, length: int = LENGTH):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.paths = [f"{root}/{name}.{part}.arrow" for part in ("tokens", "docs")]
        self.kind, self.length, self.tokens = kind, length, 0
        self.schema = pa.schema([
            ("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length)),
        ])
        self.docs = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.outs = [self.fs.open_output_stream(p) for p in self.paths]
        self.writers = [pa.ipc.new_stream(o, s) for o, s in zip(self.outs, (self.schema, self.docs))]
        self.held, self.held_tokens = [], 0

    def add(self, doc_ids: pa.Array | list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of some documents one after another, and how many each has."""
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.writers[1].write_batch(pa.record_batch(
            [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.docs
        ))
        self.tokens += len(ids)
        self.held.append(ids)
        self.held_tokens += len(ids)
        block = self.length * SEQUENCES
        if self.held_tokens >= block:
            flat = np.concatenate(self.held)
            whole = len(flat) // block * block
            for at in range(0, whole, block):
                self._write(flat[at : at + block], block)
            self.held, self.held_tokens = [flat[whole:].copy()], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        self.writers[0].write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ], schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.held, np.empty(0, self.kind)])
        if len(flat):
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        for w, o in zip(self.writers, self.outs):
            w.close()
            o.close()


class ShardReader:
    """Random access to a shard's sequences, masks and documents."""

    def __init__(self, folder: str, name: str):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.batches, self.docs = [], None
        for part in ("tokens", "docs"):
            path = f"{root}/{name}.{part}.arrow"
            source = pa.memory_map(path) if local else fs.open_input_file(path)
            found = [b for b in pa.ipc.open_stream(source)]
            if part == "tokens":
                self.batches = found
            else:
                self.docs = found
        # Every batch but the last has SEQUENCES rows.
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else LENGTH

    def _flat(self, batch: int, column: str) -> pa.Array:
        held = self.batches[batch].column(column)
        return held.values.slice(held.offset * self.length, len(held) * self.length)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of the i-th sequence, both views of the mapped file; the mask is kept as bits."""
        batch, row = divmod(i, SEQUENCES)
        at = row * self.length
        ids = self._flat(batch, "ids").to_numpy(zero_copy_only=True)[at : at + self.length]
        return ids, self._flat(batch, "mask").slice(at, self.length)

    def tokens(self, start: int, n: int) -> list[np.ndarray]:
        """The shard's tokens from ``start`` on: views of the batches they lie in."""
        found, block = [], self.length * SEQUENCES
        while n > 0:
            batch, at = divmod(start, block)
            piece = self._flat(batch, "ids").to_numpy(zero_copy_only=True)[at : at + min(n, block - at)]
            found.append(piece)
            start, n = start + len(piece), n - len(piece)
        return found


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str,
                 length: int = LENGTH, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Encode ``docs`` into shards below ``folder``; returns their list.

    Whole texts in ascending doc_id order (null: an empty text; a null doc_id comes
    first; equal doc_ids by text), each followed by ``end_id``. The list has one row per
    shard: name, base (tokens in all shards before), n_docs, n_tokens. A shard belongs to
    one task and is named by it afresh at each attempt, so a task that runs twice leaves
    a file that the list does not name. Other columns are ignored; an empty table gives
    an empty list.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # a vocabulary file, of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, name, first, n = encoder(shared.value), None, uuid.uuid4().hex, None, 0
        for batch in pieces_of(batches, TOGETHER):
            ids, sizes = own.encode_column(batch.column("text"))
            # Every document is followed by the end.
            ended = np.insert(ids, np.cumsum(sizes), own.kind.type(end_id))
            if writer is None:
                writer, first = ShardWriter(folder, name, own.kind, length), batch.column("doc_id")[0].as_py()
            writer.add(batch.column("doc_id"), ended, sizes + 1)
            n += batch.num_rows
        if writer is not None:
            writer.close()
            yield pa.record_batch(
                [pa.array([name]), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([writer.tokens], pa.int64())],
                ["name", "first", "n_docs", "n_tokens"],
            )

    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    made = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(work, "name string, first long, n_docs long, n_tokens long")
    )
    listed = made.collect()  # one row per shard
    base, rows = 0, []
    for r in sorted(listed, key=lambda r: (r["first"] is not None, r["first"] or 0)):
        rows.append((r["name"], base, r["n_docs"], r["n_tokens"]))
        base += r["n_tokens"]
    return spark.createDataFrame(rows, "name string, base long, n_docs long, n_tokens long")


def read_documents(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the listed shards.

    ``start`` counts the tokens of all documents before; ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers, taken from the files by random access.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                shard = ShardReader(folder, name)
                for docs in shard.docs:
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                        crc = 0
                        for piece in shard.tokens(start, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.record_batch(
                        [docs.column("doc_id"), pc.add(docs.column("start"), base), docs.column("n_tokens"),
                         pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = max(1, min(shards.count(), 10_000))
    return shards.repartition(parts).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
