"""SentencePiece encoding as the shortest path through a composed transducer."""

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vetline.llm.common import Laid, pieces_of, slices

SPACE = "▁"
#: Chunks (in each of two generations), chunks of single texts and piece pairs that a worker remembers.
REMEMBERED, REMEMBERED_CHUNKS, REMEMBERED_PAIRS = 30_000, 20_000, 1_500_000
#: Bytes of the texts encoded together, unless one alone is longer; characters of a chunk that is remembered.
TOGETHER, SHORT = 4_000_000, 64
#: Characters of the chunks composed together; a chunk of over LONG characters is composed by itself.
COMPOSED, LONG = 1 << 18, 256
#: Last piece of a path at the start of a chunk and after a byte fallback.
START = -1
#: In place of a piece: no arc is left, no piece has the character.
NONE, UNKNOWN = -1, -2
#: Key of the piece that ends at a node of the lexicon.
FINAL = 0
NORMAL, BYTE = 1, 6
BPE = 2


class Transducer:
    """A SentencePiece BPE model, compiled to weighted transducers.

    * The normaliser maps a space to U+2581 and puts one in front of a text that is not
      empty (``add_dummy_prefix``); models with other normalisation are refused.
    * The lexicon, a trie, maps strings to pieces. A character without a piece becomes
      its UTF-8 bytes (byte fallback).
    * The pair acceptor gives weight 0 to two neighbouring pieces that merging by score
      would leave apart, and infinity to all others. A sequence of pieces is the result
      of merging exactly if all its neighbours pass, so just one path stays finite.

    A piece costs 1, weights add along a path, and the path of least weight is taken.
    """

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep characters and white space as they are are supported")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.names = [p.piece for p in proto.pieces]
        self.piece = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = [p.score for p in proto.pieces]
        if any(p.type not in (1, 2, 3, BYTE) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.byte = [self.names.index(f"<0x{b:02X}>") for b in range(256)]
        single = {c for c in self.piece if len(c) == 1}
        if any(c not in single for p in self.piece for c in p):
            raise ValueError("a piece holds a character that is no piece itself")
        if any(SPACE in p.lstrip(SPACE) for p in self.piece):
            raise ValueError("a piece holds a space after another character")
        # No piece spans these places, so the text between them can be composed by itself.
        apart = "".join(c for c in "\n\t\r" if c not in single)
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}{apart}]*|[{apart}]|[^{SPACE}{apart}]+" if apart
                                else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.surface = [p.replace(SPACE, " ").encode() for p in self.names]
        for b, i in enumerate(self.byte):
            self.surface[i] = bytes([b])
        for i, p in enumerate(proto.pieces):
            if p.type in (2, 3):  # unknown and control pieces stand for no text
                self.surface[i] = b""
        self.pairs: dict[int, bool] = {}
        self.chunks = _Chunks(self)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.judged = np.empty(0, np.int64)
        self.spelled = pa.array(self.surface, pa.large_binary())

    @cached_property
    def lexicon(self) -> dict:
        """The trie of pieces; built by the first chunk, so that workers which only decode do without."""
        root: dict = {}
        for text, i in self.piece.items():
            node = root
            for c in text:
                node = node.setdefault(c, {})
            node[FINAL] = i
        return root

    @cached_property
    def arcs(self) -> "_Arcs":
        """The lexicon as arrays; built by the first column."""
        return _Arcs(self.piece, len(self.names))

    def merged(self, text: str) -> list[str]:
        """The text after all merges: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.piece.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def accepts(self, left: int, right: int) -> bool:
        """Whether the pair acceptor's weight for two neighbours is finite."""
        key = (left + 1) << 24 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._stays(left, right)
        return found

    def _stays(self, left: int, right: int) -> bool:
        """Whether merging leaves two neighbours as they are."""
        parts = ([] if left == START else [self.names[left]]) + [self.names[right]]
        return self.merged("".join(parts)) == parts

    def accept(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``accepts`` for many pairs: those judged before stand in one sorted array, the verdict in the last bit."""
        keys = (left.astype(np.int64) + 1) << 25 | right.astype(np.int64) << 1
        at = np.searchsorted(self.judged, keys)
        found = np.append(self.judged, -1)[at]
        new = np.unique(keys[found >> 1 != keys >> 1])
        if len(new):
            verdicts = [self._stays((k >> 25) - 1, k >> 1 & 0xFFFFFF) for k in new.tolist()]
            new |= np.array(verdicts, np.int64)
            known = self.judged if len(self.judged) + len(new) <= REMEMBERED_PAIRS else np.empty(0, np.int64)
            # Looked up before anything is dropped: what is needed now may be among it.
            every = np.insert(self.judged, np.searchsorted(self.judged, new), new)
            found = every[np.searchsorted(every, keys)]
            self.judged = every if len(known) else new
        return (found & 1).astype(bool)

    def shortest(self, chunk: str) -> list[int]:
        """Output ids of the best path through chunk, lexicon and pair acceptor.

        The composition is built as it is walked, long pieces first. At most one finite
        path leads to each place, so a place is entered once, and the first path to
        reach the end is the best one.
        """
        n, root, pairs = len(chunk), self.lexicon, self.pairs
        closed = bytearray(n + 1)
        at, last, path, arcs = 0, START, [], self._arcs(chunk, 0)
        waiting = []  # (place, last piece, arcs not tried) along the path
        while at < n:
            if chunk[at] not in root:  # byte fallback: no piece reaches over this character
                path.append(at)
                waiting.append((at, last, ()))
                at, last = at + 1, START
                arcs = self._arcs(chunk, at)
                continue
            base = (last + 1) << 24
            while arcs:
                end, piece = arcs.pop()
                if closed[end]:
                    continue
                fits = pairs.get(base | piece)
                if fits is None:
                    fits = self.accepts(last, piece)
                if fits:
                    waiting.append((at, last, arcs))
                    closed[end] = 1
                    path.append(piece)
                    at, last, arcs = end, piece, self._arcs(chunk, end)
                    break
            else:
                at, last, arcs = waiting.pop()
                path.pop()
        ids = []
        for (start, _, rest), piece in zip(waiting, path):
            if rest == () and chunk[start] not in root:
                ids.extend(self.byte[b] for b in chunk[start].encode())
            else:
                ids.append(piece)
        return ids

    def _arcs(self, chunk: str, start: int) -> list[tuple[int, int]]:
        """(end, piece) for the pieces that begin at a place, the longest last."""
        node, found = self.lexicon, []
        for end in range(start, len(chunk)):
            node = node.get(chunk[end])
            if node is None:
                break
            piece = node.get(FINAL)
            if piece is not None:
                found.append((end + 1, piece))
        return found

    def forget(self) -> None:
        """Drop the words and chunks remembered: the worker may go on with other work, which needs the memory."""
        self.words, self.older = {}, {}
        self.chunks.clear()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        normal = self.prefix + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, self.chunk.findall(normal))), np.int32)

    def compose(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of ids of each): ``shortest`` for many chunks at once.

        Every chunk has a place, the piece that led there and the longest arc not tried. In a step each
        takes its arc if the end is new and the pair acceptor passes it, else goes on to the next shorter one;
        without any it goes back to where it came from. The chunks lie one after another, with a gap behind
        each, and what is known of a place stands in arrays over all of them.
        """
        arcs, lengths = self.arcs, np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le"), np.uint32)
        end = np.cumsum(lengths + 1) - 1
        begin = end - lengths
        codes = arcs.code[points]
        codes[end] = 0
        longest = arcs.longest(codes)
        arrived = np.full(len(codes), START, np.int32)  # by place: the piece that led there
        closed, taken = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        at, last, arc = begin.copy(), np.full(len(begin), START, np.int32), longest[begin]
        while len(at):
            try_ = np.flatnonzero(arc >= 0)
            to = at[try_] + arcs.length[arc[try_]]
            new = ~closed[to]
            chosen = try_[new]
            fits = np.zeros(len(try_), bool)
            fits[new] = self.accept(last[chosen], arc[chosen])
            bare, stuck = np.flatnonzero(arc == UNKNOWN), np.flatnonzero(arc == NONE)
            refused = try_[~fits]
            arc[refused] = arcs.shorter[arc[refused]]
            if len(stuck):
                piece = last[stuck]
                taken[at[stuck]] = False
                at[stuck] -= np.where(piece >= 0, arcs.length[piece], 1)
                last[stuck] = arrived[at[stuck]]
                arc[stuck] = np.where(piece >= 0, arcs.shorter[piece], NONE)
            if len(bare):  # byte fallback: no piece reaches over this character
                at[bare] += 1
                last[bare] = START
            go, place = try_[fits], to[fits]
            last[go] = arc[go]
            at[go] = place
            go = np.concatenate((go, bare)) if len(bare) else go
            place = at[go]
            closed[place] = taken[place] = True
            arrived[place] = last[go]
            arc[go] = longest[place]
            left = at < end
            if not left.all():
                at, end, last, arc = at[left], end[left], last[left], arc[left]
        ends = np.flatnonzero(taken)
        found, sizes = arrived[ends], np.ones(len(ends), np.int64)
        byte = found == START
        if byte.any():
            spelled = [chr(c).encode() for c in points[ends[byte] - 1].tolist()]
            sizes[byte] = np.fromiter(map(len, spelled), np.int64, len(spelled))
            found, byte = np.repeat(found, sizes), np.repeat(byte, sizes)
            found[byte] = np.array(self.byte, np.int32)[np.frombuffer(b"".join(spelled), np.uint8)]
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(ends, begin + lengths, "right")]
        return found, np.diff(upto, prepend=0)

    def _coded(self, chunks: list[str], times: list[int]) -> list[bytes]:
        """The ids of different chunks; those not remembered are composed together, portion by portion.

        Chunks found several times are remembered: most others never come again.
        """
        words, older = self.words, self.older
        found = [words.get(c) or older.get(c) for c in chunks]
        portion, held = [], 0
        for i, chunk in enumerate(chunks):
            if found[i] is not None:
                continue
            if len(chunk) > LONG:
                found[i] = b"".join(map(self.chunks.__getitem__, self.chunk.findall(chunk)))
                continue
            portion.append(i)
            held += len(chunk)
            if held >= COMPOSED:
                self._compose_into(found, chunks, portion)
                portion, held = [], 0
        if portion:
            self._compose_into(found, chunks, portion)
        for chunk, ids, n in zip(chunks, found, times):
            if n > 1 and len(chunk) <= SHORT:
                if len(self.words) >= REMEMBERED:
                    self.older, self.words = self.words, {}
                self.words[chunk] = ids
        return found

    def _compose_into(self, found: list[bytes | None], chunks: list[str], portion: list[int]) -> None:
        ids, sizes = self.compose([chunks[i] for i in portion])
        data, end = ids.astype(np.int32).tobytes(), 0
        for i, size in zip(portion, (4 * sizes).tolist()):
            found[i] = data[end : end + size]
            end += size

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a null text is empty.

        No chunk goes on over a single blank, so the words of all texts are split and numbered in
        Arrow, each different one is encoded once, and ids are gathered by number. Texts with
        blanks side by side or at an end, or with U+2581, are cut into chunks one by one, and the
        different chunks of all of them are encoded once.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        numbers, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        alone = np.array([not self.prefix or not w or SPACE in w for w in words], bool)
        times = np.bincount(numbers, minlength=len(words)).tolist()
        found = self._coded([SPACE + w for w in words], times) if self.prefix else [b""] * len(words)
        places, total = Laid(np.fromiter(map(len, found), np.int64, len(found)) // 4).places(numbers)
        ids, sizes = np.frombuffer(b"".join(found), np.int32)[places], np.diff(total[ends], prepend=0)
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(alone[numbers]), "right")).tolist()
        if odd:
            cut = [self.chunk.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts.take(odd).to_pylist()]
            times = Counter(chain.from_iterable(cut))
            known, parts = dict(zip(times, self._coded(list(times), list(times.values())))), np.split(ids, np.cumsum(sizes)[:-1])
            for at, chunks in zip(odd, cut):
                parts[at] = np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.int32)
                sizes[at] = len(parts[at])
            ids = np.concatenate(parts)
        return ids, sizes

    def spell(self, ids: np.ndarray, sizes: np.ndarray) -> Iterator[memoryview]:
        """The bytes that each text's ids stand for, without the space that encoding put in front."""
        spelled = self.spelled.take(pa.array(ids))
        begins = np.frombuffer(spelled.buffers()[1], np.int64, len(ids) + 1)[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        data = memoryview(spelled.buffers()[2] or b"")
        for start, end in zip(begins, begins[1:]):
            yield data[start + bool(self.prefix and end > start and data[start] == 32) : end]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; the space that encoding put in front goes."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Arcs:
    """The lexicon's trie as arrays: a node's child for a character is found in one sorted array of both."""

    def __init__(self, pieces: dict[str, int], names: int):
        letters = sorted({c for p in pieces for c in p})
        self.code = np.zeros(0x110000, np.min_scalar_type(len(letters)))  # 0: no piece has the character
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes = {text: i for i, text in enumerate(sorted({p[:n] for p in pieces for n in range(len(p) + 1)} | {""}, key=len))}
        self.piece = np.full(len(nodes), NONE, np.int32)
        self.length, self.shorter = np.zeros(names, np.int64), np.full(names, NONE, np.int32)
        for text, i in pieces.items():
            self.piece[nodes[text]], self.length[i] = i, len(text)
            self.shorter[i] = next((pieces[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in pieces), NONE)
        inner = [t for t in nodes if t]
        keys = np.array([nodes[t[:-1]] * self.width + int(self.code[ord(t[-1])]) for t in inner] + [np.iinfo(np.int64).max])
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array([nodes[t] for t in inner] + [0], np.int32)[order]
        self.inner = np.zeros(len(nodes), bool)
        self.inner[[nodes[t[:-1]] for t in inner]] = True
        # The first character's node: no search for it.
        self.single = np.zeros(self.width, np.int32)
        for c in letters:
            self.single[self.code[ord(c)]] = nodes[c]

    def longest(self, codes: np.ndarray) -> np.ndarray:
        """The longest piece that begins at each place; ``UNKNOWN`` where the character has none."""
        node = self.single[codes]
        best = self.piece[node]
        best[codes == 0] = UNKNOWN
        place = np.flatnonzero(self.inner[node] & (codes > 0))
        node, step = node[place], 1
        while len(place):
            keys = node.astype(np.int64) * self.width + codes[place + step]
            at = np.searchsorted(self.keys, keys)
            on = self.keys[at] == keys
            place, node = place[on], self.child[at[on]]
            step += 1
            piece = self.piece[node]
            best[place[piece >= 0]] = piece[piece >= 0]
            deeper = self.inner[node]
            place, node = place[deeper], node[deeper]
        return best


class _Chunks(dict):
    """Chunk -> its ids as bytes."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, chunk: str) -> bytes:
        found = array("i", self.machine.shortest(chunk)).tobytes()
        if len(chunk) <= SHORT:
            if len(self) >= REMEMBERED_CHUNKS:
                self.clear()
            self[chunk] = found
        return found


_compiled: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer per model and worker."""
    key = zlib.crc32(model)
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by n_pieces and ids (array of int).

    Whole texts; a null text counts as empty and has no ids. Rows are handled one by
    one, so repeated rows, ties and null keys need no care. Columns called n_pieces or
    ids are replaced. An empty table gives an empty result.
    """
    model = _model(docs, path)
    kept = [c for c in docs.columns if c not in (text, "n_pieces", "ids")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model.value)
        for batch in pieces_of(batches, TOGETHER, text):
            flat, sizes = machine.encode_column(batch.column(text))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sizes.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                [*kept, "n_pieces", "ids"],
            )
            del flat, sizes, offsets, batch
        machine.forget()

    schema = T.StructType([
        *[docs.schema[c] for c in kept], T.StructField("n_pieces", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    return docs.select(*kept, text).mapInArrow(work, schema)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "text", keep: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) replaced by the ``text`` they stand for; with ``keep`` the ids stay as well.

    The opposite of ``encode_documents``: the space that encoding put in front goes, unknown
    and control pieces stand for no text, bytes that are no UTF-8 become U+FFFD. A null or
    empty array is the empty text; an id outside the vocabulary, or a null among the ids, stops
    the job with a message. Other columns pass unchanged, a column called ``text`` is
    replaced. An empty table gives an empty result.
    """
    model = _model(docs, path)
    kept = [c for c in docs.columns if c != text and (keep or c != ids)]
    read = kept if keep else [*kept, ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model.value)
        for batch in slices(batches):
            column = batch.column(ids)
            values, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            if values.null_count:
                raise ValueError("an id is null")
            values = values.to_numpy()
            if len(values) and not 0 <= values.min() <= values.max() < len(machine.names):
                raise ValueError("an id is outside the vocabulary")
            found = [str(data, "utf-8", "replace") for data in machine.spell(values, sizes)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.string())], [*kept, text])
            del column, values, found, batch

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(text, T.StringType())])
    return docs.select(*read).mapInArrow(work, schema)


def check_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip) from encoding and decoding whole texts.

    ``ids_crc32`` is over the ids as little-endian 32-bit integers; ``round_trip`` tells
    whether decoding gives the text back (null: the empty text). It does unless the
    text holds U+2581, which stands for a space.
    """
    model = _model(docs, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model.value)
        for batch in pieces_of(batches, TOGETHER):
            texts = pc.fill_null(batch.column("text"), "")
            ids, sizes = machine.encode_column(texts)
            ends = np.cumsum(sizes)
            sums = [zlib.crc32(part.astype("<i4").tobytes()) for part in np.split(ids, ends[:-1])]
            same = [data == text.as_buffer() for data, text in zip(machine.spell(ids, sizes), texts.cast(pa.large_binary()))]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "n_pieces", "ids_crc32", "round_trip"],
            )
            del texts, ids, ends, batch
        machine.forget()

    return docs.select("doc_id", "text").mapInArrow(work, T.StructType([
        docs.schema["doc_id"], T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("round_trip", T.BooleanType()),
    ]))
