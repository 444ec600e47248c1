"""Words of texts in Arrow batches: runs of letters and numbers of the lower-cased text.

These are the matches of ``[\\p{L}\\p{N}]+``. What is a letter and what its small form is, Python's Unicode tables say;
they may know some more characters than those of the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PATTERN = r"[\p{L}\p{N}]+"
PIECE = 8 << 20  # bytes of texts that are cut at once


@cache
def _in_words() -> np.ndarray:
    """Whether each code point is a letter or a number."""
    return np.fromiter((category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)


def pieces(batches: Iterable[pa.RecordBatch], text: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have some ``size`` bytes, or are one."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end
        del batch
        pa.default_memory_pool().release_unused()


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of the text of each word, words); a null text has none."""
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    small = pa.array(
        [(t or b"").decode("utf-8", "replace").lower() + "\n" for t in texts.cast(pa.binary()).to_pylist()], pa.large_string())
    ends = np.frombuffer(small.buffers()[1], np.int64, len(small) + 1)[1:]
    data = np.frombuffer(small.buffers()[2], np.uint8, ends[-1])
    known = _in_words()
    within = known[:256][data]
    far = data >= 0x80
    if far.any():
        points = np.frombuffer(data[far].tobytes().decode().encode("utf-32-le"), np.uint32)
        within[far] = np.repeat(known[points], 2 + (points >= 0x800).astype(np.int8) + (points >= 0x10000))
    # The line feed after each text ends its last word.
    edges = np.flatnonzero(np.diff(within, prepend=False))
    begins, stops = edges[::2], edges[1::2]
    offsets = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(stops - begins, out=offsets[1:])
    words = pa.Array.from_buffers(
        pa.string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[within])])
    return np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(begins, ends), prepend=0)), words


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, rising, times of each); keys are not negative."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(first, append=len(keys))


def texts_having(texts: pa.Array, groups: list[np.ndarray]) -> tuple[pa.Array, list[np.ndarray]]:
    """(different words, for each group of texts, given as a mask, how many of them have each)."""
    number, found = cut(texts)
    coded = found.dictionary_encode()
    size = len(coded.dictionary)
    pairs, _ = runs(number * size + coded.indices.to_numpy())
    text, word = np.divmod(pairs, max(size, 1))
    return coded.dictionary, [np.bincount(word[group[text]], minlength=size) for group in groups]


#: A sparse vector as Spark ML stores it.
_VECTOR = pa.struct([
    pa.field("type", pa.int8(), False), pa.field("size", pa.int32()),
    pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))),
    pa.field("values", pa.list_(pa.field("element", pa.float64(), False)))])


def counts_of(texts: pa.Array, listed: pa.Array) -> pa.Array:
    """For each text the sparse vector of how often it has each of the words ``listed``."""
    number, found = cut(texts)
    place, rows, size = pc.index_in(found, value_set=listed), len(texts), len(listed)
    hit = place.is_valid().to_numpy(zero_copy_only=False)
    at, times = runs(number[hit] * size + place.drop_null().to_numpy())
    ends = pa.array(np.searchsorted(at, np.arange(rows + 1) * size), pa.int32())
    return pa.StructArray.from_arrays([
        pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, size, np.int32)),
        pa.ListArray.from_arrays(ends, pa.array((at % size).astype(np.int32)), type=_VECTOR.field("indices").type),
        pa.ListArray.from_arrays(ends, pa.array(times.astype(float)), type=_VECTOR.field("values").type),
    ], fields=list(_VECTOR))
