"""Helpers shared by the training-data operators."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.runtime import fresh_path

#: Rows of a batch whose texts a task holds as Python strings at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage: neither a second reader nor a lost executor repeats the work.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give back what Arrow holds in reserve: a worker goes on to other tasks, and it would add to theirs."""
    pa.default_memory_pool().release_unused()


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that long texts do not pile up."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)
        del batch
        release()


def pieces_of(batches: Iterable[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece have some ``size`` bytes, or are one."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end
            release()
        del batch
        release()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(end of each text, number of each word, different words) of texts cut at blanks and line feeds.

    A null text is empty; an empty text is one empty word.
    """
    plain = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " ")
    split = pc.split_pattern(plain, " ")
    ends = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    return ends, coded.indices.to_numpy(), coded.dictionary.to_pylist()


class Laid:
    """Parts of given lengths that lie one after another."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.begins = lengths, np.cumsum(lengths) - lengths
        self.small = int(lengths.sum()) < 1 << 31

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, total before each and at last) of all elements of the parts ``numbers``."""
        length = self.lengths[numbers]
        total = np.concatenate(([0], np.cumsum(length)))
        kind = np.int32 if self.small and total[-1] < 1 << 31 else np.int64
        shift = (self.begins[numbers] - total[:-1]).astype(kind)
        return np.arange(total[-1], dtype=kind) + np.repeat(shift, length), total


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as strings, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def hex64(value: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front until they are not taken (in any case)."""
    held, found = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        found.append(name)
    return found
