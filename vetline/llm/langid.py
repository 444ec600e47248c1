"""Language by rank-order profiles of character n-grams and the out-of-place distance.

The words of many texts are split and numbered in Arrow; the n-grams of each different word
are found once, and a text's counts add up over its words by number.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.llm.common import Laid, fold, pieces_of, words_of

#: Lengths of the n-grams of a word, and ranks that a profile and a document have.
LONGEST, RANKS = 3, 400
#: Bytes of texts whose words are numbered together, and of a longer text's parts; words of a text added up at once.
TOGETHER, PIECE = 4_000_000, 1 << 16
#: N-gram counts that a task holds before it sends them on.
HELD = 2_000_000
#: Different codes that are numbered by a table; more by sorting.
TABLE = 1 << 24
#: Profile rows that may go to the driver.
MAX_PROFILE_ROWS = 2_000_000
UNKNOWN = "und"
#: Rank of an n-gram that a profile lacks: out of reach of every rank of a document.
NOWHERE = 1e9
LETTERS = re.compile(r"[^\W\d_]+")


#: An n-gram as one number: code points of BITS bits, the last one lowest, nothing before the first.
BITS = 21


def gram_text(key: int) -> str:
    """The n-gram that a key stands for."""
    points = [key >> shift & (1 << BITS) - 1 for shift in range(BITS * (LONGEST - 1), -1, -BITS)]
    return "".join(map(chr, points)).lstrip("\0")


def gram_key(gram: str) -> int:
    return sum(ord(c) << BITS * i for i, c in enumerate(reversed(gram)))


class _Letters:
    """Tells letters by code point; looked up once for each that comes up."""

    def __init__(self):
        self.kind = np.zeros(0x110000, np.uint8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if not kinds.all():
            for point in np.unique(points[kinds == 0]).tolist():
                self.kind[point] = 1 + bool(LETTERS.match(chr(point)))
            kinds = self.kind[points]
        return kinds == 2


_letters = _Letters()


def _numbered(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(different codes in order, place of each code among them); codes are below ``size``."""
    if size > TABLE:
        return np.unique(codes, return_inverse=True)
    used = np.zeros(size, bool)
    used[codes] = True
    return np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - 1)[codes]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, lengths): the different n-grams, and those of each word one after another as places among them.

    A word here is what stands between blanks; the words of letters in it, in lower case,
    stand between two blanks each. A letter ends one n-gram of one and one of two
    characters and is the middle of one of three; the last letter of a word begins one of two more.
    """
    points = np.frombuffer(f" {' '.join(words).lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(points == 32) - 1
    alphabet, code = _numbered(points, 0x110000)
    letter = _letters(alphabet)
    alphabet, place = alphabet[letter], np.cumsum(letter) * letter  # 0 stands for a blank
    code, size = place[code], int(letter.sum()) + 1
    at = np.flatnonzero(code)
    before, own, after = code[at - 1], code[at], code[at + 1]
    two, three = size, size + size * size
    found = np.stack([own, two + before * size + own, three + (before * size + own) * size + after,
                      np.where(after == 0, two + own * size, -1)], axis=1).ravel()
    kept = found >= 0
    names, places = _numbered(found[kept], three + size**3)
    lengths = np.bincount(np.repeat(owner[at], 4)[kept], minlength=len(words))
    chars = np.concatenate(([32], alphabet)).astype(np.int64)
    rest = names - np.where(names >= three, three, np.where(names >= two, two, 0))
    first, second, third = rest // (size * size), rest // size % size, rest % size
    keys = chars[third] | np.where(names >= two, chars[second] << BITS, 0) | np.where(names >= three, chars[first] << 2 * BITS, 0)
    return keys, places, lengths


class _Coded:
    """Some texts as words, and the n-grams of each different word under numbers of their own."""

    def __init__(self, texts: pa.Array):
        self.ends, self.words, words = words_of(texts)
        #: The n-grams' keys, and each word's n-grams as places in this list.
        self.keys, self.grams, lengths = _grams(words)
        self.grams = self.grams.astype(np.intp)
        self.laid = Laid(lengths)

    def counts(self, at: int) -> np.ndarray:
        """How often each n-gram occurs in a text, over all its words."""
        start, end = self.ends[at - 1] if at else 0, self.ends[at]
        found = np.zeros(len(self.keys), np.int64)
        for piece in range(start, end, PIECE):
            places, _ = self.laid.places(self.words[piece : min(end, piece + PIECE)])
            found += np.bincount(self.grams[places], minlength=len(found))
        return found

    def sums(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of the n-grams of the texts that ``own`` marks."""
        words = self.words[np.repeat(own, np.diff(self.ends, prepend=0))]
        times = np.bincount(words, minlength=len(self.laid.lengths))
        counts = np.bincount(self.grams, np.repeat(times, self.laid.lengths), len(self.keys)).astype(np.int64)
        seen = np.flatnonzero(counts)
        return self.keys[seen], counts[seen]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of several such pairs."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def parts_of(text: str) -> Iterator[str]:
    """A long text cut at blanks into parts of some TOGETHER characters."""
    start = 0
    while start < len(text):
        end = text.find(" ", start + TOGETHER)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, places, counts) of each text's n-grams: ``places`` among ``keys``, which many texts share."""
    if len(texts) == 1 and len(text := texts[0].as_py() or "") > TOGETHER:
        keys, counts = _added([_Coded(pa.array([part])).sums(np.ones(1, bool)) for part in parts_of(text)])
        yield keys, np.arange(len(keys)), counts
        return
    coded = _Coded(texts)
    for at in range(len(texts)):
        counts = coded.counts(at)
        places = np.flatnonzero(counts)
        yield coded.keys, places, counts[places]


def middle_ranks(counts: np.ndarray) -> np.ndarray:
    """Ranks from 0 by falling count; equal counts share the mean of their ranks."""
    ordered = np.sort(-counts)
    low = np.searchsorted(ordered, -counts, "left")
    return (low + np.searchsorted(ordered, -counts, "right") - 1) / 2


def frequent(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The RANKS most frequent n-grams, with all that tie with the last of them, and their ranks."""
    if len(counts) > RANKS:
        keep = counts >= np.partition(counts, len(counts) - RANKS)[len(counts) - RANKS]
        numbers, counts = numbers[keep], counts[keep]
    return numbers, middle_ranks(counts)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of all texts of each language, summed over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = _added(parts)
                grams = pa.array(map(gram_text, keys.tolist()), pa.string())
                yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), grams, pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in pieces_of(batches, TOGETHER):
            langs = batch.column("lang").dictionary_encode()
            texts = [batch.column("text")]
            if batch.num_rows == 1:
                texts = [pa.array([part]) for part in parts_of(texts[0][0].as_py() or "")]
            for coded in map(_Coded, texts):
                for at, lang in enumerate(langs.dictionary.to_pylist()):
                    found = coded.sums(langs.indices.to_numpy() == at)
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
            if size > HELD:
                held.update({lang: [_added(parts)] for lang, parts in held.items()})
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from sent()
                    size = 0
        yield from sent()

    rows = docs.select("lang", "text").mapInArrow(work, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> dict[str, dict[str, float]]:
    """Language -> {n-gram: rank} over the rows of ``docs`` with a lang."""
    counts = gram_counts(docs.where("lang is not null and text is not null"))
    by_lang = Window.partitionBy("lang")
    top = (
        counts.withColumn("place", F.rank().over(by_lang.orderBy(F.desc("n")))).where(F.col("place") <= RANKS)
        .withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy("lang", "n")))
        .select("lang", "gram", (F.col("place") - 1 + (F.col("ties") - 1) / 2).alias("rank"))
        .limit(MAX_PROFILE_ROWS + 1)
    )
    rows = top.collect()
    if len(rows) > MAX_PROFILE_ROWS:
        raise ValueError("more languages than a task can hold profiles of")
    profiles: dict[str, dict[str, float]] = {}
    for lang, gram, rank in rows:
        profiles.setdefault(lang, {})[gram] = rank
    return dict(sorted(profiles.items()))


class Identifier:
    """Compares texts with all profiles; n-grams a profile lacks are RANKS places out."""

    def __init__(self, profiles: dict[str, dict[str, float]]):
        self.langs = list(profiles)
        grams = sorted({gram_key(g): g for own in profiles.values() for g in own}.items())
        self.keys = np.array([k for k, _ in grams], np.int64)
        # The last row is that of n-grams in no profile.
        self.ranks = np.full((len(grams) + 1, len(self.langs)), NOWHERE, np.float32)
        for k, own in enumerate(profiles.values()):
            for at, (_, gram) in enumerate(grams):
                if gram in own:
                    self.ranks[at, k] = own[gram]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """A row for each n-gram: its rank in each profile."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return self.ranks[np.where(known, at, len(self.keys))]

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of each text: the nearest profile, the first by name among equals."""
        langs, scores, places, last = [], [], None, None
        for keys, numbers, counts in counted(texts):
            if not len(numbers) or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            if keys is not last:
                places, last = self.places(keys), keys
            numbers, ranks = frequent(numbers, counts)
            distance = np.minimum(np.abs(places[numbers] - ranks[:, None]), RANKS).mean(axis=0)
            best = int(np.argmin(distance))
            langs.append(self.langs[best])
            scores.append(float(np.clip(1 - distance[best] / RANKS, 0, 1)))
        return langs, scores


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Profiles hold the RANKS most frequent n-grams (one to three characters of words
    between blanks, lower case) of each lang, counted over all documents whose
    crc32(doc_id as text) mod 3 is not 1; a null doc_id teaches nothing and is not held
    out. The whole text's most frequent n-grams are ranked likewise, equal counts
    sharing their mean rank, and the language with the least mean difference of ranks
    is taken (the first by name among equals). ``score`` is 1 at no difference, 0 where
    nothing agrees. A text that is null or without letters, or no known language, gives
    ``und`` and 0. Other columns are ignored, repeated rows are predicted alike, an
    empty table gives an empty result.
    """
    group = fold(F.col("doc_id"), 3)
    profiles = learn(docs.where(group != 1).select("lang", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(shared.value)
        for batch in pieces_of(batches, TOGETHER):
            langs, scores = own.predict(batch.column("text"))
            yield pa.record_batch(
                [*batch.select(["doc_id", "held_out"]).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", F.coalesce(group == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(work, T.StructType([
        docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]))
