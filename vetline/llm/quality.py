"""Quality scores: Naive Bayes log-count ratios under a linear hinge-loss model."""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.llm.common import fold, slices, texts_of

#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 18
#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 4000
#: Words whose codes a worker remembers within a task.
REMEMBERED = 60_000
#: Words of a text handled at once.
PIECE = 1 << 16
SHAPE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _case(letters: str) -> str:
    if letters.islower():
        return "a"
    if len(letters) > 1 and letters.isupper():
        return "A"
    return "Aa" if letters[0].isupper() else "x"


def _shape(word: str) -> str:
    """What a word looks like: case of its letters, digits, marks (three at most)."""
    if word.isalpha():
        return _case(word)
    if word[:-1].isalpha() and not word[-1].isdigit():
        return _case(word[:-1]) + word[-1]
    return "".join(
        _case(run) if run[0].isalpha() else "9" if run[0].isdigit() else run[:3] for run in SHAPE.findall(word)[:6]
    )


class _Codes(dict):
    """Word -> eight bytes: a hash of the word in lower case, a hash of its shape."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        code = zlib.crc32(word.lower().encode()) | zlib.crc32(_shape(word).encode(), 1) << 32
        found = self[word] = code.to_bytes(8, "little")
        return found


_codes = _Codes()


def _scattered(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(8)) & np.uint64(BUCKETS - 1)


def indicators(text: str) -> np.ndarray:
    """The buckets of a text's n-grams, each once, ascending.

    Word n-grams (one and two words, lower case) and shape n-grams (one to four
    words, where a word equal to the one before has a shape of its own).
    """
    words, found = text.split(), []
    for at in range(0, len(words), PIECE):
        piece = words[max(at - 3, 0) : at + PIECE]
        codes = np.frombuffer(b"".join(map(_codes.__getitem__, piece)), np.uint32).reshape(-1, 2).astype(np.uint64)
        word, shape = codes[:, 0], codes[:, 1].copy()
        shape[1:][word[1:] == word[:-1]] = 1
        grams, factor = [], np.uint64(0x9E3779B97F4A7C15)
        for values, longest, salt in ((word, 2, 1), (shape, 4, 101)):
            h = values + np.uint64(salt << 33)
            grams.append(h)
            for n in range(2, longest + 1):
                h = h[:-1] * factor + values[n - 1 :] + np.uint64((salt + n) << 33)
                grams.append(h)
        found.append(_scattered(np.concatenate(grams)).astype(np.int32))
    if not found:
        return np.empty(0, np.int32)
    buckets = np.sort(np.concatenate(found))
    return buckets[np.concatenate(([True], buckets[1:] != buckets[:-1]))]


@dataclass
class Model:
    """weights per bucket (ratio times hinge weight), ratios, bias, and the score's curve."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        norm = float(np.sqrt(np.dot(r, r))) or 1.0
        return float(np.dot(r, self.weight[found])) / norm + self.bias

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        z = self.slope * self.margin(indicators(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each bucket among class 1 over that among class 0."""
    counts = [
        np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == c]), minlength=BUCKETS) + smooth
        for c in (1, 0)
    ]
    return np.log(counts[0] / counts[0].sum() / (counts[1] / counts[1].sum()))


def hinge(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 1.0,
          rounds: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L2-regularised hinge loss, by dual coordinate descent.

    Rows are the ratios of a text's buckets at unit length, with a constant feature for
    the bias. Each step sets one dual variable to its best value in [0, cost].
    """
    weight, bias = np.zeros(BUCKETS), 0.0
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / (float(np.sqrt(np.dot(v, v))) or 1.0))
    square = np.array([np.dot(v, v) + 1.0 for v in values])
    sign, dual = np.where(labels == 1, 1.0, -1.0), np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            own = rows[i]
            gradient = sign[i] * (np.dot(weight[own], values[i]) + bias) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), cost)
            step = (new - dual[i]) * sign[i]
            if step:
                weight[own] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    return weight, bias


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through margins of rows not fitted on."""
    n1, n0 = int((labels == 1).sum()), int((labels != 1).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.column_stack((margins, np.ones(len(margins)))), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model from indicator rows; the curve comes from fits on two thirds each."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1), np.zeros(1), 0, 1, 0, constant=0.0 if len(labels) and labels[0] == 0 else 1.0)
    part, margins = np.arange(len(rows)) % 3, np.zeros(len(rows))
    parts = range(3) if min(np.bincount(labels)) >= 3 * 3 else ()
    for p in parts:
        train = np.flatnonzero(part != p)
        own, y = [rows[i] for i in train], labels[train]
        ratio = log_count_ratio(own, y)
        weight, bias = hinge(own, y, ratio)
        model = Model(ratio, weight, bias, 1, 0)
        for i in np.flatnonzero(part == p):
            margins[i] = model.margin(rows[i])
    slope, shift = curve(margins, labels) if parts else (2.0, 0.0)
    ratio = log_count_ratio(rows, labels)
    weight, bias = hinge(rows, labels, ratio)
    return Model(ratio.astype(np.float32), weight.astype(np.float32), bias, slope, shift)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, quality, found): a bounded sample of the labelled documents.

    Documents whose crc32(doc_id as text) mod 4 is 2 are held out. Of the rest the
    ``per_class`` with the smallest hash of doc_id stay for each of the labels 0 and 1;
    a doc_id with several labels counts with the smallest, other labels are skipped.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [indicators(t).tobytes() for t in texts_of(batch)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary())],
                ["doc_id", "quality", "found"],
            )
        _codes.clear()  # the worker may go on with other work, which needs the memory

    judged = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(fold(F.col("doc_id"), 4) != 2)
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .withColumn("draw", F.xxhash64("doc_id"))
    )
    chosen = None
    for c in (0, 1):
        one = judged.where(F.col("quality") == c).orderBy("draw", "doc_id").limit(per_class)
        chosen = one if chosen is None else chosen.unionByName(one)
    # At most 2 * per_class rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id")
    kind = docs.schema["doc_id"].dataType
    return rows.mapInArrow(work, T.StructType([
        T.StructField("doc_id", kind), T.StructField("quality", T.IntegerType()), T.StructField("found", T.BinaryType()),
    ]))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit the model on the sampled rows, in the order of their doc_id."""
    rows = training_rows(docs, labels, per_class).toArrow()
    rows = rows.take(pa.compute.sort_indices(rows, [("doc_id", "ascending"), ("found", "ascending")]))
    found = [np.frombuffer(b, np.int32) for b in rows.column("found").to_pylist()]
    return fit(found, rows.column("quality").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): 0 to 1, higher where label 1 is likelier; whole texts, null as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = pa.array([shared.value.score(t) for t in texts_of(batch)], pa.float64())
            yield pa.record_batch([batch.column("doc_id"), scores], ["doc_id", "score"])
        _codes.clear()

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(
        work, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
    )


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``.

    The model is fitted on a bounded sample of the labelled rows that are not held out
    (see ``training_rows``) and applied to every whole text; labels, language, source
    and doc_id play no part in a score. A null text counts as empty. Without rows of
    both labels every score is 1 (0 if only label 0 is known). A null doc_id is not
    held out. Other columns are ignored; an empty table gives an empty result.
    """
    scored = score(docs, learn(docs, labels, per_class))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, per_class))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [shared.value.score(t) >= threshold for t in texts_of(batch)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        _codes.clear()

    return docs.mapInArrow(work, docs.schema)
