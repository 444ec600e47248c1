"""Class-weighted text classifier on IDF-weighted words."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer, RegexTokenizer, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline.functions import words as cutting
from vetline.operators.profile import class_weights, stop_words
from vetline.runtime import settle, stored


def with_class_weights(df: DataFrame, label: str = "fraudulent") -> DataFrame:
    """Add ``weight``, balanced over the whole table; sample afterwards.

    The weights travel as one map, so the texts are not shuffled. A classifier has few
    classes; rows without a label are left out.
    """
    weights = class_weights(df.where(F.col(label).isNotNull()), label)
    by_label = weights.agg(F.map_from_entries(F.collect_list(F.struct(label, "weight")))).scalar()
    return df.where(F.col(label).isNotNull()).withColumn("weight", F.try_element_at(by_label, F.col(label)))


def texts_having(df: DataFrame, text: str, part: str | None = None, parts: int = 0) -> DataFrame:
    """Rows (word, n_None, n_0 ..): how many texts have each word, in all and without each part.

    Words are counted batch by batch in Arrow, so a word is shuffled once for many texts.
    """
    left_out = [None, *range(parts)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in cutting.pieces(batches, text):
            every = np.ones(piece.num_rows, bool)
            groups = [every if i is None else pc.fill_null(pc.not_equal(piece.column(part), i), False)
                      .to_numpy(zero_copy_only=False) for i in left_out]
            found, counts = cutting.texts_having(piece.column(text), groups)
            yield pa.RecordBatch.from_arrays([found, *map(pa.array, counts)], ["word", *[f"n_{i}" for i in left_out]])

    schema = "word string, " + ", ".join(f"n_{i} bigint" for i in left_out)
    counted = df.select(text, *([part] if parts else [])).mapInArrow(work, schema)
    return counted.groupBy("word").agg(*[F.sum(f"n_{i}").alias(f"n_{i}") for i in left_out])


def vocabulary(having: DataFrame, n: str, size: int) -> list[str]:
    """The ``size`` words that most texts have by the counts ``n``, stop words aside, equal ones in alphabetical order.

    A bounded list; without any word one that no text has keeps the vectors from being empty.
    """
    counted = having.where((F.col(n) > 0) & ~F.col("word").isin(stop_words()))
    return [r["word"] for r in counted.orderBy(F.desc(n), "word").limit(size).collect()] or [" "]


def with_counts(df: DataFrame, text: str, listed: list[str], name: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``name``, the sparse vector of how often a text has each word listed."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(listed, pa.string())
        for piece in cutting.pieces(batches, text):
            counts = cutting.counts_of(piece.column(text), values)
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], counts], [*keep, name])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, VectorUDT())])
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(work, schema)


def fit_text_classifier(
    df: DataFrame, text: str = "text", label: str = "fraudulent", features: int = 512,
    iterations: int = 300, penalty: float = 0.01, counting: list[Transformer] | None = None,
) -> PipelineModel:
    """Fit on rows with ``text``, ``label`` and ``weight``, stored or otherwise cheap to read twice.

    The ``features`` words that most texts have, stop words aside, weighted by their inverse
    document frequency, each text's vector of length one; class-weighted logistic loss with an
    L2 penalty, taken to its only minimum. The texts are read for the words to count, then for
    their counts; only these, as sparse vectors, are kept for the passes of the fit. Stop words
    go once they are grouped, not text by text: what is not in the list is not counted anyway.
    Where the words were counted before (``count_words``), ``counting`` are the stages that give
    the counts ``_counts`` from ``df``.
    """
    if counting is None:
        listed = vocabulary(texts_having(df, text), "n_None", features)
        counting = [_tokenizer(text), CountVectorizerModel.from_vocabulary(listed, inputCol="_words", outputCol="_counts")]
        counted = with_counts(df, text, listed, "_counts", [label, "weight"])
    else:
        counted = PipelineModel(stages=counting).transform(df)
    rows = settle(counted.select(label, "weight", "_counts"))
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(rows)
    unit = Normalizer(inputCol="_idf", outputCol="_features", p=2.0)
    regression = LogisticRegression(
        featuresCol="_features", labelCol=label, weightCol="weight", maxIter=iterations, regParam=penalty, tol=1e-14,
        standardization=False, rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
    ).fit(unit.transform(idf.transform(rows)))
    return PipelineModel(stages=[*counting, idf, unit, regression])


def _tokenizer(text: str) -> RegexTokenizer:
    return RegexTokenizer(inputCol=text, outputCol="_words", pattern=cutting.PATTERN, gaps=False)


@dataclass
class Counted:
    """Texts whose words are counted once, for a model of all of them and models that leave a part out."""

    rows: DataFrame  # stored: all columns but the text, and _all, the counts of ``names``
    names: list[str]  # the words of all vocabularies
    vocabularies: dict[int | None, list[str]]  # by the part left out; None: of all rows
    words: RegexTokenizer  # what a word is

    def counting(self, left_out: int | None = None) -> list[Transformer]:
        """For ``fit_text_classifier`` over ``rows``: the counts of one vocabulary out of all."""
        place = {word: i for i, word in enumerate(self.names)}
        return [VectorSlicer(inputCol="_all", outputCol="_counts", indices=[place[w] for w in self.vocabularies[left_out]])]

    def for_texts(self, model: PipelineModel) -> PipelineModel:
        """A model of all ``rows`` as one that takes texts."""
        counts = CountVectorizerModel.from_vocabulary(self.vocabularies[None], inputCol="_words", outputCol="_counts")
        return PipelineModel(stages=[self.words, counts, *model.stages[1:]])


def count_words(df: DataFrame, part: str, parts: int, text: str = "text", features: int = 512) -> Counted:
    """Count the words of ``df`` for several models; ``part`` numbers the parts of its rows from 0.

    The texts are read twice, whatever the number of models: for the texts that have a word, in all and
    without each part, and for the counts of the words of all vocabularies. A vocabulary is the one that
    ``fit_text_classifier`` finds in the rows of the other parts.
    """
    found = stored(texts_having(df, text, part, parts), "words")
    vocabularies = {i: vocabulary(found, f"n_{i}", features) for i in (None, *range(parts))}
    names = sorted(set().union(*vocabularies.values()))
    rows = with_counts(df, text, names, "_all", [c for c in df.columns if c != text])
    return Counted(stored(rows, "counts"), names, vocabularies, _tokenizer(text))


def predict_proba(
    df: DataFrame, model: PipelineModel, name: str = "nlp_score", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all, if not given) and the probability of fraud.

    Words of texts are counted in Arrow; columns that are not kept, such as the text, do not come back from there.
    """
    keep, stages = df.columns if keep is None else keep, model.stages
    if isinstance(stages[0], RegexTokenizer) and stages[0].getPattern() == cutting.PATTERN:
        df = with_counts(df, stages[0].getInputCol(), stages[1].vocabulary, stages[1].getOutputCol(), keep)
        stages = stages[2:]
    scored = PipelineModel(stages=stages).transform(df)
    return scored.withColumn(name, vector_to_array("_probability")[1]).select(*keep, name)
