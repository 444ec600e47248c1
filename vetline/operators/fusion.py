"""Fusing the text and the metadata score into one, with attributions."""

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.functions import text
from vetline.operators.boosting import Boosted, fit_boosted, load_boosted, save_boosted, score_boosted
from vetline.operators.classifier import Counted, count_words, fit_text_classifier, predict_proba
from vetline.operators.clean import clean_postings
from vetline.operators.encode import encode_features
from vetline.operators.iforest import Forest, score_outliers
from vetline.operators.sampling import stratified_folds
from vetline.runtime import current_version, publish, settle, side_by_side, stored_at, version_folder

META_FEATURES = ["nlp_score", "outlier_score", "desc_len", "has_company_logo", "telecommuting", "has_questions"]
NLP_DIGITS = 3  # of the text score as a meta-feature: it is cut into bins anyway


def meta_features(
    clean: DataFrame, classifier: PipelineModel | None, forest: Forest | None, keep: list[str],
    text_scores: DataFrame | None = None,
) -> DataFrame:
    """Both scores and the plain signals of each cleaned posting, on one row.

    The text score comes from the ``classifier``, or from ``text_scores`` (first column of
    ``keep``, nlp_score) where given.
    """
    own = ["desc_len", "telecommuting", "has_questions"]
    if text_scores is None:
        # Scored first, so that the texts do not go through the forest as well.
        texts = clean.withColumn("text", text.raw_full_text())
        encoded = encode_features(texts, keep=[*keep, *own, "text"])
        encoded = predict_proba(encoded, classifier, keep=[c for c in encoded.columns if c != "text"])
    else:
        encoded = encode_features(clean, keep=[*keep, *own])
    scored = score_outliers(encoded, forest, "fraud").withColumnRenamed("anomaly_score", "outlier_score")
    if text_scores is not None:
        scored = scored.join(text_scores, keep[0])
    scored = scored.withColumn("nlp_score", F.round("nlp_score", NLP_DIGITS))
    return scored.select(*keep, *[F.col(c).cast("double").alias(c) for c in META_FEATURES])


FOLDS = 2  # of the text scores that the fusion is trained on


def count_by_fold(texts: DataFrame, key: str, label: str = "fraudulent", k: int = FOLDS, seed: int = 42) -> Counted:
    """The words of texts (key, label, weight and text), counted once for a model of all and one without each fold.

    Folds that the texts bring along (``stratified_folds``) need no join.
    """
    if "fold" not in texts.columns:
        narrow = settle(stratified_folds(settle(texts.select(key, label)), key, label, k, seed).select(key, "fold"))
        texts = texts.join(narrow, key)
    return count_words(texts.select(key, label, "weight", "fold", "text"), "fold", k)


def out_of_fold_scores(
    texts: DataFrame, key: str, label: str = "fraudulent", k: int = FOLDS, seed: int = 42, counted: Counted | None = None,
) -> DataFrame:
    """Rows (key, nlp_score): each scored by a text model that was fitted without its fold.

    ``texts`` has key, label, weight and text; where their words were counted before
    (``count_by_fold``), they are not read. Scores of rows a model was fitted on would
    make it look better to the fusion than it is on new rows.
    """
    counted = counted or count_by_fold(texts, key, label, k, seed)
    rows = counted.rows

    def one(i: int) -> DataFrame:
        model = fit_text_classifier(rows.where(F.col("fold") != i), label=label, counting=counted.counting(i))
        return predict_proba(rows.where(F.col("fold") == i), model).select(key, "nlp_score")

    return reduce(DataFrame.union, side_by_side(texts.sparkSession, one, list(range(k))))


def fit_fusion(meta: DataFrame, label: str = "fraudulent", rounds: int = 10, depth: int = 3) -> Boosted:
    """Gradient-boosted trees over the meta-features."""
    return fit_boosted(meta, META_FEATURES, label, rounds, depth)


def score_fusion(meta: DataFrame, fusion: Boosted, key: str, cutoff: float = 0.5) -> DataFrame:
    """Columns key, ``fraud_score``, ``label``, ``shap_values``; one row for each of ``meta``, whatever its key.

    The attributions are exact Shapley values of the log-odds against the training means,
    taken from the paths of the trees.
    """
    scored = score_boosted(meta.select(key, *META_FEATURES), fusion)
    probability = 1.0 / (1.0 + F.exp(-F.col("margin")))
    pairs = [x for i, c in enumerate(META_FEATURES) for x in (F.lit(c), F.get("shares", F.lit(i)))]
    return scored.select(key, probability.alias("fraud_score"), F.create_map(*pairs).alias("shap_values")).select(
        key, "fraud_score",
        F.when(F.col("fraud_score") >= cutoff, "Fraudulent").otherwise("Legitimate").alias("label"), "shap_values")


def score_end_to_end(
    raw: DataFrame, classifier: PipelineModel, forest: Forest | None, fusion: Boosted, key: str
) -> DataFrame:
    """Raw postings to the fused result."""
    clean = clean_postings(raw, dedupe=False)
    return score_fusion(meta_features(clean, classifier, forest, [key]), fusion, key)


# --- storage --------------------------------------------------------------


def save_scorer(spark: SparkSession, classifier: PipelineModel, fusion: Boosted, path: str) -> None:
    """Store the text model and the fusion as one new version of ``path``."""
    folder = version_folder(path)
    classifier.write().save(f"{folder}/text")
    save_boosted(spark, fusion, f"{folder}/fusion")
    publish(spark, path, folder)


def load_scorer(spark: SparkSession, path: str) -> tuple[PipelineModel, Boosted] | None:
    """The current text model and fusion; None where either is missing or unreadable."""
    folder = current_version(spark, path)
    if folder is None or not stored_at(spark, f"{folder}/text/metadata"):
        return None
    fusion = load_boosted(spark, f"{folder}/fusion")
    return fusion and (PipelineModel.load(f"{folder}/text"), fusion)
