"""From raw documents to token ids: five stages, each written and read again.

``run(spark, sf_dir)`` reads documents, labels and benchmark below ``sf_dir``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm import decontaminate, lines, pieces, quality, simhash
from vetline.llm.common import free_names, stored, table
from vetline.runtime import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a line found on ten sites or more stays at its first place only."""
    return lines.drop_lines(docs, min_sites=10)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose fingerprints (four-word shingles) link at four or fewer bits."""
    ship(spark)
    return simhash.keep_one(docs, words=4, distance=4)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 or more of its five-word shingles)."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids in place of the text; ``round_trip`` tells whether these decode to it."""
    ship(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    mark, text = free_names([*docs.columns, "n_pieces", "ids", "round_trip"], "mark", "decoded")
    marked = docs.withColumn(mark, F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    # Written in between: in one go every task would have two Python workers, and the executor would keep them all.
    encoded = stored(pieces.encode_documents(marked, model), "pieces")
    decoded = pieces.decode_documents(encoded, model, "ids", text, keep=True)
    return decoded.withColumn("round_trip", F.crc32(F.col(text).cast("binary")) == F.col(mark)).drop(mark, text)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_shared_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", uncontaminated),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Hinge loss, fingerprints and merges are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other stage is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
