"""The registered queries of the training-data operators and their check SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from vetline.llm import (
    arrow_tokens, decontaminate, divergence, hard_negatives, hnsw, langid, lines, pieces, pii, quality, simhash, suffix,
    topk,
)
from vetline.llm.common import table
from vetline.runtime import fresh_path


def op1_decontamination(spark, sf_dir):
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "item_id", "n_shingles", "n_matched", (F.col("n_matched") / F.col("n_shingles")).alias("containment")
    )


def op2_arrow_tokens(spark, sf_dir, vocabulary=None):
    with open(vocabulary or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    folder = fresh_path(spark, "tokens")
    shards = arrow_tokens.write_tokens(table(spark, sf_dir, "documents"), text, 2, folder)
    return arrow_tokens.read_documents(shards, folder)


def op3_line_dedup(spark, sf_dir):
    marked = lines.mark_lines(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_sentencepiece(spark, sf_dir, model=None):
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    return pieces.check_documents(table(spark, sf_dir, "documents"), path)


def op8_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(found["fp"]).alias("fingerprint"), "component_id")


def op10_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_nearest(spark, sf_dir):
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_hard_negatives(spark, sf_dir):
    rows = hard_negatives.labelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_arrow_tokens": op2_arrow_tokens,
    "op3_line_dedup": op3_line_dedup,
    "op4_top_k": op4_top_k,
    "op5_language": op5_language,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_nearest": op11_nearest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op3_line_dedup": lines.ORACLE,
    "op4_top_k": topk.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
