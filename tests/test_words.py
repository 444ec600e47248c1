"""Words counted in Arrow batches are those that Spark's own tokenizer and counter give."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from vetline.functions import words
from vetline.operators import classifier, fusion
from vetline.plans.postings import RULES, postings_of

ODD = ["", " ", "a", "A-b_c", "end", "start of the next", "ΟΔΟΣ ΣΑΣ Σ", "İstanbul IŞIK", "x²+½=Ⅷ", "日本語テキスト、漢字", "näive é",
       "𝒳𝟘 𐐀 😀😀", "\u0000null\u0000", "line\nbreak\r\ntab\tnbsp em ", "ÀÉÎ straße ẞ ǅ", "٣٤ १२ ๕", "ªº µ", "the the THE", "﻿bom", "１２３ＡＢＣ", "ﬁne", "ʰʱ ໐ ᛮ", "-"]


def spark_words(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["_words"] for r in classifier._tokenizer("text").transform(df).orderBy("id").collect()]


def test_words_are_those_of_the_tokenizer(spark):
    number, found = words.cut(pa.array(ODD))
    cut = [[w for n, w in zip(number, found.to_pylist()) if n == i] for i in range(len(ODD))]
    assert cut == spark_words(spark, ODD)
    every = [chr(c) for block in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10600)) for c in range(*block)]
    number, found = words.cut(pa.array(every))
    cut = dict(zip(number.tolist(), found.to_pylist()))
    kind = spark._jvm.java.lang.Character.getType
    for i, own in enumerate(spark_words(spark, every)):
        # Only characters that this Java does not know yet may differ: it takes them for no letters.
        if own != ([cut[i]] if i in cut else []):
            assert any(kind(ord(c)) == 0 for c in every[i] + cut.get(i, ""))
    assert words.cut(pa.array([None, "a", None], pa.string()))[1].to_pylist() == ["a"]
    assert len(words.cut(pa.array([], pa.string()))[1]) == 0


def test_pieces_hold_every_text_once():
    batch = pa.record_batch([pa.array(range(50)), pa.array(["w" * (i * 37 % 11) for i in range(50)])], ["id", "text"])
    for size in (1, 7, 40, 10_000):
        cut = list(words.pieces([batch], "text", size))
        assert [x for p in cut for x in p.column("id").to_pylist()] == list(range(50))
        assert all(p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= size for p in cut)


def test_counts_are_those_of_the_counter(spark):
    df = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(ODD * 3)], "id int, fold int, text string")
    listed = ["the", "a", "日本語テキスト", "123", "οδος", "absent"]
    old = CountVectorizerModel.from_vocabulary(listed, inputCol="_words", outputCol="v").transform(
        classifier._tokenizer("text").transform(df))
    new = classifier.with_counts(df, "text", listed, "v", ["id"])
    assert [tuple(r) for r in new.orderBy("id").collect()] == [tuple(r) for r in old.select("id", "v").orderBy("id").collect()]
    having = {r.word: (r.n_None, r.n_0, r.n_1, r.n_2) for r in classifier.texts_having(df, "text", "fold", 3).collect()}
    expected = [Counter() for _ in range(4)]
    for i, found in enumerate(spark_words(spark, ODD * 3)):
        for k, counter in enumerate(expected):
            counter.update(set(found) if k == 0 or i % 3 != k - 1 else ())
    assert having == {w: tuple(c[w] for c in expected) for w in expected[0]}


def test_a_fold_that_is_null_is_in_no_group_without_a_fold(spark):
    df = spark.createDataFrame([(None, "a b"), (0, "a"), (1, "b b")], "fold int, text string")
    assert {tuple(r) for r in classifier.texts_having(df, "text", "fold", 2).collect()} == {("a", 2, 0, 1), ("b", 2, 1, 0)}


def test_texts_are_not_cut_word_by_word_into_rows(spark):
    """No row per word and text is made, and a text goes to the workers that count its words and nowhere else."""
    rows = spark.range(60).select(
        F.col("id").alias("job_id"), (F.col("id") % 2).cast("int").alias("fraudulent"), F.lit(1.0).alias("weight"),
        F.lit(0).alias("fold"), F.concat(F.lit("word money "), F.col("id") % 5).alias("text"))
    plan = classifier.texts_having(rows, "text", "fold", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "UDF" not in plan
    model = classifier.fit_text_classifier(rows)
    scored = classifier.predict_proba(rows, model, keep=["job_id"])
    assert scored.columns == ["job_id", "nlp_score"]
    assert "_words" not in scored._jdf.queryExecution().optimizedPlan().toString()
    p = [r.nlp_score for r in scored.orderBy("job_id").collect()]
    plain = model.transform(rows).orderBy("job_id").collect()
    assert p == [float(r["_probability"][1]) for r in plain]
    assert np.isfinite(p).all() and fusion.out_of_fold_scores(rows.withColumn("fold", (F.col("job_id") % 4 < 2).cast("int")), "job_id").count() == 60


def test_title_is_the_first_line_without_cutting_all_lines(spark):
    texts = ["", "\n", "a\nb\nc", "\n\nx", "no line feed", "é\r\nü", None, "日本\n語"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_chars", F.lit(5))
    titles = postings_of(documents, None).select("job_id", "title")
    assert "split" not in titles._jdf.queryExecution().optimizedPlan().toString().lower()
    expected = documents.alias("d").select("doc_id", F.expr(RULES["title"]))
    assert sorted(map(tuple, titles.collect())) == sorted(map(tuple, expected.collect()))
