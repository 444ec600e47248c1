"""What the text model reads and keeps, so that it grows with the texts only once."""

from pyspark.sql import functions as F

from vetline.operators import classifier, fusion
from vetline.plans import services


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_texts(spark):
    return spark.range(80).select(
        F.col("id").alias("job_id"), (F.col("id") % 2).cast("int").alias("fraudulent"), F.lit(1.0).alias("weight"),
        F.when(F.col("id") % 2 == 0, "The GOOD job, and the pay").otherwise("wire money, the job").alias("text"))


def test_fit_keeps_counts_but_no_words(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(classifier, "settle", lambda df: kept.append(df.columns) or df.localCheckpoint())
    model = classifier.fit_text_classifier(some_texts(spark))
    assert not any("_words" in columns or "_tokens" in columns for columns in kept)
    # Stop words ("the", "and") and repeats within a text count for nothing; ties are in alphabetical order.
    counts = next(s for s in model.stages if hasattr(s, "vocabulary"))
    assert counts.vocabulary == ["job", "good", "money", "pay", "wire"]
    scored = classifier.predict_proba(some_texts(spark), model)
    assert scored.where((F.col("nlp_score") > 0.5) != (F.col("fraudulent") == 1)).isEmpty()


def test_folds_are_joined_once(spark, monkeypatch):
    plans, fit = [], fusion.fit_text_classifier
    monkeypatch.setattr(fusion, "fit_text_classifier", lambda df, **k: plans.append(plan_of(df)) or fit(df, **k))
    assert fusion.out_of_fold_scores(some_texts(spark), "job_id").count() == 80
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)


def test_texts_are_joined_once(spark, monkeypatch):
    plans, fit = [], classifier.fit_text_classifier
    monkeypatch.setattr(classifier, "fit_text_classifier", lambda df, **k: plans.append(plan_of(df)) or fit(df, **k))
    for query in (services.text_classifier, services.text_scores):
        plans.append(plan_of(query(spark, "/root/testdata/sf0.001")))
    assert len(plans) == 4 and not any("Join" in plan for plan in plans)


def test_words_are_counted_once_for_all_models(spark, monkeypatch):
    """Two tokenizing passes over the texts, whatever the number of folds; each model's words are those it would find."""
    texts = some_texts(spark).withColumn("fold", (F.col("job_id") % 3 == 0).cast("int")).withColumn(
        "text", F.when(F.col("job_id") % 9 == 0, "only here").otherwise(F.col("text")))
    passes, tokenizer = [], classifier._tokenizer
    monkeypatch.setattr(classifier, "_tokenizer", lambda text: passes.append(text) or tokenizer(text))
    counted = fusion.count_by_fold(texts, "job_id")
    assert len(passes) == 1 and "text" not in counted.rows.columns and "_words" not in counted.rows.columns
    for left_out in (None, 0, 1):
        rows = texts if left_out is None else texts.where(F.col("fold") != left_out)
        own = classifier.fit_text_classifier(rows)
        picked = counted.rows if left_out is None else counted.rows.where(F.col("fold") != left_out)
        fitted = classifier.fit_text_classifier(picked, counting=counted.counting(left_out))
        assert counted.vocabularies[left_out] == own.stages[1].vocabulary
        assert abs(fitted.stages[-1].intercept - own.stages[-1].intercept) < 1e-6
    whole = counted.for_texts(classifier.fit_text_classifier(counted.rows, counting=counted.counting()))
    a, b = (classifier.predict_proba(texts, m).orderBy("job_id").collect() for m in (whole, classifier.fit_text_classifier(texts)))
    assert all(abs(x.nlp_score - y.nlp_score) < 1e-6 for x, y in zip(a, b))
    assert fusion.out_of_fold_scores(texts, "job_id", counted=counted).count() == 80
