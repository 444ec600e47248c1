from pyspark.sql import functions as F

from vetline import schema
from vetline.operators import iforest
from vetline.operators.encode import encode_features
from vetline.plans import services
from vetline.sources import files, pages
from vetline.streaming.scoring import landed_postings, score_postings, write_scored

TEXT = 'He said "hi, there"\nsecond line, with comma \r\n third'


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(TEXT, " DE , BE", "NA"), ("plain", None, "null"), ("x", "", " ")], "description string, location string, title string")
    files.write_csv(df, str(tmp_path / "csv"))
    got = {r.description: (r.location, r.title) for r in files.read_csv(spark, str(tmp_path / "csv")).collect()}
    assert got == {TEXT: (" DE , BE", None), "plain": (None, None), "x": (None, " ")}


def test_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(TEXT, 1)], "description string, n int")
    files.write_table(df, str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t")).collect() == df.collect()


def test_stream_scores_like_the_batch(spark, tmp_path):
    train = spark.range(300).select(
        F.col("id"), (40000.0 + (F.col("id") % 50) * 500).alias("salary_processed"),
        (F.col("id") % 4).alias("employment_type"), (F.col("id") % 2).alias("has_company_logo"),
        (F.col("id") % 9).alias("required_education"))
    model = iforest.fit_forest(train, "id", trees=20, sample=64)
    raw = spark.range(60).select(*[
        {"title": F.concat(F.lit("job "), F.col("id").cast("string")),
         "salary_range": F.concat((F.col("id") * 1000).cast("string"), F.lit("-"), (F.col("id") * 2000).cast("string")),
         "description": F.lit(TEXT), "has_company_logo": F.lit("t")}.get(c, F.lit(None).cast("string")).alias(c)
        for c in schema.RAW_COLUMNS])
    files.write_csv(raw.repartition(3), str(tmp_path / "landed"))
    scored = score_postings(landed_postings(spark, str(tmp_path / "landed")), model, ["title"])
    assert scored.isStreaming
    write_scored(scored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = score_postings(files.read_csv(spark, str(tmp_path / "landed")), model, ["title"])
    out = files.read_table(spark, str(tmp_path / "out"))
    assert out.count() == 60 and out.exceptAll(batch).count() == 0
    # A restart finds nothing new.
    write_scored(scored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert files.read_table(spark, str(tmp_path / "out")).count() == 60


def test_pages(spark):
    df = spark.createDataFrame([
        (1, "<html><title>A &amp; B</title><script>x='<p>'</script><body><p>Pay&nbsp;10 &lt; 20</p><!-- no --></body>"),
        (2, "just text"), (3, None)], "page_id int, html string")
    got = {r.job_id: (r.title, r.description) for r in pages.pages_to_postings(df).collect()}
    assert got == {1: ("A & B", "Pay 10 < 20"), 2: (None, "just text"), 3: (None, None)}
    assert encode_features(pages.pages_to_postings(df), keep=["job_id"]).count() == 3


def test_stream_reads_a_file_or_a_folder(spark, tmp_path):
    """documents.parquet as one file and as a folder of files gives the same rows; other tables are left out."""
    docs = spark.range(20).selectExpr("id AS doc_id", "'a text' AS text", "'en' AS lang", "'web' AS source", "id * 7 AS n_chars")
    (tmp_path / "folder").mkdir()
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "folder" / "documents.parquet2"))
    (tmp_path / "file").mkdir()
    docs.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    whole, single = (services.stream_encoded_postings(spark, str(tmp_path / d)) for d in ("folder", "file"))
    assert whole.count() == single.count() == 20
    assert whole.exceptAll(single).count() == 0
