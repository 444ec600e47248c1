from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from vetline import schema
from vetline.functions import text
from vetline.operators import profile


def test_the_list_is_spark_mls(spark):
    assert sorted(schema.STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_parts_of_contractions_are_not_counted(spark):
    df = spark.createDataFrame([("It's yours, don't cannot ought himself isn't payroll",)], "description string")
    words = {r.word for r in profile.top_words(df, text.clean_eda(F.col("description"))).collect()}
    assert "payroll" in words and not words & {"it", "s", "t", "don", "cannot", "ought", "himself"}
