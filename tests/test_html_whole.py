from pyspark.sql import functions as F

from statuta.functions import text


def test_strip_html_keeps_the_whole_text(spark):
    df = spark.createDataFrame([("<p>" + "a b " * 5000 + "end</p>",)], "html string")
    got = df.select(text.strip_html(F.col("html")).alias("all"), text.strip_html(F.col("html"), 10).alias("cut")).first()
    assert got["all"] == "a b " * 5000 + "end" and got["cut"] == ("a b " * 5)[:10]
