import pytest
from pyspark.sql import functions as F

from statuta.operators import retrieval


def test_a_failing_leg_leaves_the_other(spark):
    docs = spark.createDataFrame([(i, f"rule w{i} data") for i in range(12)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(12)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "w3 w5", [1.0, 3.0])], "query_id long, text string, vector array<double>")
    index = retrieval.build_bm25(docs)
    broken = vectors.withColumn("embedding", F.when(F.raise_error(F.lit("no vectors")).isNull(), F.col("embedding")))
    with pytest.warns(UserWarning, match="dense leg"):
        got = retrieval.retrieve(index, broken, asked, 2, lenient=True).orderBy("rank").collect()
    assert {r.chunk_id for r in got} == {3, 5} and [round(r.score, 6) for r in got] == [round(0.4 / 61, 6), round(0.4 / 62, 6)]
    with pytest.raises(Exception, match="no vectors"):
        retrieval.retrieve(index, broken, asked, 2).collect()
    both = retrieval.retrieve(index, vectors, asked, 3, lenient=True).collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, retrieval.retrieve(index, vectors, asked, 3).collect()))
    gone = asked.withColumn("text", F.when(F.raise_error(F.lit("no texts")).isNull(), F.col("text")))
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        retrieval.retrieve(index, broken, gone, 2, lenient=True)
