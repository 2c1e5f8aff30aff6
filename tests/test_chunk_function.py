from pyspark.sql import functions as F

from statuta.operators import chunking


def test_table_function_gives_the_operators_rows(spark):
    texts = [None, "", "  \n ", "short", "word " * 900, "A sentence here. " * 300, ("para\n\n" + "x" * 700) * 5, "é" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    chunking.register_chunks(spark)
    for tokens, overlap in ((512, 51), (64, 8)):
        want = chunking.chunk_text(docs, "doc_id", "text", tokens, overlap).select("doc_id", "chunk_index", "total_chunks", "chunk_text", "token_estimate")
        got = spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL chunk(d.text, {tokens}, {overlap}) c", docs=docs)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10
    assert spark.sql("SELECT count(*) AS n FROM {docs} d, LATERAL chunk(d.text) c", docs=docs.where(F.col("doc_id") < 3)).first().n == 0
