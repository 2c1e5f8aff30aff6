import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.operators import ivf
from statuta.operators.retrieval import dense
from statuta.plans import index_queries


def frame(spark, x, labels=None):
    return spark.createDataFrame([(i, [float(c) for c in v], int(labels[i]) if labels is not None else i % 4) for i, v in enumerate(x)], "chunk_id long, embedding array<double>, label int")


def clusters(n, rng, centers=40, dims=16, spread=0.02):
    c = rng.standard_normal((centers, dims))
    return c[rng.integers(0, centers, n)] + spread * rng.standard_normal((n, dims))


def same(found, df, asked, k, where=None):
    want = sorted(map(tuple, dense(df, asked, k, where).collect()))
    assert sorted(map(tuple, found.hits.collect())) == want


@pytest.mark.parametrize("filtered", [False, True])
def test_exact_on_clusters_and_pruned(spark, filtered):
    rng = np.random.default_rng(2)
    compared, where = {}, F.col("label") == 1 if filtered else None
    for n in (500, 4000):
        df = frame(spark, clusters(n, rng))
        asked = df.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
        found = ivf.search_index(ivf.build_index(df), asked, 5, where)
        same(found, df, asked, 5, where)
        compared[n] = found.compared.agg(F.avg("compared")).first()[0] / (n if where is None else n / 4)
    # a smaller share of more rows
    assert compared[4000] < 0.1 and compared[4000] < compared[500]


def test_exact_without_clusters(spark):
    """Directions without any order, ties, zeros, equal vectors, several blocks of queries, queries of zeros and nulls."""
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((600, 6)), 1)
    x[rng.integers(0, 600, 60)] = 0
    x[rng.integers(0, 600, 80)] = x[5]
    df = frame(spark, x).unionByName(spark.createDataFrame([(None, [1.0] * 6, 1), (700, None, 1)], "chunk_id long, embedding array<double>, label int"))
    asked = df.where("chunk_id % 9 = 0 OR chunk_id = 700").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = asked.unionByName(spark.createDataFrame([(900, [0.0] * 6), (901, None)], "query_id long, vector array<double>"))
    index = ivf.build_index(df, lists=12)
    same(ivf.search_index(index, asked, 7), df, asked, 7)
    same(ivf.search_index(index, asked, 1000), df, asked, 1000)


def test_blocks_of_queries(spark, monkeypatch):
    df = frame(spark, clusters(300, np.random.default_rng(5)))
    asked = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    monkeypatch.setattr(ivf, "BLOCK", 64)
    same(ivf.search_index(ivf.build_index(df), asked, 3), df, asked, 3)


def test_small_and_empty(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>, label int")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert ivf.search_index(ivf.build_index(none), asked, 3).hits.count() == 0
    one = spark.createDataFrame([(4, [0.0, 2.0], 1)], "chunk_id long, embedding array<double>, label int")
    assert [tuple(r) for r in ivf.search_index(ivf.build_index(one), asked, 3).hits.collect()] == [(1, 4, 0.0, 1)]
    assert ivf.search_index(ivf.build_index(one), asked.limit(0), 3).hits.count() == 0


def test_stored_once_and_read_again(spark, tmp_path):
    df = frame(spark, clusters(400, np.random.default_rng(6)))
    asked = df.where("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    ivf.build_index(df, str(tmp_path))
    index = ivf.read_index(spark, str(tmp_path))
    same(ivf.search_index(index, asked, 3), df, asked, 3)
    assert index.sizes.sum() == 400 and {"label", "list", "angle"} <= set(index.vectors.columns)


def test_texts_are_passed_over(spark, data):
    rows = index_queries._profiles(spark, data)
    asked = rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = ivf.search_index(ivf.build_index(rows), asked, 5)
    assert found.compared.agg(F.avg("compared")).first()[0] < 0.6 * rows.count()
