"""Registered queries over stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import ivf
from statuta.plans import corpus
from statuta.plans.queries import _dense_sql, _vectors
from statuta.plans.registry import query

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(_dense_sql("true", 10))
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors' exact neighbours by way of the stored index."""
    rows, asked = _vectors(spark, sf_dir)
    return ivf.search_index(ivf.build_index(rows), asked, 10).hits


@query(_dense_sql("v.label = 3", 5))
def ivf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _vectors(spark, sf_dir)
    return ivf.search_index(ivf.build_index(rows), asked, 5, F.col("label") == 3).hits


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("text")
    counts = F.transform(F.array(*map(F.lit, LETTERS)), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    return corpus.read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), counts.alias("embedding"))


@query(f"""WITH v AS (SELECT doc_id, list_transform(string_split('{LETTERS}', ''), lambda c: CAST(length(lower(text)) - length(replace(lower(text), c, '')) AS DOUBLE)) AS x FROM documents WHERE text IS NOT NULL),
  n AS (SELECT doc_id, x, sqrt(list_inner_product(x, x)) AS r FROM v)
  SELECT q.doc_id AS query_id, v.doc_id AS chunk_id, round(c, 4) AS score, CAST(row_number() OVER (PARTITION BY q.doc_id ORDER BY round(c, 12) DESC, v.doc_id) AS INT) AS rank
  FROM n q, n v, LATERAL (SELECT CASE WHEN q.r * v.r = 0 THEN 0.0 ELSE list_inner_product(q.x, v.x) / (q.r * v.r) END AS c) WHERE q.doc_id % 100 = 0 QUALIFY rank <= 5""")
def letter_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the most alike numbers of letters: vectors that cluster by language, so that most lists are passed over."""
    rows = _profiles(spark, sf_dir)
    asked = rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ivf.search_index(ivf.build_index(rows), asked, 5).hits
