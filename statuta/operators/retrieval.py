"""Hybrid retrieval for tables of queries: BM25 by the stored index, cosine top-k, reciprocal rank fusion, reranking."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.operators.bm25 import Bm25Index, append_bm25, bm25, build_bm25, read_bm25, search_bm25, term_counts  # noqa: F401
from statuta.operators.ranking import first_k
from statuta.scratch import materialize

#: Query vectors that are broadcast at a time.
QUERY_BLOCK = 10_000
#: Scores that differ less are ties: sums in another order may differ in the last digits.
EQUAL = 12


def dense(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """``vectors`` (chunk_id, embedding), ``queries`` (query_id, vector) -> query_id, chunk_id, score (cosine, 4 digits), rank.

    Ranked by the cosine itself, ties by id. A filter on the vectors applies before the first k are taken. Queries go out in
    blocks of about QUERY_BLOCK, dealt by a hash of the id, each a scan of the vectors by matrix products; only the first k
    of a query and batch are shuffled. Null vectors are left out, a zero vector has cosine 0.
    """
    rows = (vectors if where is None else vectors.where(where)).select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("embedding").isNotNull() & F.col("chunk_id").isNotNull())
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("query_id is not null and vector is not null")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    kind = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("chunk_id", rows.schema["chunk_id"].dataType), T.StructField("exact", T.DoubleType())])
    parts = []
    for b in range(blocks):
        block = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        if block.num_rows:
            parts.append(rows.mapInArrow(_nearest(rows.sparkSession.sparkContext.broadcast(block), k), kind))
    if not parts:
        return rows.sparkSession.createDataFrame([], kind).select("query_id", "chunk_id", F.col("exact").alias("score"), F.lit(1).alias("rank"))
    found = first_k(reduce(DataFrame.unionByName, parts), "query_id", [F.round("exact", EQUAL).desc(), F.col("chunk_id")], k)
    return found.select("query_id", "chunk_id", F.round("exact", 4).alias("score"), "rank")


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column, of length one; zero rows stay zero."""
    x = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    x = x.reshape(len(column), len(x) // max(1, len(column)))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _nearest(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value["query_id"].combine_chunks(), unit(sent.value["vector"].combine_chunks())
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.slice(at, 4096)
                own = own.take(pc.sort_indices(own.column(0)))  # ties go to the smaller id
                v = unit(own.column(1))
                for i in range(0, len(q), 256):
                    cosine = q[i : i + 256] @ v.T
                    near = np.argsort(-np.round(cosine, EQUAL), axis=1, kind="stable")[:, :k]
                    who = pa.array(np.repeat(np.arange(i, i + len(near)), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([ids.take(who), own.column(0).take(pa.array(near.ravel())), pa.array(np.take_along_axis(cosine, near, 1).ravel())], names=["query_id", "chunk_id", "exact"])

    return run


def fuse(legs: list[tuple[str, float, DataFrame]], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked (query_id, chunk_id, rank) lists: sum of weight / (constant + rank).

    Ordered by the sum itself, shown with 6 digits; ties keep the order of the legs: by rank in the first, then in the next.
    """
    rows = None
    for name, weight, leg in legs:
        part = leg.select("query_id", "chunk_id", (F.lit(weight) / (constant + F.col("rank"))).alias("part"), *[(F.col("rank") if n == name else F.lit(None).cast("int")).alias(f"{n}_rank") for n, _, _ in legs])
        rows = part if rows is None else rows.unionByName(part)
    ranks = [f"{n}_rank" for n, _, _ in legs]
    total = rows.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), *[F.min(r).alias(r) for r in ranks])
    order = [F.round("score", EQUAL).desc(), *[F.col(r).asc_nulls_last() for r in ranks], F.col("chunk_id")]
    return first_k(total, "query_id", order, k).withColumn("score", F.round("score", 6))


def rerank(hits: DataFrame, model, k: int) -> DataFrame:
    """``hits`` (query_id, query, chunk_id, text, rank) by ``model``, a pandas UDF (query, text) -> double.

    Where the model gives no score (null: it failed), hits keep the order that they have, after the scored ones.
    """
    before = [F.col("rank")] if "rank" in hits.columns else []
    scored = hits.withColumn("score", model("query", "text"))
    return first_k(scored, "query_id", [F.col("score").desc_nulls_last(), *before, F.col("chunk_id")], k)


def _attempt(name: str, build: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return materialize(build())
    except Exception as e:  # whatever a leg raises, the other goes on
        warnings.warn(f"the {name} leg failed: {e}", stacklevel=3)
        return None


def retrieve(index: Bm25Index, vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, texts: DataFrame | None = None, model=None, lenient: bool = False) -> DataFrame:
    """The whole retrieval: ``queries`` (query_id, text, vector) -> query_id, chunk_id, score, rank.

    Both legs give 3 k candidates, fused with weights 0.6 (dense) and 0.4 (sparse), then cut at k or, with ``texts``
    (chunk_id, text) and ``model``, reranked. ``where``: a filter on ``vectors``' columns that both legs keep; a query
    without a vector has its sparse leg alone. ``lenient``: both legs are written first, and one that fails is left out with a
    warning; an error only if both do.
    """
    allowed = None if where is None else vectors.where(where).select(F.col("chunk_id").alias("doc_id"))
    legs = {
        ("dense", 0.6): lambda: dense(vectors, queries.select("query_id", "vector"), 3 * k, where),
        ("sparse", 0.4): lambda: search_bm25(index, queries.select("query_id", "text"), 3 * k, allowed).withColumnRenamed("doc_id", "chunk_id"),
    }
    found = [(*leg, rows) for leg, build in legs.items() if (rows := _attempt(leg[0], build) if lenient else build()) is not None]
    if not found:
        raise ValueError("both legs of the retrieval failed")
    fused = fuse(found, k if model is None else 6 * k)
    if model is not None:
        asked = queries.select("query_id", F.col("text").alias("query"))
        fused = rerank(fused.join(asked, "query_id").join(texts.select("chunk_id", "text"), "chunk_id"), model, k)
    return fused.select("query_id", "chunk_id", "score", "rank")


def merge_ranked(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """Ranked (query_id, key, rank) lists one after the other, first of each key, at most k a query: query_id, key, rank."""
    rows = None
    for i, df in enumerate(lists):
        part = df.select("query_id", key, F.lit(i).alias("list"), F.col("rank").alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("query_id", key).agg(F.min(F.struct("list", "place")).alias("at"))
    return first_k(first, "query_id", [F.col("at.list"), F.col("at.place"), F.col(key)], k).select("query_id", key, "rank")
