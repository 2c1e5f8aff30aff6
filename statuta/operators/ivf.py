"""A stored vector index for exact cosine top-k: inverted lists around centroids, pruned by the triangle inequality of angles.

Every unit vector belongs to the list of its nearest centroid and keeps its angle to it. If a query lies at angle p to a
centroid, no vector at angle t is nearer to the query than |p - t|. So once the kth best of a query is at angle a, only the
ring p - a <= t <= p + a of each list can hold better ones. Lists are stored in ranges, sorted by list and angle, so a ring is
one slice of a batch and whole row groups are skipped by their statistics.

A search goes in two steps: a few nearest lists give each query a kth score, then the rings of all other lists are compared.
Nothing is missed, however vectors lie; how much is compared depends on how they cluster and is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.operators.ranking import first_k
from statuta.operators.retrieval import EQUAL, unit
from statuta.scratch import materialize, scratch_dir

#: Rows to which centroids are fitted, at most, and how many each gets at least.
SAMPLE, PER_LIST = 200_000, 39
#: Lists, at most: the square root of the rows up to there.
LISTS = 4096
#: Angles are compared with this to spare, more than rounding can move them.
SPARE = 1e-5
#: Queries that are asked at a time; their angles to all centroids are held.
BLOCK = 2000


@dataclass(frozen=True)
class VectorIndex:
    """vectors: the given columns, chunk_id and embedding among them, with list and angle. centroids: a unit row for each
    list. low, high: the angles in a list; sizes: its rows. A list more, the last, holds vectors of zeros."""

    vectors: DataFrame
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray


@dataclass(frozen=True)
class Found:
    """hits: query_id, chunk_id, score (cosine, 4 digits), rank. compared: query_id, compared (vectors it was compared with)."""

    hits: DataFrame
    compared: DataFrame


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means over unit rows; empty clusters take the rows that lie worst."""
    rng = np.random.default_rng(7)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near, best = _nearest_list(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centroids


def _nearest_list(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, best = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), 4096):
        cosine = x[i : i + 4096] @ centroids.T
        near[i : i + 4096] = cosine.argmax(1)
        best[i : i + 4096] = cosine.max(1)
    return near, best


def build_index(vectors: DataFrame, path: str | None = None, lists: int | None = None) -> VectorIndex:
    """``vectors`` (chunk_id, embedding, any others) stored below ``path``, a scratch folder if none is given. Rows of a null id or
    vector are left out. Centroids are fitted to a sample by a hash of the id, at most SAMPLE rows; every row is indexed."""
    spark = vectors.sparkSession
    path = path or scratch_dir(spark)
    rows = vectors.withColumn("embedding", F.col("embedding").cast("array<double>")).where("embedding IS NOT NULL AND chunk_id IS NOT NULL")
    n = rows.count()
    lists = max(1, min(lists or math.isqrt(n), LISTS))
    every = max(1, n // min(SAMPLE, max(1000, PER_LIST * lists)))
    sample = unit(rows.where(F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(every)) == 0).select("embedding").toArrow()["embedding"].combine_chunks())
    sample = sample[(sample != 0).any(1)]
    centroids = fit_centroids(sample, lists) if len(sample) else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast(centroids)
    kind = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    at = rows.columns.index("embedding")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(b.column(at))
            zero = ~(x != 0).any(1) if x.size else np.ones(len(x), bool)
            if len(sent.value):
                near, best = _nearest_list(x, sent.value)
            else:
                near, best = np.zeros(len(x), np.int64), np.zeros(len(x))
            near[zero] = len(sent.value)
            angle = np.where(zero, 0.0, np.arccos(np.clip(best, -1, 1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(angle)], names=kind.names)

    placed = rows.mapInArrow(place, kind).repartitionByRange("list", "angle").sortWithinPartitions("list", "angle")
    placed.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    edges = stored.groupBy("list").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("size"))
    table = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)] + [(len(centroids), [])]
    edges = edges.join(F.broadcast(spark.createDataFrame(table, "list int, centroid array<double>")), "list", "right")
    edges.coalesce(1).write.parquet(f"{path}/lists")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    lists = sorted(spark.read.parquet(f"{path}/lists").collect(), key=lambda r: r["list"])
    centroids = np.array([r.centroid for r in lists[:-1]]) if len(lists) > 1 else np.zeros((0, 1))
    low, high = (np.array([np.nan if r[c] is None else r[c] for r in lists]) for c in ("low", "high"))
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), centroids, low, high, np.array([r["size"] or 0 for r in lists]))


def _rings(index: VectorIndex, phi: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """phi: each query's angle to each centroid. reach: of each query -> for queries x lists the ring's angles and whether it holds any."""
    start, stop = phi - reach[:, None] - SPARE, phi + reach[:, None] + SPARE
    return start, stop, (stop >= index.low[:-1]) & (start <= index.high[:-1])


def _first_lists(index: VectorIndex, phi: np.ndarray, k: int) -> np.ndarray:
    """Queries x lists: the nearest ones, until they hold eight times k rows."""
    order = np.argsort(phi, axis=1, kind="stable")
    held = np.cumsum(index.sizes[:-1][order], axis=1)
    take = np.concatenate([np.ones((len(phi), min(1, phi.shape[1])), bool), held[:, :-1] < 8 * k], axis=1)
    out = np.zeros(phi.shape, bool)
    np.put_along_axis(out, order, take, 1)
    return out


def _compare(index: VectorIndex, rows: DataFrame, kind: T.StructType, ids: pa.Array, q: np.ndarray, asked: np.ndarray, start: np.ndarray, stop: np.ndarray, k: int) -> DataFrame:
    """Each batch's k best for queries that ask a list in it, and a row without a chunk for how many were compared."""
    queries, lists = np.nonzero(asked)
    by = np.lexsort((queries, lists))
    queries, lists = queries[by], lists[by]
    sent = rows.sparkSession.sparkContext.broadcast((ids, q, queries, lists, start[queries, lists], stop[queries, lists]))
    used = np.unique(lists)
    near = rows.where(F.col("list").between(int(used[0]), int(used[-1]))) if len(used) else rows.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, queries, lists, start, stop = sent.value
        for b in batches:
            b = b.take(pc.sort_indices(b, sort_keys=[("list", "ascending"), ("angle", "ascending")]))
            own, angle, x = b.column("list").to_numpy(), b.column("angle").to_numpy(), unit(b.column("embedding"))
            who, what, cosine, compared = [], [], [], np.zeros(len(q), np.int64)
            for one in np.unique(own):
                i, j = np.searchsorted(own, [one, one + 1])
                for at in range(*np.searchsorted(lists, [one, one + 1])):
                    a, z = i + np.searchsorted(angle[i:j], start[at]), i + np.searchsorted(angle[i:j], stop[at], side="right")
                    if z > a:
                        c = x[a:z] @ q[queries[at]]
                        compared[queries[at]] += z - a
                        if z - a > 4 * k:  # all that tie with the kth stay
                            keep = np.flatnonzero(np.round(c, EQUAL) >= np.round(np.partition(c, z - a - k)[z - a - k], EQUAL))
                        else:
                            keep = np.arange(z - a)
                        who.append(np.full(len(keep), queries[at]))
                        what.append(keep + a)
                        cosine.append(c[keep])
            none = np.flatnonzero(compared)
            who = pa.array(np.concatenate([*who, none]).astype(np.int64))
            what = pa.concat_arrays([b.column("chunk_id").take(pa.array(np.concatenate([*what, none[:0]]).astype(np.int64))), pa.nulls(len(none), b.column("chunk_id").type)])
            cosine = np.concatenate([*cosine, np.zeros(len(none))])
            counts = np.concatenate([np.zeros(len(cosine) - len(none), np.int64), compared[none]])
            yield pa.RecordBatch.from_arrays([ids.take(who), what, pa.array(cosine), pa.array(counts)], names=kind.names)

    return near.select("chunk_id", "embedding", "list", "angle").mapInArrow(run, kind)


def search_index(index: VectorIndex, queries: DataFrame, k: int, where: Column | None = None) -> Found:
    """``queries`` (query_id, vector) -> the k nearest by the cosine itself, ties by id. ``where`` filters the indexed vectors before
    the first k are taken. Null vectors aren't asked; vectors of zeros have cosine 0 with everything. Queries go out in blocks
    of about BLOCK, each written before the next."""
    rows = index.vectors if where is None else index.vectors.where(where)
    spark = rows.sparkSession
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("query_id IS NOT NULL AND vector IS NOT NULL")
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    kind = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("chunk_id", rows.schema["chunk_id"].dataType), T.StructField("exact", T.DoubleType()), T.StructField("compared", T.LongType())])
    parts = []
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        if not block.num_rows:
            continue
        ids, q = block["query_id"].combine_chunks(), unit(block["vector"].combine_chunks())
        phi = np.arccos(np.clip(q @ index.centroids.T, -1, 1)) if len(index.centroids) else np.zeros((len(q), 0))
        zeros = np.zeros((len(q), len(index.sizes)), bool)
        zeros[:, -1] = index.sizes[-1] > 0  # their cosine is 0, with no angle to prune by
        first = _first_lists(index, phi, k)
        wide = lambda x, last: np.concatenate([x, np.full((len(q), 1), last)], axis=1)
        everything = np.full(phi.shape, -1.0), np.full(phi.shape, 4.0)
        parts.append(materialize(_compare(index, rows, kind, ids, q, wide(first, False) | zeros, wide(everything[0], -1.0), wide(everything[1], 4.0), k)))
        best = first_k(parts[-1].where("chunk_id IS NOT NULL"), "query_id", [F.col("exact").desc()], k).where(F.col("rank") == k)
        kth = dict(best.select("query_id", "exact").toPandas().itertuples(index=False))  # a number for each query of the block
        reach = np.array([math.acos(max(-1.0, min(1.0, kth[x]))) if x in kth and (q[n] != 0).any() else math.pi for n, x in enumerate(ids.to_pylist())])
        start, stop, some = _rings(index, phi, reach)
        rest = some & ~first
        if rest.any():
            parts.append(materialize(_compare(index, rows, kind, ids, q, wide(rest, False), wide(start, 0.0), wide(stop, 0.0), k)))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)
    hits = first_k(found.where("chunk_id IS NOT NULL"), "query_id", [F.round("exact", EQUAL).desc(), F.col("chunk_id")], k)
    return Found(hits.select("query_id", "chunk_id", F.round("exact", 4).alias("score"), "rank"), found.groupBy("query_id").agg(F.sum("compared").alias("compared")))
