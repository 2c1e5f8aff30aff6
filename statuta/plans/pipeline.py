"""The batch pipeline over landed frames: merge, check, deduplicate and version, tag, store regulations, chunks, vectors and a health row."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta import schema
from statuta.functions.tagging import tag_regulations
from statuta.operators import chunking, dedup, embedding, quality, store
from statuta.scratch import materialize
from statuta.sources import readers, records

from . import views

VECTORS = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def as_landed(regs: DataFrame) -> DataFrame:
    """Mapped regulations with the time that landed rows carry."""
    return regs.withColumn("ingested_at", F.lit("2024-01-30").cast("timestamp"))


def table(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """What is stored at a path; an empty table if nothing is."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    # without the columns by which it is partitioned, unless they are asked for
    return spark.read.schema(kind).parquet(path).select(*kind.fieldNames()) if there else spark.createDataFrame([], kind)


def _bucketed(kind: T.StructType) -> T.StructType:
    return T.StructType([*kind.fields, T.StructField("bucket", T.IntegerType())])


def run(
    spark: SparkSession, frames: list[DataFrame], warehouse: str, order: str = "doc_id", check: bool = True, blocks: DataFrame | None = None,
    model: Callable[[list[str]], list[list[float]]] | None = None, source: str = "merged", lost: dict[str, str] | None = None, fetched: DataFrame | None = None,
) -> dict[str, int]:
    """One run; returns counts. What is stored is only appended to: known texts are dropped and amended regulations get new versions,
    so a new row's key is never there yet.

    ``blocks`` (regulation_id, block_idx, text, ...): structural blocks of some regulations, chunked by them. ``model``: texts to
    vectors, applied to all chunks that aren't marked yet; those that it fails for are tried again by the next run. A health row
    of the run is logged in any case, with the errors of its requests (``fetched``), and one for each source of ``lost`` (as ``readers.ingest`` gives them).
    """
    started = time.time()
    at = {name: f"{warehouse}/{name}" for name in ("regulations", "chunks", "vectors", "pipeline_health")}
    merged = materialize(dedup.union_first(frames, "source_hash", order))
    if check:
        quality.gate(merged)
    old = table(spark, at["regulations"], schema.REGULATIONS)
    fresh, counts = dedup.deduplicate_written(merged, old, order)
    rows, drift = schema.conform(tag_regulations(fresh), schema.REGULATIONS)
    rows = materialize(rows)
    rows.write.mode("append").parquet(at["regulations"])
    slim = rows.select("regulation_id", "version_id", "jurisdiction", "regulation_type", "effective_date", "source_url", "raw_text")
    cut = chunking.chunk_documents(slim, "regulation_id", "raw_text", blocks, [F.col("version_id").desc()]).withColumnRenamed("chunk_text", "text")
    body = F.coalesce("block_type", F.lit("body")) if "block_type" in cut.columns else F.lit("body")
    chunks, _ = schema.conform(cut.withColumn("block_type", body), schema.CHUNKS)
    new = materialize(store.unknown(table(spark, at["chunks"], schema.CHUNKS), chunks, "chunk_id", ["version_id"]))
    store.append_buckets(new, at["chunks"], "chunk_id")
    embedded = 0
    if model is not None:
        embedded = embed_chunks(spark, warehouse, model)
    ended = time.time()
    for health in [records.run_metrics(merged, source, started, ended, drift, fetched=fetched), *records.failed_runs(spark, lost or {}, started, ended)]:
        readers.new_health(table(spark, at["pipeline_health"], schema.PIPELINE_HEALTH), health).write.mode("append").parquet(at["pipeline_health"])
    return {"new": counts["output_rows"], "regulations": spark.read.parquet(at["regulations"]).count(), "chunks": spark.read.parquet(at["chunks"]).count(), "embedded": embedded, **counts}


def embed_chunks(spark: SparkSession, warehouse: str, model: Callable[[list[str]], list[list[float]]], name: str = "parquet") -> int:
    """Vectors of the stored chunks that have none yet; marks those that got one. Returns their number.

    Only buckets with such chunks are written again. Vectors come first, so a run that ends between the two embeds again what isn't marked.
    """
    chunks_at, vectors_at = f"{warehouse}/chunks", f"{warehouse}/vectors"
    chunks = table(spark, chunks_at, _bucketed(schema.CHUNKS))
    done = embedding.embed(chunks.where("vector_store is null").select("chunk_id", "text"), "text", model).where("embedding is not null").select("chunk_id", "embedding")
    done = materialize(done)
    store.merge_buckets(table(spark, vectors_at, _bucketed(VECTORS)), done, vectors_at, "chunk_id", embedding.upsert_vectors)

    def marked(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = store.mark(old, "chunk_id", new, {"vector_store": name})
        now = F.current_timestamp()
        return rows.withColumn("embedded_at", F.when(F.col("embedded_at").isNull() & F.col("vector_store").isNotNull(), now).otherwise(F.col("embedded_at")))

    store.merge_buckets(chunks, done, chunks_at, "chunk_id", marked)
    return done.count()


def latest(spark: SparkSession, warehouse: str) -> DataFrame:
    return views.regulations_latest(table(spark, f"{warehouse}/regulations", schema.REGULATIONS))
