"""Embeddings of chunks: a model is injected, a hashing stand-in needs none; upserts into a vector table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.text import tokens

from . import store


def hash_embedding(text, dims: int = 64):
    """Unit vector of a text's tokens hashed to signed places; a column function, the same on every run."""
    h = F.transform(tokens(text), lambda t: F.xxhash64(t))
    start = F.array_repeat(F.lit(0.0), dims)
    place = lambda x: F.pmod(x, F.lit(dims)).cast("int")
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(h, lambda x: place(x) == i), F.lit(0.0), lambda s, x: s + F.when(F.shiftrightunsigned(x, 63) == 1, -1.0).otherwise(1.0)))
    vector = F.coalesce(counts, start)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def embed(chunks: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 50) -> DataFrame:
    """``chunks`` with ``embedding``: model(texts) on batches in tasks; null for the rows of a batch that fails."""
    out = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, vectors = b.column(b.schema.get_field_index(text)).to_pylist(), []
            for i in range(0, len(texts), batch):
                part = [t or "" for t in texts[i : i + batch]]
                try:
                    vectors += model(part)
                except Exception:  # a remote model may refuse a batch: its rows stay unmarked and are embedded by a later run
                    vectors += [None] * len(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return chunks.mapInArrow(run, out)


def upsert_vectors(table: DataFrame, embedded: DataFrame) -> DataFrame:
    """The vector table (chunk_id, embedding, ...) with embedded chunks put in or replaced; failed rows don't count."""
    good = embedded.where("embedding is not null")
    return store.upsert(table, good, ["chunk_id"], [c for c in table.columns if c != "chunk_id"])


def metadata(chunks: DataFrame) -> DataFrame:
    """chunk_id and the flat metadata that a vector is stored with: titles cut at 200 characters, nulls as empty or 0."""
    words = [c for c, t in chunks.dtypes if t in ("string", "date", "timestamp") and c not in ("chunk_id", "text", "chunk_text")]
    numbers = [c for c, t in chunks.dtypes if t in ("int", "bigint")]
    fields = [F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, 200 if c == "title" else 1 << 30).alias(c) for c in words]
    return chunks.select("chunk_id", F.struct(*fields, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers]).alias("metadata"))
