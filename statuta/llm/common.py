"""Helpers shared by the corpus operators: shared scratch tables, fast word hashing, ordered shards."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.scratch import materialize, remove, scratch_dir, tidy  # noqa: F401

_U64 = np.uint64
#: Byte for byte: A-Z to a-z, the rest unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to ``limit`` words so that a worker's memory stays bounded."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash arrays."""
    x = a * _U64(0x9E3779B97F4A7C15) + b
    x ^= x >> _U64(29)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(32)
    return x


#: Keys that are looked at, at most, to cut a table into ranges.
SAMPLE = 500_000


def range_bounds(df: DataFrame, key: Column, tie: Column, shards: int) -> np.ndarray:
    """At most ``shards - 1`` cut points (rows of key and tie) of the order by two longs, the same on every run.

    They come from a sample chosen by a hash of both, about 64 pairs a shard and at most about SAMPLE, so a key that very
    many rows share is cut at its ties. Results don't depend on where the cuts are.
    """
    if shards < 2:
        return np.zeros((0, 2), np.int64)
    pairs = df.select(key.cast("long").alias("k"), tie.cast("long").alias("t"))
    every = max(1, pairs.count() // min(64 * shards, SAMPLE))
    got = pairs.where(F.pmod(F.xxhash64("k", "t", F.lit(11)), F.lit(every)) == 0).distinct().toArrow()
    got = np.column_stack([got["k"].to_numpy(), got["t"].to_numpy()])
    got = got[np.lexsort((got[:, 1], got[:, 0]))]
    return np.unique(got[[len(got) * i // shards for i in range(1, shards)]], axis=0) if len(got) else got


def range_shard(spark: SparkSession, key: Column, tie: Column, bounds: np.ndarray) -> Column:
    """Number of cut points at or below the pair: 0 for the lowest."""
    sent = spark.sparkContext.broadcast(np.asfortranarray(bounds))

    @F.pandas_udf("int")
    def place(keys: pd.Series, ties: pd.Series) -> pd.Series:
        k, t = keys.to_numpy(), ties.to_numpy()
        cuts, tied = sent.value[:, 0], sent.value[:, 1]
        low, high = np.searchsorted(cuts, k, side="left"), np.searchsorted(cuts, k, side="right")
        out = low.copy()
        for i in np.unique(low[high > low]):  # keys that are cut themselves
            own = np.flatnonzero((low == i) & (high > low))
            out[own] += np.searchsorted(tied[i : high[own[0]]], t[own], side="right")
        return pd.Series(out.astype(np.int32))

    return place(key.cast("long"), tie.cast("long"))


class Hashed:
    """A file under a temporary name, hashed as it is written; ``commit`` gives it its own.

    A task that runs twice writes the same bytes twice; the second takes the place of the first.
    """

    def __init__(self, root: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(base, recursive=True)
        self.file, self.name, self.temp = name, f"{base}/{name}", f"{base}/_{name}-{uuid.uuid4().hex}"
        self.out, self.sha, self.size, self.closed = self.fs.open_output_stream(self.temp), hashlib.sha1(), 0, False

    def write(self, data) -> int:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()

    def close(self) -> None:
        self.closed = True

    def tell(self) -> int:
        return self.size

    def commit(self) -> str:
        """The SHA-1 of the file."""
        self.out.close()
        try:
            self.fs.move(self.temp, self.name)
        except OSError:  # some file systems don't move onto a file that is there
            self.fs.delete_file(self.name)
            self.fs.move(self.temp, self.name)
        return self.sha.hexdigest()


def read_committed(root: str, name: str, sha1: str) -> pa.Buffer:
    """A file that a manifest names, checked."""
    fs, base = pafs.FileSystem.from_uri(root)
    with fs.open_input_file(f"{base}/{name}") as f:
        data = f.read_buffer()
    if hashlib.sha1(data).hexdigest() != sha1:
        raise ValueError(f"{name} isn't the file that was committed")
    return data
