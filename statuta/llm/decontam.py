"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of other than ASCII characters, A-Z lower-cased. Of every
``window - k + 1`` consecutive k-grams the one with the smallest hash is a fingerprint, so any two equal runs of
``window`` words share one. A document's fingerprints are looked up among those of the benchmark, and each hit is extended
to its window of words and compared with the benchmark's windows word for word: no equal window is missed and no other is
reported. An item of fewer words than a window is one window of its own length, looked up by its whole hash.

The benchmark is cut into pieces (overlapping by window - 1 words), each kept once, that are dealt into blocks of at most
``block_bytes`` bytes, about; one block at a time is broadcast and joined with all documents in a scan without a shuffle.
Usually there is one block; with more, what was hit so far is written between the scans.

Nulls and odd rows: a null text has no words, is not hit and, as an item, has no window; a null item id is named "null"; items
repeated under one id count once; repeated documents each get their row; an empty benchmark hits nothing. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, materialize, mix, text_bytes

#: Byte for byte: ASCII other than letters and digits to a space, A-Z to a-z.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_U64 = np.uint64


@dataclass(frozen=True)
class Winnow:
    """window: words that must be equal; k: words of a fingerprinted gram; block_bytes: of items that are broadcast at a time, about."""

    window: int = 10
    k: int = 5
    block_bytes: int = 16 << 20
    piece_words: int = 10_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on, for all places that have k."""
    g = h[: len(h) - k + 1]
    for j in range(1, k):
        g = mix(g, h[j : len(h) - k + 1 + j])
    return g


def _minima(h: np.ndarray, p: Winnow) -> np.ndarray:
    """The fingerprint of each window: the smallest k-gram hash in it."""
    g = _grams(h, p.k)
    n = len(h) - p.window + 1
    least = g[:n]
    for j in range(1, p.window - p.k + 1):
        least = np.minimum(least, g[j : n + j])
    return least


class _Block:
    """Windows of some items: fingerprints to look up, and exact windows with the numbers of their items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], p: Winnow):
        hashes = WordHashes()
        self.p, self.names = p, sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.windows: dict[bytes, set[int]] = {}
        prints: list[np.ndarray] = []
        short: dict[int, list[np.ndarray]] = {}
        for name, words in items:
            if not words:
                continue
            n = min(p.window, len(words))
            for i in range(len(words) - n + 1):
                self.windows.setdefault(b" ".join(words[i : i + n]), set()).add(number[name])
            h = hashes.of(words)
            (prints if n == p.window else short.setdefault(n, [])).append(_minima(h, p) if n == p.window else _grams(h, n))
        self.probes = [(n, np.unique(np.concatenate(x))) for n, x in [(p.window, prints), *short.items()] if x]

    def hits(self, flat: np.ndarray, words: list[bytes], owner: np.ndarray) -> Iterator[tuple[int, int, set[int]]]:
        """(place, length, items) of each window of the benchmark in the texts, which stand one after the other."""
        for n, known in self.probes:
            if len(flat) < n:
                continue
            found = _minima(flat, self.p) if n == self.p.window else _grams(flat, n)
            near = np.zeros(1 << 20, bool)
            near[known >> _U64(44)] = True
            at = np.flatnonzero(near[found >> _U64(44)] & (owner[: len(found)] == owner[n - 1 :]))
            at = at[known[np.minimum(np.searchsorted(known, found[at]), len(known) - 1)] == found[at]]
            for i in at.tolist():
                if items := self.windows.get(b" ".join(words[i : i + n])):
                    yield i, n, items


def _pieces(benchmark: DataFrame, p: Winnow) -> DataFrame:
    """(item, words: long, text): items cut into overlapping pieces of a bounded number of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for i in range(0, max(1, len(words) - p.window + 1), p.piece_words):
                    piece = words[i : i + p.piece_words + p.window - 1]
                    rows.append((item, len(piece), b" ".join(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.binary()))], names=["item", "words", "text"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), text_bytes()).mapInArrow(cut, "item string, words long, text binary").where("words > 0")


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], params: Winnow = Winnow()) -> DataFrame:
    """The columns ``keep`` of ``docs`` (with text), n_words, n_hit, n_items, items_sha256, contaminated, for every row."""
    spark = docs.sparkSession
    pieces = materialize(_pieces(benchmark, params).select("item", "text").distinct())
    total = pieces.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, math.ceil(total / params.block_bytes))
    carried = [docs.schema[c] for c in keep] + [T.StructField("__text", T.BinaryType())]
    state = docs.select(*keep, text_bytes().alias("__text"), F.array().cast("array<int>").alias("__hit"), F.array().cast("array<string>").alias("__items"))
    for b in range(blocks):
        got = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).select("item", "text").collect()
        block = spark.sparkContext.broadcast([(r.item, bytes(r.text).split()) for r in got])
        last = b == blocks - 1
        out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(*f) for f in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()))]) if last else T.StructType(carried + [T.StructField("__hit", T.ArrayType(T.IntegerType())), T.StructField("__items", T.ArrayType(T.StringType()))])
        state = state.mapInArrow(_scan(block, params, len(keep), last), out)
        if not last:
            state = materialize(state)
    return state


def _scan(sent, params: Winnow, kept: int, last: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hashes = _Block(sent.value, params), WordHashes()
        for batch in batches:
            texts, hit_before, items_before = (batch.column(kept + j) for j in range(3))
            rows, start = [], 0
            while start < len(texts):  # a few texts at a time: a batch may hold very long ones
                group, size = [], 0
                while start + len(group) < len(texts) and size < 4 << 20:
                    group.append(words_of(texts[start + len(group)].as_py()))
                    size += 8 * len(group[-1]) + 8
                words = [w for ws in group for w in ws]
                sizes = [len(ws) for ws in group]
                owner = np.repeat(np.arange(len(group)), sizes)
                base = np.cumsum([0, *sizes])
                hit, items = np.zeros(len(words), bool), {}
                for i, n, got in block.hits(hashes.of(words), words, owner):
                    hit[i : i + n] = True
                    items.setdefault(int(owner[i]), set()).update(got)
                for j in range(len(group)):
                    old = hit_before[start + j].as_py()
                    own = hit[base[j] : base[j + 1]]
                    own[old] = True
                    names = {block.names[x] for x in items.get(j, ())} | set(items_before[start + j].as_py())
                    rows.append((len(own), own, sorted(names)))
                start += len(group)
            own = batch.columns[:kept]
            if last:
                n_hit = [int(h.sum()) for _, h, _ in rows]
                new = [pa.array([n for n, _, _ in rows], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for *_, x in rows], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for *_, x in rows], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]
                names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            else:
                new = [texts, pa.array([np.flatnonzero(h).tolist() for _, h, _ in rows], pa.list_(pa.int32())), pa.array([x for *_, x in rows], pa.list_(pa.string()))]
                names = ["__text", "__hit", "__items"]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[*batch.schema.names[:kept], *names])

    return scan
