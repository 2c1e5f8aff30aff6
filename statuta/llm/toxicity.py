"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct 32-bit hashes of its lower-cased words without punctuation, of neighbouring word pairs and
of pairs with one word between. A bounded, hash-chosen sample of labelled rows is dealt to shards, a task each; each
shard runs FTRL-proximal (a learning rate per coordinate, L1 and L2) and the shards' weights are averaged.
L1 leaves few weights, which are broadcast and applied to every text in one scan without a shuffle.

Nulls and odd rows: a null text is an empty one and scores the prior; a null id never has a label; repeated
rows each get a score; labels with a null class are left out, repeated labels of one id count as toxic if
any is. Without any label the prior alone, below one half, is the score. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, materialize, mix, text_bytes

#: Byte for byte: ASCII other than letters, digits and apostrophes to a space, A-Z to a-z.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256))


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: the per-coordinate rate; l1, l2: penalties; positive: weight of a toxic row's gradient.
    max_train bounds the labelled rows that are fitted, max_weights the weights that are broadcast."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 0.1
    positive: float = 3.0
    epochs: int = 4
    max_train: int = 40_000
    rows_per_shard: int = 5_000
    max_weights: int = 1_000_000


@dataclass(frozen=True)
class Weights:
    """Sorted feature keys with their non-zero weights, and the intercept."""

    keys: np.ndarray
    values: np.ndarray
    intercept: float


def _features(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """32-bit feature keys of all texts and the number of the text that each belongs to, repeats included."""
    split = [t.translate(_WORDS).split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    h = hashes.of([w for ws in split for w in ws])
    doc = np.repeat(np.arange(len(texts)), sizes)
    keys, owners = [h], [doc]
    for gap, seed in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            keys.append(mix(h[:-gap] + np.uint64(seed), h[gap:])[same])
            owners.append(doc[gap:][same])
    return (np.concatenate(keys) >> np.uint64(32)).astype(np.uint32), np.concatenate(owners)


def _groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``size`` bytes and where each begins; no more than a run is held beside the batch."""
    ends, start = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield start, texts.slice(start, end - start).to_pylist()
        start = end


def _distinct_features(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features, one text after the other, and how many each has."""
    keys, owner = _features(texts, hashes)
    pairs = np.unique(owner.astype(np.uint64) << np.uint64(32) | keys)
    return (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def _fit_shard(texts: list[bytes], toxic: np.ndarray, prior: float, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over one shard's texts, row after row."""
    hashes = WordHashes()
    parts = [_distinct_features(own, hashes) for _, own in _groups(pa.array(texts, pa.binary()))]
    return _fit_features(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]), toxic, prior, p)


def _coordinates(keys: np.ndarray, sizes: np.ndarray, p: Ftrl) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that may get a weight, sorted; the rows' places among them, one row after the other; where each row begins.

    While a weight is zero, z moves by the gradient alone: by less than ``positive`` (or 1) an epoch and row. A feature of so few
    rows that this can't pass ``l1`` stays at zero, so it needs no place: most features are of one row.
    """
    ordered = np.sort(keys)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new).astype(np.int32)
    rows = np.diff(first, append=np.int32(len(ordered)))
    coords = ordered[first[rows > math.floor(p.l1 / (p.epochs * max(1.0, p.positive)))]]
    del ordered, new, first, rows
    at, known = np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
    for i in range(0, len(keys) if len(coords) else 0, 1 << 20):
        own = keys[i : i + (1 << 20)]
        at[i : i + len(own)] = places = np.minimum(np.searchsorted(coords, own), len(coords) - 1)
        known[i : i + len(own)] = coords[places] == own
    ends = np.cumsum(np.concatenate(([0], sizes)))
    return coords, at[known], np.concatenate((np.zeros(1, np.int32), np.cumsum(known, dtype=np.int32)))[ends]


def _fit_features(keys: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, prior: float, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """``keys``: the rows' features one after the other, ``sizes`` of each; the intercept stays at the prior log-odds."""
    coords, at, ends = _coordinates(keys, sizes, p)
    z, n = np.zeros(len(coords)), np.zeros(len(coords))

    def weight(zi, ni):
        return np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for row in range(len(sizes)):
            i = at[ends[row] : ends[row + 1]]
            w = weight(z[i], n[i])
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, prior + w.sum())))) - toxic[row]
            g *= p.positive if toxic[row] else 1.0
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g * g
    w = weight(z, n)
    keep = np.flatnonzero(w)
    return coords[keep], w[keep]


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl()) -> Weights:
    """Fit on ``labels`` (doc_id, toxic) joined with ``docs`` (doc_id, text); labels must hold training rows only."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # rows are told apart by id and text, so an id or a row that is often repeated counts once for each of its texts
    marked = docs.select("doc_id", F.xxhash64(text_bytes()).alias("h"), text_bytes().alias("text"))
    rows = marked.select("doc_id", "h").distinct().join(known, "doc_id")
    chosen = materialize(rows.orderBy(F.xxhash64("doc_id", "h", F.lit(3)), "doc_id", "h").limit(params.max_train))
    count, positive = chosen.agg(F.count("*"), F.sum(F.col("toxic"))).first()
    prior = math.log(((positive or 0) * params.positive + 0.5) / (count - (positive or 0) + 1.5))
    prior = min(prior, -0.5)  # a text without any sign is clean
    if not count:
        return Weights(np.zeros(0, np.uint32), np.zeros(0, np.float32), prior)
    shards = max(1, math.ceil(count / params.rows_per_shard))
    # at most max_train rows of three numbers: safe to broadcast
    train = marked.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic").agg(F.first("text").alias("text"))
    train = train.select(F.pmod(F.xxhash64("doc_id", "h", F.lit(5)), F.lit(shards)).cast("int").alias("shard"), "doc_id", "h", "toxic", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task has one shard; of its texts only the features are held."""
        hashes, keys, sizes, toxic = WordHashes(), [], [], []
        for b in batches:
            for _, texts in _groups(b.column(4)):
                k, n = _distinct_features(texts, hashes)
                keys.append(k)
                sizes.append(n)
            toxic += b.column(3).to_pylist()
        if keys:
            whole = np.concatenate(keys)
            keys.clear()
            coords, values = _fit_features(whole, np.concatenate(sizes), np.array(toxic), prior, params)
            yield pa.RecordBatch.from_arrays([pa.array(coords.astype(np.int64)), pa.array(values)], names=["coord", "weight"])

    dealt = train.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.xxhash64("doc_id", "h", F.lit(9)), "doc_id", "h")
    mixed = dealt.mapInArrow(fit, "coord long, weight double").groupBy("coord").agg((F.sum("weight") / shards).alias("weight"))
    # L1 leaves few; the largest max_weights if there were more
    mixed = mixed.orderBy(F.abs("weight").desc(), "coord").limit(params.max_weights).toPandas()
    order = np.argsort(mixed["coord"].to_numpy())
    return Weights(mixed["coord"].to_numpy()[order].astype(np.uint32), mixed["weight"].to_numpy()[order].astype(np.float32), prior)


def score_toxicity(docs: DataFrame, weights: Weights, keep: list[str], row: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``score``, for every row, in one scan. ``row``: that one of ``keep`` which is a struct with
    the text in it, so that the text is sent once; else it is a column of ``docs``."""
    fields = [docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())]
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hashes = sent.value, WordHashes()
        near = np.zeros(1 << 22, bool)
        near[w.keys >> np.uint32(10)] = True
        for batch in batches:
            out = np.full(batch.num_rows, w.intercept)
            whole = pc.fill_null(pc.struct_field(batch.column(keep.index(row)), "text"), "").cast(pa.binary()) if row else batch.column(len(keep))
            for start, texts in _groups(whole):
                keys, owner = _features(texts, hashes)
                hit = np.flatnonzero(near[keys >> np.uint32(10)])
                if len(hit):
                    pos = np.minimum(np.searchsorted(w.keys, keys[hit]), max(0, len(w.keys) - 1))
                    real = w.keys[pos] == keys[hit]
                    pairs = np.unique(owner[hit][real].astype(np.uint64) << np.uint64(32) | pos[real].astype(np.uint64))
                    np.add.at(out, start + (pairs >> np.uint64(32)).astype(np.int64), w.values[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)])
            scores = pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], scores], names=[*keep, "score"])

    return docs.select(*keep, *([] if row else [text_bytes().alias("__text")])).mapInArrow(score, T.StructType(fields))
