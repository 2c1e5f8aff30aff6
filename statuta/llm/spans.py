"""Repeated spans: every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

Whether a window (``length`` bytes) repeats is read from the order of suffixes, without common prefixes over the minimum length:
on the Burrows-Wheeler transform of a shard, intervals of suffixes with a common prefix are extended backward, breadth first,
so that the common prefixes of neighbouring suffixes come out by increasing value (the right end of a new interval that has no
value yet gets the interval's length). At ``length`` the search stops: neighbours without a value share at least as much.

Shards are made so that equal windows meet. Texts are cut into runs of windows with the same smallest hash of ``gram`` bytes
(winnowing); equal windows have the same one, and each window is in one run. Runs whose hash nothing else has hold no repeated
window. Where all runs of a hash are the same bytes, each window repeats in each of them. All others are dealt by their hash to
shards of ``shard_bytes``, equal runs once. A hash whose different runs alone would fill a shard (a very common passage with
many surroundings) goes another way: its windows are compared one by one, by 128 bits of hash, summed before they are dealt.

Equal texts are put together first; one of at least ``length`` bytes that occurs twice is removed whole. The texts are written
once, in buckets by their key, so that neither cutting runs from them nor removing spans sends them again.

Nulls and odd rows: a null text is empty; texts under ``length`` bytes keep everything; a very long text is cut into runs in
pieces; ids may be null or repeat; rows of equal id and text are copies like any others; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, shuffle_partitions, text_bytes, tidy

_U64 = np.uint64
_NONE = np.zeros(0, np.int64)
#: Bytes of texts whose windows are hashed at a time.
BLOCK = 1 << 18


@dataclass(frozen=True)
class SpanParams:
    """length: bytes of a span. gram: bytes that are hashed to cut runs, a power of two, at most ``length``. shard_bytes: of
    runs that one transform holds, about (some 60 bytes of memory each)."""

    length: int = 400
    gram: int = 64
    shard_bytes: int = 2 << 20


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).view(_U64) * _U64(2) + _U64(1)


def string_hashes(data: np.ndarray, length: int, seed: int = 41) -> np.ndarray:
    """A 64-bit hash of each string of ``length`` bytes, made from those of powers of two."""
    level, a, size = _table(seed)[data], np.array([0x9E3779B97F4A7C15], _U64), 1  # arrays wrap around without a warning
    out, done, n = None, 0, len(data) - length + 1
    while True:
        if length & size:
            part = level[done : done + n]
            out = part if out is None else out * a + part
            done += size
        if 2 * size > length:
            break
        level, a, size = level[:-size] * a + level[size:], a * a, 2 * size
    out = out ^ out >> _U64(29)
    out *= _U64(0xBF58476D1CE4E5B9)
    return out ^ out >> _U64(32)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x, size = best(x[:-size], x[size:]), 2 * size
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _runs_of(texts: list[bytes], p: SpanParams) -> list[np.ndarray]:
    """Of texts of at least ``length`` bytes each: text, start, count (of windows), value, seg (hash of the run's bytes), again."""
    raw = b"".join(texts)
    data, sizes = np.frombuffer(raw, np.uint8), np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    grams, width = string_hashes(data, p.gram), p.length - p.gram + 1
    least = sliding(grams, width, np.minimum)
    text = np.repeat(np.arange(len(texts)), sizes)
    of = text[: len(least)]
    valid = np.arange(len(least)) + p.length <= ends[of]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (of[1:] != of[:-1])
    cuts = np.flatnonzero(new)
    counts = np.diff(np.append(cuts, len(least)))
    cuts, counts = cuts[valid[cuts]], counts[valid[cuts]]
    value = least[cuts]
    # a gram is a window's smallest if it is as large as the largest of those windows' smallest; twice in a text: a run may repeat within itself
    pad = np.zeros(width - 1, _U64)
    largest = sliding(np.concatenate([pad, np.where(valid, least, _U64(0)), pad]), width, np.maximum)
    at = np.flatnonzero(grams == largest)
    twice = (grams[at[1:]] == grams[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
    again = np.isin(value, grams[at[1:]][twice])
    seg = np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(cuts.tolist(), (cuts + counts + p.length - 1).tolist())], _U64)
    return [of[cuts], cuts - (ends - sizes)[of[cuts]], counts, value.view(np.int64), seg.view(np.int64), again]


def _pieces(b: pa.RecordBatch, p: SpanParams) -> Iterator[tuple[list[bytes], list[bytes], list[int]]]:
    """Texts, their keys and where they start in theirs, about BLOCK bytes at a time; long texts in pieces with all windows."""
    held, size = ([], [], []), 0
    for key, t in zip(b.column("key"), b.column("t")):
        buffer = t.as_buffer()
        for start in range(0, len(buffer) - p.length + 1, BLOCK):
            piece = buffer[start : start + BLOCK + p.length - 1].to_pybytes()
            for part, x in zip(held, (piece, key.as_py(), start)):
                part.append(x)
            size += len(piece)
            if size >= BLOCK:
                yield held
                held, size = ([], [], []), 0
    if size:
        yield held


def runs(texts: DataFrame, p: SpanParams) -> DataFrame:
    """``texts`` (key, t) -> a row for each run: key, start, count, value, seg, again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pieces, keys, starts in _pieces(b, p):
                of, start, count, value, seg, again = _runs_of(pieces, p)
                start = start + np.array(starts)[of]
                key = pa.array(keys, pa.binary()).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([key, pa.array(start), pa.array(count.astype(np.int32)), pa.array(value), pa.array(seg), pa.array(again)], names=["key", "start", "count", "value", "seg", "again"])

    return texts.select("key", "t").mapInArrow(cut, "key binary, start long, count int, value long, seg long, again boolean")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` (small whole numbers, 9 bits) in the order of at least their first ``depth`` symbols; by doubling,
    in which only rotations that aren't alone yet are sorted again."""
    n, known, key, ahead = len(text), 1, text.astype(np.int64), np.arange(len(text))
    while known < 7:  # seven symbols of nine bits
        step = min(known, 7 - known)
        key = (key << 9 * step) | (np.roll(key, -step) & ((1 << 9 * step) - 1))
        known += step
    order = np.argsort(key)
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, ahead, 0))
    while known < depth:
        alone = new & np.append(new[1:], True)
        places = np.flatnonzero(~alone)  # whole groups, in order
        if not len(places):
            break
        rows = order[places]
        key = rank[rows] * n + rank[(rows + known) % n]
        by = np.argsort(key)
        order[places], key = rows[by], key[by]
        new[places[1:]] |= key[1:] != key[:-1]
        rank[order[places]] = np.maximum.accumulate(np.where(new, ahead, 0))[places]
        known *= 2
    return order


def shared_prefixes(transform: np.ndarray, length: int) -> np.ndarray:
    """For each place between rows i - 1 and i whether they share ``length`` symbols or more. Rows of separators (0), and those
    that share one, count as sharing: they are never asked for.

    ``transform``: the symbol before each row. Level by level, the intervals of strings of one length are extended by every
    symbol before them; intervals whose right end has a value already are not followed.
    """
    n = len(transform)
    by = np.argsort(transform, kind="stable")
    to = np.empty(n, np.int64)
    to[by] = np.arange(n)  # where the row that is one symbol longer stands
    same = transform[by[1:]] == transform[by[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[by[1:][same]], after[by[:-1][same]] = by[:-1][same], by[1:][same]
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    left, right = np.array([0]), np.array([n])
    for level in range(length):
        sizes = right - left
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1]) + np.repeat(left - (ends - sizes), sizes)
        first, last = before[rows] < np.repeat(left, sizes), after[rows] >= np.repeat(right, sizes)
        if level:  # no string goes on before a separator
            inside = transform[rows] > 0
            first, last = first & inside, last & inside
        # new intervals are disjoint, so sorted first and last rows pair up
        left, right = np.sort(to[rows[first]]), np.sort(to[rows[last]]) + 1
        fresh = open_[right]
        left, right = left[fresh], right[fresh]
        open_[right] = False
        if not len(left):
            break
    return open_


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment the windows that occur anywhere else among them, by the transform of all."""
    sizes = np.array([len(s) for s in segments])
    text = np.zeros(int(sizes.sum()) + len(segments), np.int16)
    ends = np.cumsum(sizes + 1)
    keep = np.ones(len(text), bool)
    keep[ends - 1] = False
    text[keep] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 1
    order = suffix_order(text, length)
    shares = shared_prefixes(text[order - 1], length)
    repeats = np.zeros(len(text), bool)
    repeats[order] = shares[:-1] | shares[1:]
    return [repeats[e - s - 1 : e - length] for e, s in zip(ends, sizes)]


def _search(t: pa.Table, length: int) -> pa.Table:
    """A shard's runs (value, seg, copies, data) -> the repeated windows of each, as ranges: value, seg, start, count."""
    segments = [x.as_py() for x in t["data"]]
    out = [(np.zeros(0, np.int64),) * 4]
    copies, value, seg = (t[c].to_numpy() for c in ("copies", "value", "seg"))
    for i, windows in enumerate(repeated_windows(segments, length)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (windows | (copies[i] > 1)).astype(np.int8), [0]])))
        n = len(edges) // 2
        out.append((np.full(n, value[i]), np.full(n, seg[i]), edges[::2], edges[1::2] - edges[::2]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["value", "seg", "start", "count"])


def _by_windows(crowded: DataFrame, length: int) -> DataFrame:
    """The same for runs of a hash that would fill a shard: each window by itself, equal ones summed in the map tasks."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value, seg, copies, data in zip(*(b.column(c) for c in ("value", "seg", "copies", "data"))):
                x = np.frombuffer(data.as_buffer(), np.uint8)
                one, two = (string_hashes(x, length, seed).view(np.int64) for seed in (42, 43))
                n = len(one)
                same = [pa.array(np.full(n, c.as_py(), np.int64)) for c in (value, seg, copies)]
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), *same, pa.array(np.arange(n))], names=["one", "two", "value", "seg", "copies", "start"])

    found = materialize(crowded.mapInArrow(windows, "one long, two long, value long, seg long, copies long, start long"))
    # written, so that both sides of the join are plain shuffles: Spark can then split the partition of a window that very many runs have
    more = materialize(found.groupBy("one", "two").agg(F.sum("copies").alias("n")).where("n > 1").drop("n"))
    # neighbouring windows become one range: less their place among a run's repeated windows, their starts are equal
    place = F.row_number().over(W.partitionBy("value", "seg").orderBy("start"))
    repeated = found.join(more, ["one", "two"]).select("value", "seg", "start", (F.col("start") - place).alias("range"))
    return repeated.groupBy("value", "seg", "range").agg(F.min("start").alias("start"), F.count("*").alias("count")).drop("range")


def _write_texts(docs: DataFrame, p: SpanParams) -> tuple[str, DataFrame]:
    """Distinct texts of at least ``length`` bytes: key, t, copies; as a table in buckets by key."""
    spark = docs.sparkSession
    keyed = docs.select(F.substring(F.unhex(F.sha2("t", 256)), 1, 16).alias("key"), "t").where(F.octet_length("t") >= p.length)
    texts = keyed.groupBy("key").agg(F.first("t").alias("t"), F.count("*").alias("copies"))
    name = f"spans_{uuid.uuid4().hex}"
    texts.write.bucketBy(shuffle_partitions(spark), "key").option("path", scratch_dir(spark)).option("compression", "zstd").saveAsTable(name)
    return name, spark.table(name)


def _marks(texts: DataFrame, p: SpanParams) -> DataFrame:
    """key, start, count of repeated windows; ranges of one text may touch or overlap, never windows that don't repeat."""
    cut = materialize(runs(texts, p))
    kinds = cut.groupBy("value").agg(F.count("*").alias("n"), (F.bool_or("again") | (F.min("seg") != F.max("seg"))).alias("mixed"), F.bool_or("again").alias("again"))
    shared = materialize(cut.join(kinds.where("n > 1 OR again").select("value", "mixed"), "value").drop("again"))
    mixed = shared.where("mixed")
    place = F.struct("key", "start", "count")
    distinct = mixed.groupBy("value", "seg").agg(F.min(place).alias("at"), F.count("*").alias("copies"))
    distinct = materialize(distinct.select("value", "seg", "at.*", "copies").withColumn("size", F.col("count") + p.length - 1))
    sizes = distinct.groupBy("value").agg(F.sum("size").alias("bytes"))
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    crowded = (F.col("bytes") > p.shard_bytes / 4).alias("crowded")
    wanted = distinct.join(sizes.select("value", crowded), "value").groupBy("key").agg(F.collect_list(F.struct("value", "seg", "start", "size", "copies", "crowded")).alias("runs"))
    cuts = F.transform("runs", lambda r: F.struct(r["value"].alias("value"), r["seg"].alias("seg"), r["copies"].alias("copies"), r["crowded"].alias("crowded"), F.substring(F.col("t"), r["start"].cast("int") + 1, r["size"].cast("int")).alias("data")))
    data = materialize(texts.join(wanted, "key").select(F.inline(cuts)))
    shards = max(1, -(-2 * total // p.shard_bytes))
    few = data.where("NOT crowded").withColumn("shard", F.pmod(F.xxhash64("value", F.lit(47)), F.lit(shards)))
    length = p.length
    found = few.groupBy("shard").applyInArrow(lambda t: _search(t, length), "value long, seg long, start long, count long")
    found = found.unionByName(_by_windows(data.where("crowded"), p.length))
    ranges = materialize(found.unionByName(data.where("crowded AND copies > 1").select("value", "seg", F.lit(0).cast("long").alias("start"), (F.octet_length("data") - p.length + 1).cast("long").alias("count"))))
    ranges = ranges.groupBy("value", "seg").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))
    within = mixed.select("value", "seg", "key", F.col("start").alias("from")).join(ranges, ["value", "seg"]).select("key", "from", F.inline("ranges"))
    within = within.select("key", (F.col("from") + F.col("start")).alias("start"), "count")
    return within.unionByName(shared.where("NOT mixed").select("key", "start", F.col("count").cast("long").alias("count")))


def _removal(texts: DataFrame, marks: DataFrame, p: SpanParams) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of the texts that lose any."""
    by_key = marks.groupBy("key").agg(F.collect_list(F.struct("start", "count")).alias("marks"))
    touched = texts.join(by_key, "key", "left").where("copies > 1 OR marks IS NOT NULL")
    length = p.length

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t, copies, marks in zip(*(b.column(c) for c in ("key", "t", "copies", "marks"))):
                x = np.frombuffer(t.as_buffer(), np.uint8)
                if copies.as_py() > 1:
                    edges = np.array([0, len(x)])
                else:
                    step = np.zeros(len(x) + 1, np.int64)
                    start, count = (marks.values.field(i).to_numpy() for i in (0, 1))
                    np.add.at(step, start, 1)
                    np.add.at(step, start + count + length - 1, -1)
                    covered = np.cumsum(step)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                gone = np.zeros(len(x), bool)
                for i, j in edges.reshape(-1, 2):
                    gone[i:j] = True
                kept = x[~gone].tobytes()
                row = [key.as_py(), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return touched.select("key", "t", "copies", "marks").mapInArrow(remove, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


@tidy
def remove_repeats(docs: DataFrame, columns: list[str], params: SpanParams = SpanParams(), kept: bool = False) -> DataFrame:
    """``docs`` (text) -> ``columns`` of it, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept``: the remaining
    bytes, for every row."""
    spark = docs.sparkSession
    named = docs.select(*[F.col(c).alias(f"__{c}") for c in columns], text_bytes().alias("t"))
    name, texts = _write_texts(named, params)
    try:
        removed = _removal(texts, _marks(texts, params), params)
        removed = materialize(removed if kept else removed.drop("kept"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    sha = F.sha2("t", 256)
    rows = named.select(*[f"__{c}" for c in columns], F.substring(F.unhex(sha), 1, 16).alias("key"), F.octet_length("t").cast("long").alias("n_bytes"), sha.alias("own"), *(["t"] if kept else []))
    rows = rows.join(removed, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_removed", "n_spans")]
    text = [F.coalesce("kept", "t").alias("kept")] if kept else []
    return rows.select(*[F.col(f"__{c}").alias(c) for c in columns], "n_bytes", *zero, F.coalesce("kept_sha256", "own").alias("kept_sha256"), *text)
