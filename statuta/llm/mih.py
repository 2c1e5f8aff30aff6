"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's code has one bit for each coordinate's sign (vectors of other than 64 coordinates: the signs of 64 seeded random
projections). The 64 bits are cut into m segments and every code is indexed under its value on each. For a query, segments
are probed at distance s = 0, 1, 2, ...; after step s every code within m (s + 1) - 1 bits has been met, so a query is done
once its kth verified distance is at most that. Each step is a shuffled join of probes, which tasks make, with the index;
it keeps only codes at least as near as the query's kth so far, each at the first segment that meets it. m is chosen by an
estimate of probes and candidates. A step that would probe and meet more than all codes (or make over ``MAX_FLIPS`` probes a
segment) isn't taken: the queries still open then look at every code once, in blocks of ``BLOCK`` queries.

Equal codes are one entry with their k smallest ids (more can't be among the first k) and their number, so neither a common
vector nor a common query repeats work. A segment value with very many codes is split into parts by a hash of the code, and
its probes go to each. Ties in distance go to the smaller id. Nulls and odd rows: rows with a null vector or null
coordinates have no code and are neither found nor answered; null ids are left out; repeated ids are found as often as they
occur; fewer than k rows give all of them; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Flips of one segment at one distance that a task makes at most (32 MB).
MAX_FLIPS = 1 << 22
#: Queries that are broadcast at a time to look at every code.
BLOCK = 4096
#: Segment values that are split into parts: at most so many, of at least PART codes.
HOT, PART = 10_000, 4096

_BEST = "array<struct<distance:int,least:bigint,code:bigint,n:bigint>>"


def _signs(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.reshape(-1, dims)
    if dims != 64:
        x = x @ np.random.default_rng(23).standard_normal((dims, 64))
    return np.packbits(x > 0, axis=1, bitorder="little").view("<i8").ravel()


def binary_codes(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``vectors`` -> id: long, code: long, for rows that have both."""
    given = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    given = given.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            flat, ends = b.column(1).flatten().to_numpy(), np.cumsum(sizes)
            codes = np.zeros(len(sizes), np.int64)
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                codes[own] = _signs(flat[(ends[own] - dims)[:, None] + np.arange(dims)], int(dims))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes)], names=["id", "code"])

    return given.mapInArrow(run, "id long, code long")


def _first_ids(codes: DataFrame, k: int) -> DataFrame:
    """code, ids: its k smallest, n: how many there are; by way of 32 parts of a code so that a common one is no single task."""
    part = codes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32)))
    counts = codes.groupBy("code").agg(F.count("*").alias("n"))
    for keys in (["code", "part"], ["code"]):
        part = part.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("place") <= k)
    ids = part.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return ids.join(counts, "code")


class Segments:
    """m segments of 64 bits: places, widths, and the flips of a width at a distance."""

    def __init__(self, m: int):
        self.m, self.cuts = m, [64 * i // m for i in range(m + 1)]
        self.widths = [b - a for a, b in zip(self.cuts, self.cuts[1:])]

    def value(self, codes: np.ndarray, i: int) -> np.ndarray:
        return codes >> np.uint64(self.cuts[i]) & np.uint64((1 << self.widths[i]) - 1)

    def probes(self, s: int) -> int:
        return sum(math.comb(w, s) for w in self.widths)

    def work(self, s: int, codes: int) -> float:
        """Probes of a step and the codes that they meet if values are spread evenly."""
        return sum(math.comb(w, s) * (1 + codes / 2**w) for w in self.widths)

    def covered(self, s: int) -> int:
        """Bits within which every code has been met after step s."""
        return self.m * (s + 1) - 1


def choose_segments(codes: int, k: int) -> Segments:
    """The least work up to the distance at which k of so many evenly spread codes lie."""
    near, total = 0, 1
    while near < 63 and total * codes < k << 64:
        near += 1
        total += math.comb(64, near)

    def work(m: int) -> float:
        x = Segments(m)
        return sum(x.work(s, codes) for s in range(near // m + 1))

    return Segments(min(range(2, 9), key=work))


def flips(width: int, s: int) -> np.ndarray:
    """All numbers of ``width`` bits of which s are set."""
    found = {0: np.zeros(1, np.uint64)}
    for bit in range(width):
        for n in range(min(s, bit + 1), 0, -1):
            new = found[n - 1] | np.uint64(1 << bit)
            found[n] = np.concatenate([found[n], new]) if n in found else new
    return found.get(s, np.zeros(0, np.uint64))


def _key(seg: int, value: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (value << np.uint64(3) | np.uint64(seg) | part.astype(np.uint64) << np.uint64(36)).view(np.int64)


def _index(entries: DataFrame, x: Segments, hot: dict[int, int]) -> DataFrame:
    """A row per code and segment: key (segment, value, part), code, its smallest id, and how many there are."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(0).to_numpy().view(np.uint64)
            mixed = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for i in range(x.m):
                key = _key(i, x.value(code, i), np.zeros(len(code), np.uint64))
                if hot:
                    parts = np.fromiter((hot.get(v, 1) for v in key.tolist()), np.uint64, len(key))
                    key = key | (mixed % parts << np.uint64(36)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], names=["key", "code", "least", "n"])

    return entries.select("code", F.element_at("ids", 1).alias("least"), "n").mapInArrow(place, "key long, code long, least long, n long")


def _probes(active: DataFrame, x: Segments, steps: list[int], hot: dict[int, int]) -> DataFrame:
    """``active`` (q, bound) -> key, q, bound: every value at the steps' distances, of each segment."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {w: np.concatenate([flips(w, s) for s in steps]) for w in set(x.widths)}
        for b in batches:
            q, bound = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for i, w in enumerate(x.widths):
                step = max(1, (1 << 18) // max(1, len(table[w])))
                for at in range(0, len(q), step):
                    own = slice(at, at + step)
                    key = _key(i, (x.value(q[own], i)[:, None] ^ table[w][None, :]).ravel(), np.zeros(1, np.uint64))
                    who, far = np.repeat(q[own].view(np.int64), len(table[w])), np.repeat(bound[own], len(table[w]))
                    if hot:
                        parts = np.fromiter((hot.get(v, 1) for v in key.tolist()), np.int64, len(key))
                        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                        key = np.repeat(key, parts) | nth << 36
                        who, far = np.repeat(who, parts), np.repeat(far, parts)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(far)], names=["key", "q", "bound"])

    return active.select("q", "bound").mapInArrow(make, "key long, q long, bound int")


def _meet(probes: DataFrame, index: DataFrame, x: Segments, steps: list[int]) -> DataFrame:
    """Pairs (q, distance, least, code, n) within the bound, each once: at its first segment within these steps, if no earlier step met it."""
    both = F.col("q").bitwiseXOR(F.col("code"))
    apart = [F.bit_count(F.shiftrightunsigned(both, cut).bitwiseAND(F.lit((1 << w) - 1))) for cut, w in zip(x.cuts, x.widths)]
    first = reduce(lambda c, i: c.when(apart[i] <= steps[-1], i), range(1, x.m), F.when(apart[0] <= steps[-1], 0))
    met = probes.join(index.hint("merge"), "key").withColumn("distance", F.bit_count(both).cast("int")).where("distance <= bound")
    met = met.where((first == F.col("key").bitwiseAND(F.lit(7))) & (F.least(*apart) >= steps[0]))
    return met.select("q", "distance", "least", "code", "n")


def _look(active: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The pairs of ``active`` queries with every code that can be among their first k."""
    count, parts = active.count(), []
    blocks = 1 if count <= BLOCK else math.ceil(2 * count / BLOCK)
    for block in range(blocks):
        # dealt by a hash: half of BLOCK each
        own = active.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q")
        asked = np.array([r.q for r in own.collect()], np.int64).view(np.uint64)
        sent = entries.sparkSession.sparkContext.broadcast(asked)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    own = b.slice(at, 4096)
                    code, least = own.column(0).to_numpy().view(np.uint64), own.column(1).to_numpy()
                    order = np.argsort(least, kind="stable")
                    for i in range(0, len(sent.value), 512):
                        q = sent.value[i : i + 512]
                        far = np.bitwise_count(q[:, None] ^ code[order][None, :])
                        near = np.argsort(far, axis=1, kind="stable")[:, :k]
                        pick = order[near.ravel()]
                        columns = [np.repeat(q, near.shape[1]).view(np.int64), np.take_along_axis(far, near, 1).ravel().astype(np.int32), least[pick], code[pick].view(np.int64), own.column(2).to_numpy()[pick]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "distance", "least", "code", "n"])

        parts.append(entries.select("code", F.element_at("ids", 1).alias("least"), "n").mapInArrow(look, "q long, distance int, least long, code long, n long"))
    return reduce(DataFrame.unionByName, parts)


def _nearer(state: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``state`` (q, bound, best) with the first k codes of ``best`` and the new pairs, by distance and smallest id."""
    order = W.partitionBy("q").orderBy("distance", "least")
    first = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    new = first.groupBy("q").agg(F.collect_list(F.struct("distance", "least", "code", "n")).alias("new"))
    best = F.slice(F.array_sort(F.concat("best", F.coalesce("new", F.array().cast(_BEST)))), 1, k)
    return state.join(new, "q", "left").select("q", best.alias("best"))


@tidy
def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row of ``queries`` its k nearest rows of ``vectors``: query_id, rank (from 1), neighbor_id, distance."""
    entries = materialize(_first_ids(materialize(binary_codes(vectors, id_column, vector)), k))
    total, rows = entries.agg(F.count("*"), F.sum("n")).first()
    asked = materialize(binary_codes(queries, id_column, vector))
    x = choose_segments(max(1, total), k)
    least = max(PART, math.ceil(total * x.m / HOT))
    # values of over ``least`` codes: at most HOT of them
    hot = {r.key: math.ceil(r["count"] / least) for r in _index(entries, x, {}).groupBy("key").count().where(F.col("count") > least).collect()}
    index = materialize(_index(entries, x, hot))
    state = materialize(asked.select(F.col("code").alias("q")).distinct().select("q", F.lit(64).alias("bound"), F.array().cast(_BEST).alias("best")))
    # the kth distance, once k rows (or all) have been met
    kth = F.aggregate("best", F.struct(F.lit(0).cast("long").alias("have"), F.lit(64).alias("at")), lambda a, b: F.struct((a["have"] + b["n"]).alias("have"), F.when(a["have"] < k, b["distance"]).otherwise(a["at"]).alias("at")))
    done, steps = [], [0, 1]
    while not state.isEmpty():
        scan = steps[-1] > max(x.widths) or sum(x.work(s, total) for s in steps) > total or max(math.comb(w, s) for w in x.widths for s in steps) > MAX_FLIPS
        pairs = _look(state, entries, k) if scan else _meet(_probes(state, x, steps, hot), index, x, steps)
        known = _nearer(state.withColumn("best", F.array().cast(_BEST)) if scan else state, pairs, k).withColumn("kth", kth)
        known = known.select("q", F.when(F.col("kth.have") >= min(k, rows or 0), F.col("kth.at")).otherwise(64).alias("bound"), "best")
        known = materialize(known.withColumn("over", F.lit(scan) | (F.col("bound") <= x.covered(steps[-1]))))
        done.append(known.where("over").select("q", "best"))
        state = known.where("not over").select("q", "bound", "best")
        steps = [steps[-1] + 1]
    if not done:
        return entries.sparkSession.createDataFrame([], "query_id long, rank int, neighbor_id long, distance int")
    found = reduce(DataFrame.unionByName, done).select("q", F.explode("best").alias("b")).select("q", "b.distance", "b.code")
    answers = found.join(entries.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    answers = answers.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)
    answers = materialize(answers)
    return asked.join(answers, asked.code == answers.q).select(asked.id.alias("query_id"), "rank", "neighbor_id", "distance")
