"""SimHash near-duplicates through anchor points of a covering code.

A fingerprint has 64 bits: bit i is one if over half of the text's shingles (four words; XXH64, seed 42) have it. Texts
link if their fingerprints differ in at most ``threshold`` = 4 bits. Equal fingerprints are put together first. The 64
bits are cut into segments; two linked fingerprints differ by at most t = threshold // segments bits in one of them. On
each segment the anchors are the words of a code of covering radius one (a Hamming code on the first 2^r - 1 bits, the
others free). A fingerprint has its home at the anchor within distance one and visits every anchor within 1 + t: so one
of two linked fingerprints visits the home of the other. Per anchor, homes are compared with visitors on all 64
bits. The number of segments and r follow the number of fingerprints by a cost estimate; the result does not depend on
them.

Of the links at an anchor only a spanning set goes on (each fingerprint to the smallest one that it is joined with), so a
large group of near copies gives rows in proportion to its size, not to its square. A crowded anchor's visitors are dealt to
parts, tasks of their own that each have its homes. Components come from alternating star
contractions, and a component is named by its smallest doc_id.

Nulls and odd rows: null and empty texts have fingerprint zero and link like any other; null ids are left out of the
smallest id (a component of them alone has a null name); repeated rows get the same component; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, materialize, shuffle_partitions, text_bytes, tidy

_U64 = np.uint64
_PAIRS = 2_000_000


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit majority fingerprint of a text's shingles, counted with repeats."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[: n - 1])).tolist()
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        h = np.fromiter((digest(line[a:b], 42) for a, b in zip(first[i : i + 65_536], last[i : i + 65_536])), "<u8", min(65_536, n - i))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((1 << np.arange(64, dtype=object))[counts * 2 > n].sum())


def with_fingerprint(docs: DataFrame, keep: list[str], shingle: int = 4) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint of ``shingle`` words as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(len(keep))), _U64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, text_bytes().alias("__text")).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())]))


class CoveringCode:
    """Code words of ``bits`` bits whose first 2^r - 1 form a Hamming word; covering radius 1 (r = 0: every word, radius 0)."""

    def __init__(self, bits: int, r: int, beyond: int):
        self.checked = (1 << r) - 1
        self.r, self.radius = r, min(r, 1)
        reach = [0]
        for _ in range(self.radius + beyond):
            reach += [m ^ (1 << b) for m in reach for b in range(bits)]
        # the flips within reach that lead from a word of this syndrome to a code word
        by: list[list[int]] = [[] for _ in range(1 << r)]
        for m in set(reach):
            by[int(self.syndrome(np.array([m], _U64))[0])].append(m)
        self.visits = [np.array(sorted(x, key=lambda m: (m.bit_count(), m)), _U64) for x in by]

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), _U64)
        for b in range(self.checked):
            s ^= ((x >> _U64(b)) & _U64(1)) * _U64(b + 1)
        return s.astype(np.int64)


def _layout(segments: int) -> list[tuple[int, int]]:
    cuts = [64 * i // segments for i in range(segments + 1)]
    return list(zip(cuts, [b - a for a, b in zip(cuts, cuts[1:])]))


def choose_code(n: int, threshold: int) -> tuple[int, int]:
    """(segments, r) with the least estimated work: rows at anchors, at 10 comparisons a row, and comparisons."""

    def work(segments: int, r: int) -> float:
        bits, t = 64 // segments, threshold // segments
        anchors = 2.0 ** (bits - r)
        rows = segments * (1 + sum(comb(bits, i) for i in range(min(r, 1) + t + 1)) / 2**r)
        return n * rows * 10 + segments * n * n * rows / segments / anchors

    return min(((s, r) for s in range(1, threshold + 2) for r in (3, 4, 5) if (1 << r) - 1 <= 64 // s and threshold // s <= 2), key=lambda x: work(*x))


def _labels(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest node that each of 0 .. size - 1 is joined with by the edges (a, b)."""
    label = np.arange(size)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _compare(fps: np.ndarray, home: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links among the fingerprints at one anchor, block by block."""
    homes = fps[home]
    step = max(1, _PAIRS // max(1, len(homes)))
    for i in range(0, len(fps), step):
        v = fps[i : i + step]
        x, y = np.nonzero(np.bitwise_count(v[:, None] ^ homes[None, :]) <= threshold)
        yield v[x], homes[y]


def _span(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest that it is joined with, if that is another."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = _labels(at[: len(u)], at[len(u) :], len(nodes))
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _place(codes: list[tuple[int, int, CoveringCode]], crowded: dict[int, int]):
    """Rows (anchor, fp, home): each fingerprint at all anchors that it visits; an anchor's number holds its part and its segment."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy().view(_U64)
                for s, (start, bits, c) in enumerate(codes):
                    x = fp >> _U64(start) & _U64((1 << bits) - 1)
                    syndrome = c.syndrome(x)
                    for y, flips in enumerate(c.visits):
                        own = np.flatnonzero(syndrome == y)
                        if len(own):
                            anchors = ((x[own, None] ^ flips[None, :]).ravel() << _U64(3) | _U64(s)).view(np.int64)
                            home = np.tile(np.arange(len(flips)) == 0, len(own))  # the nearest code word is the first
                            who = np.repeat(fp[own], len(flips))
                            if crowded:
                                parts = np.fromiter((crowded.get(a, 1) for a in anchors.tolist()), np.int64, len(anchors))
                                copies = np.where(home, parts, 1)
                                nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                                own_part = (who * _U64(0x9E3779B97F4A7C15) >> _U64(40)).astype(np.int64) % parts
                                part = np.where(np.repeat(home, copies), nth, np.repeat(own_part, copies))
                                anchors, home, who = xor_part(np.repeat(anchors, copies), part), np.repeat(home, copies), np.repeat(who, copies)
                            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(who.view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return place


def xor_part(anchors: np.ndarray, part: np.ndarray) -> np.ndarray:
    """An anchor's number for a part of it: itself for part 0. Equal numbers of unlike parts would only be compared in vain."""
    return anchors ^ (part.astype(_U64) * _U64(0xD1B54A32D192ED03)).view(np.int64)


def fingerprint_links(fps: DataFrame, threshold: int = 4, code: tuple[int, int] | None = None, crowd: int = 50_000) -> DataFrame:
    """``fps`` (fp: distinct longs) -> spanning links (a, b) of fingerprints within ``threshold`` bits, through anchors."""
    count = max(1, fps.count())
    segments, r = code or choose_code(count, threshold)
    codes = [(start, bits, CoveringCode(bits, r, threshold // segments)) for start, bits in _layout(segments)]
    crowd = max(crowd, math.ceil(count * segments * max(len(v) for _, _, c in codes for v in c.visits) / 10_000))
    # at most 10,000 anchors have more rows than that: their visitors are dealt to parts, and their homes go to each part
    sizes = fps.select("fp").mapInArrow(_place(codes, {}), "anchor long, fp long, home boolean").groupBy("anchor").count()
    crowded = {x.anchor: math.ceil(x["count"] / crowd) for x in sizes.where(F.col("count") > crowd).collect()}
    placed = fps.select("fp").mapInArrow(_place(codes, crowded), "anchor long, fp long, home boolean")
    n = max(shuffle_partitions(fps.sparkSession), 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one anchor arrive together; a run that ends a batch waits for the next batch."""
        held: list[pa.RecordBatch] = []
        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            a, b = _span(np.concatenate([np.zeros(0, _U64), *us]), np.concatenate([np.zeros(0, _U64), *vs]))
            us.clear()
            vs.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor, fp, home = table["anchor"].to_numpy(), table["fp"].to_numpy().view(_U64), table["home"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]))
            homes = np.add.reduceat(home.astype(np.int64), cuts[:-1])
            sizes = np.diff(cuts)
            small = sizes * homes <= 4096
            # many small anchors at once: all (home, visitor) places of each, in groups of a bounded number
            pick = np.flatnonzero(small & (homes > 0) & (sizes > 1))
            work_sum = np.cumsum(sizes[pick] * homes[pick])
            home_at = np.flatnonzero(home)
            home_from = np.concatenate(([0], np.cumsum(homes)))
            lo = 0
            while lo < len(pick):
                hi = max(lo + 1, int(np.searchsorted(work_sum, (work_sum[lo - 1] if lo else 0) + _PAIRS)))
                g = pick[lo:hi]
                per = sizes[g] * homes[g]
                run = np.repeat(np.arange(len(g)), per)
                k = np.arange(len(run)) - np.repeat(np.cumsum(per) - per, per)
                v, h = fp[cuts[g][run] + k // homes[g][run]], fp[home_at[home_from[g][run] + k % homes[g][run]]]
                near = (np.bitwise_count(v ^ h) <= threshold) & (v != h)
                us.append(v[near])
                vs.append(h[near])
                lo = hi
                if sum(map(len, us)) > _PAIRS:
                    yield flush()
            for g in np.flatnonzero(~small):
                for u, v in _compare(fp[cuts[g] : cuts[g + 1]], np.flatnonzero(home[cuts[g] : cuts[g + 1]]), threshold):
                    us.append(u[u != v])
                    vs.append(v[u != v])
                    if sum(map(len, us)) > _PAIRS:
                        a, b = _span(np.concatenate(us), np.concatenate(vs))
                        us[:], vs[:] = [a], [b]

        for batch in batches:
            held.append(batch)
            anchor = batch.column(0).to_numpy()
            if len(anchor) and anchor[0] != anchor[-1] and sum(b.num_rows for b in held) > 50_000:
                table = pa.Table.from_batches(held)
                cut = table.num_rows - int(np.argmax(np.flip(anchor) != anchor[-1]))
                yield from work(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield from work(table.combine_chunks())
        yield flush()

    dealt = placed.repartition(n, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) -> (node, root): each linked node with the smallest of its component.

    Alternating stars: first every node's larger neighbours, then its smaller ones, are tied to the smallest of
    its neighbourhood, until nothing changes. Each step is one grouped minimum and one join.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of its own, so that the join may split the rows of a node with very many neighbours
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        # equal edges in two rounds, told by their number and an order-free sum of hashes: stars have been reached
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


@tidy
def near_duplicates(docs: DataFrame, keep: list[str], threshold: int = 4, shingle: int = 4) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id among them), ``fp`` and ``component_id``, for every row."""
    rows = materialize(with_fingerprint(docs, keep, shingle))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(classes, threshold))
    named = classes.join(roots, classes.fp == roots.node, "left").select(classes.fp.alias("f"), "least", F.coalesce("root", classes.fp).alias("root"))
    named = materialize(named)
    names = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = named.join(names, "root").select("f", "component_id")
    return rows.join(named, rows.fp == named.f).select(*keep, "fp", "component_id")
