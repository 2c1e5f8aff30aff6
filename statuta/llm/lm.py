"""Language-model scores by a weighted backoff automaton.

The model is a smoothed n-gram model. Single words are discounted: P_1(w) = (c(w) - D) / N for known words and
D V / N for the unknown word, with D = n1 / (n1 + 2 n2) from the numbers of words seen once and twice. Longer ones have Dirichlet
smoothing: P_k(w | h) = (c(hw) + mu P_{k-1}(w | h')) / (c(h) + mu), h' being h without its first word. Each P_k sums to
one over the vocabulary and one unknown word. As an automaton: a state for each history that training text holds, an arc
for each n-gram with the log-probability above, and from each state a failure arc of weight
log10(mu / (c(h) + mu)) to the state of h'. A text is read once from left to right: the state carried is the longest
history known so far; while it has no arc for the next word, its failure arc is taken.

Nothing of the corpus goes to the driver or to every executor. Texts are dealt by a hash into blocks of bounded size; a
block lists its distinct n-grams with their training counts, packed into one row per hash range; each hash range is added
up over all blocks; and a block gets back the totals that differ from its own counts. So a block's slice of the
automaton is exact and as large as the block. There are 2^8 hash ranges, more only where a range would hold the n-grams
of over ``bucket_bytes`` of text: so a block makes as many rows at any size up to some GB, and beyond that rows get smaller, to
some forty n-grams at a TB (larger blocks make them larger again). Words are told apart by 64-bit hashes, longer n-grams by 56 bits.

Nulls and odd rows: a null text is an empty one, which holds its end token only; a null id is a training row; repeated
rows count as often as they occur and each gets a score (equal rows of a batch travel as one with their number); an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, shuffle_partitions, text_bytes, tidy

_U64 = np.uint64
_START, _END = _U64(0x5354415254), _U64(0x454E44)


@dataclass(frozen=True)
class LmParams:
    """order: longest n-gram; mu: weight of the lower order in counts; block_bytes: text in a block; bucket_bytes: text whose
    n-grams a hash range holds, about."""

    order: int = 3
    mu: float = 300.0
    block_bytes: int = 8 << 20
    bucket_bytes: int = 16 << 20


def _grams(texts: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Ends of the texts in the token sequence (start and end tokens included), and for each k the k-gram ending at
    each position with whether there is one. A gram may begin with the start token but isn't the start token alone."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    coded = cut.flatten().dictionary_encode()
    known = coded.dictionary.view(pa.binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in known), _U64, len(known))
    code = coded.indices.to_numpy()
    real = np.array([len(w) > 0 for w in known], bool)[code]  # white space at a text's ends leaves an empty word
    upto = np.concatenate(([0], np.cumsum(real)))[cut.offsets.to_numpy()]
    sizes = np.diff(upto) + 2
    ends = np.cumsum(sizes)
    h = np.full(int(sizes.sum()), _END)
    h[ends - sizes] = _START
    inside = np.ones(len(h), bool)
    inside[ends - sizes] = inside[ends - 1] = False
    h[inside] = hashes[code[real]]
    place = np.arange(len(h)) - np.repeat(ends - sizes, sizes)  # 0: the start token
    grams, there, whole = [h], [place > 0], h
    for k in range(2, order + 1):
        g = np.zeros_like(h)
        g[1:] = mix(whole[:-1] + _U64(k), h[1:])
        whole = g
        grams.append(g & ~_U64(0xFF))
        there.append(place >= k - 1)
    return ends, grams, there


def _pack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, docs): a batch's documents of each block as one compressed Arrow stream, equal rows once with their number n."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
    for batch in batches:
        _, first, n = np.unique(batch.column(3).to_numpy(), return_index=True, return_counts=True)
        table = pa.Table.from_batches([batch]).take(pa.array(first)).append_column("n", pa.array(n.astype(np.int32)))
        block, rest = table["block"].to_numpy(), table.drop_columns(["block"])
        order = np.argsort(block, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            if len(own):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema, options=options) as out:
                    out.write_table(rest.take(pa.array(own)))
                yield pa.RecordBatch.from_arrays([pa.array([block[own[0]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])


def _unpack_docs(table: pa.Table) -> pa.Table:
    """The documents of a block, in an order that doesn't depend on how they arrived."""
    docs = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["docs"]]).combine_chunks()
    return docs.take(pa.array(np.argsort(docs["order"].to_numpy(), kind="stable")))


def _pack_keys(keys: np.ndarray, low: int) -> bytes:
    """Sorted keys as the steps of their upper 24 bits, which are small, and the next ``low`` bytes; the rest is zero."""
    if not len(keys):
        return b""
    high = (keys >> _U64(40)).astype(np.int64)
    steps = np.diff(high)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if steps.max(initial=0) <= np.iinfo(k).max)
    rest = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 5 - low : 5]
    return bytes([np.dtype(kind).itemsize]) + int(high[0]).to_bytes(3, "little") + steps.astype(kind).tobytes() + rest.tobytes()


def _unpack_keys(data: bytes, low: int) -> np.ndarray:
    if not data:
        return np.zeros(0, _U64)
    size = data[0]
    n = (len(data) - 4 + size) // (size + low)
    steps = np.frombuffer(data, f"<u{size}", n - 1, 4)
    high = np.cumsum(np.append(int.from_bytes(data[1:4], "little"), steps.astype(np.int64)))
    rest = np.zeros((n, 8), np.uint8)
    rest[:, 5 - low : 5] = np.frombuffer(data, np.uint8, n * low, 4 + (n - 1) * size).reshape(n, low)
    return rest.view("<u8").ravel() | high.astype(_U64) << _U64(40)


def _low(k: int) -> int:
    """Bytes of a key below its upper 24 bits: words have 64 bits, longer n-grams 56."""
    return 5 if k == 1 else 4


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; 255 stands for one of the larger counts at the end."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", -1, n).astype(np.int64) if len(data) > n else 0
    return counts


def _cuts(keys: np.ndarray, bits: int) -> list[int]:
    """Where the sorted keys of each bucket begin; a bucket has the keys of equal high bits."""
    return np.searchsorted(keys >> _U64(64 - bits) if bits else np.zeros_like(keys), np.arange((1 << bits) + 1, dtype=_U64)).tolist()


_LISTED = "bucket int, block int, keys array<binary>, counts array<binary>"
_TOLD = "block int, bucket int, marks array<binary>, totals array<binary>, tokens long, types long, once long, twice long"


def _distinct(g: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct grams with their training counts; the order that sorts all, and where each distinct one begins in it."""
    order = np.argsort(g)
    ranked = g[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(g) else np.zeros(0, np.int64)
    counts = np.add.reduceat(taught[order], first) if len(g) else np.zeros(0, np.int64)
    return ranked[first], counts, order, first


def _listed(docs: pa.Table, order: int, places: bool = False):
    """The texts' grams (``_grams``), and for each k the distinct ones with their training counts and, if asked for, the number of the gram that ends at each place."""
    train = ~docs["held_out"].to_numpy()
    ends, grams, there = _grams(docs["text"].combine_chunks(), order)
    taught = np.repeat((train * docs["n"].to_numpy()).astype(np.int64), np.diff(ends, prepend=0))
    found, at = [], []
    for g, ok in zip(grams, there):
        here = np.flatnonzero(ok)
        keys, counts, by, first = _distinct(g[here], taught[here])
        found.append((keys, counts))
        if places:
            number = np.zeros(len(g), np.int64)
            number[here[by]] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
            at.append(number)
    return ends, there, found, at


def _count_block(given: pa.Table, order: int, bits: int) -> pa.Table:
    """A row for each hash range: the block's distinct k-grams with their counts, k = 1, 2, ..."""
    block, found = given["block"][0].as_py(), _listed(_unpack_docs(given), order)[2]
    cuts = [_cuts(keys, bits) for keys, _ in found]
    rows = []
    for b in range(1 << bits):
        own = [(keys[c[b] : c[b + 1]], counts[c[b] : c[b + 1]]) for (keys, counts), c in zip(found, cuts)]
        if any(len(k) for k, _ in own):
            rows.append((b, block, [_pack_keys(keys, _low(k)) for k, (keys, _) in enumerate(own, 1)], [_pack_counts(c) for _, c in own]))
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "block", "keys", "counts"])


def _merge_bucket(table: pa.Table) -> pa.Table:
    """Totals over blocks: to each block a bit for every gram it listed, set if the total differs from its own count, and those
    totals. Block -1 has the bucket's sums for the whole corpus."""
    blocks, listed, counted = table["block"].to_pylist(), table["keys"].to_pylist(), table["counts"].to_pylist()
    bucket, orders = table["bucket"][0].as_py(), len(listed[0])
    told: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in blocks]
    sums_of_words = (0, 0, 0, 0)
    for k in range(1, orders + 1):
        keys = [_unpack_keys(x[k - 1], _low(k)) for x in listed]
        counts = np.concatenate([_unpack_counts(x[k - 1], len(own)) for x, own in zip(counted, keys)])
        ends = np.cumsum([len(x) for x in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts[order], first) if len(keys) else counts
        if k == 1:
            sums_of_words = (int(sums.sum()), *(int(x.sum()) for x in (sums > 0, sums == 1, sums == 2)))
        total = np.empty_like(counts)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        for (marks, totals), i, j in zip(told, [0, *ends[:-1]], ends):
            tell = total[i:j] != counts[i:j]
            marks.append(np.packbits(tell).tobytes() if tell.any() else b"")
            totals.append(zlib.compress(total[i:j][tell].astype("<u8").tobytes(), 1) if tell.any() else b"")
    rows = [(-1, bucket, [], [], *sums_of_words)] + [(block, bucket, m, t, 0, 0, 0, 0) for block, (m, t) in zip(blocks, told) if any(m)]
    kinds = [pa.int32()] * 2 + [pa.list_(pa.binary())] * 2 + [pa.int64()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _TOLD.split(", ")])


@dataclass(frozen=True)
class Corpus:
    """Training tokens, distinct ones, and those of them seen once and twice."""

    tokens: int
    types: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return min(0.95, max(0.05, self.once / max(1, self.once + 2 * self.twice)))

    @property
    def unknown(self) -> float:
        return self.discount * self.types / self.tokens if self.tokens else 1.0


class Automaton:
    """The slice of the backoff automaton that a block's texts can reach.

    Grams are numbered per order. arc[k][g]: log10-probability of the arc of k-gram g, NaN if the model has none;
    fail[k][g]: weight of the failure arc of the state of k-gram g, NaN if there is no such state.
    """

    def __init__(self, at, there, totals, corpus: Corpus, mu: float):
        self.order, self.at, self.count = len(at), at, totals
        keys, c = totals[0]
        p = np.where(c > 0, (c - corpus.discount) / max(1, corpus.tokens), corpus.unknown)
        self.arc, self.fail = [np.log10(p)], []
        starts = int(c[np.searchsorted(keys, _END)])  # a start token for each end token
        self.fail_start = math.log10(mu / (starts + mu))
        for k in range(2, self.order + 1):
            keys, c = totals[k - 1]
            ok = np.flatnonzero(there[k - 1])
            where = np.zeros(len(keys), np.int64)
            where[self.at[k - 1][ok]] = ok  # a place where the gram ends
            history = totals[k - 2][1][self.at[k - 2][where - 1]].astype(float)
            if k == 2:
                history[~there[0][where - 1]] = starts
            elif k > 2:
                history[~there[k - 2][where - 1]] = 0
            p = (c + mu * p[self.at[k - 2][where]]) / (history + mu)
            self.arc.append(np.where(c > 0, np.log10(p), np.nan))
            lower = totals[k - 2][1].astype(float)
            self.fail.append(np.where(lower > 0, np.log10(mu / (lower + mu)), np.nan))

    def walk(self, ends: np.ndarray, there: list[np.ndarray]) -> np.ndarray:
        """log10-probability that each position adds, 0 at start tokens: one pass from left to right that carries the state.

        Texts go side by side, long ones in stretches; a stretch that begins inside a text first walks the order - 1 words
        before it, which settle the state. The state carried is its number of words (0: the root): with the place it is
        the state. While it has no arc for the next word, its failure arc is taken.
        """
        # by place: the arc that ends there for each order, and the failure arc of the state that ends there
        none = np.full(len(self.at[0]), np.nan)  # also where the block has no gram of an order
        arcs = [np.where(ok, arc[at], np.nan) if len(arc) else none for arc, at, ok in zip(self.arc, self.at, there)]
        fails = [none] + [f[at] if len(f) else none for f, at in zip(self.fail, self.at)]
        if self.order > 1:
            fails[1] = np.where(there[0], fails[1], self.fail_start)
        starts = np.concatenate(([0], ends[:-1]))
        parts = -(-(ends - starts - 1) // self.STRETCH)
        text = np.repeat(np.arange(len(ends)), parts)
        scored = starts[text] + 1 + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * self.STRETCH
        stop = np.minimum(scored + self.STRETCH, ends[text])
        first = np.maximum(scored - (self.order - 1), starts[text] + 1)
        by = np.argsort(first - stop, kind="stable")  # the longest first, so that those still going are a prefix
        first, scored, stop = first[by], scored[by], stop[by]
        state = np.where((first - 1 == starts[text][by]) & (self.order > 1), 1, 0)
        out = np.zeros(len(self.at[0]))
        for t in range(int((stop - first).max(initial=0))):
            going = int(np.searchsorted(first - stop, -t, side="left"))
            place, k = first[:going] + t, state[:going] + 1
            added = np.zeros(going)
            todo = np.arange(going)
            for n in range(self.order, 0, -1):
                here = todo[k[todo] == n]
                if len(here):
                    arc = arcs[n - 1][place[here]]
                    lost = np.isnan(arc)
                    added[here[~lost]] += arc[~lost]
                    if lost.any():
                        back = here[lost]
                        added[back] += fails[n - 1][place[back] - 1]
                        k[back] -= 1
            # an unknown word leads to the root, the longest n-gram to the state of its last words
            if self.order > 1:
                k[(k == 1) & np.isnan(fails[1][place])] = 0
            state[:going] = np.minimum(k, self.order - 1)
            own = place >= scored[:going]
            out[place[own]] = added[own]
        return out

    #: Positions of a text that are walked one after the other; the stretches of a block go side by side.
    STRETCH = 256


def _score_block(given: pa.Table, model: pa.Table, p: LmParams, bits: int, corpus: Corpus) -> pa.Table:
    docs = _unpack_docs(given)
    ends, there, totals, at = _listed(docs, p.order, places=True)
    cuts = [_cuts(keys, bits) for keys, _ in totals]
    for bucket, marks, told in zip(model["bucket"].to_pylist(), model["marks"].to_pylist(), model["totals"].to_pylist()):
        for k in range(p.order):
            if marks[k]:
                i, j = cuts[k][bucket], cuts[k][bucket + 1]
                differ = np.unpackbits(np.frombuffer(marks[k], np.uint8), count=j - i).astype(bool)
                totals[k][1][i + np.flatnonzero(differ)] = np.frombuffer(zlib.decompress(told[k]), "<u8").astype(np.int64)
    auto = Automaton(at, there, totals, corpus, p.mu)
    starts = np.concatenate(([0], ends[:-1]))
    known = totals[0][1][auto.at[0]]
    base = np.where(there[0], np.log10((known + 1) / (corpus.tokens + corpus.types + 1)), 0)
    add = lambda a: np.add.reduceat(a, starts)
    return pa.table({
        "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": add(there[0].astype(np.int64)), "n_known": add((there[0] & (known > 0)).astype(np.int64)),
        "train_tokens": np.full(len(docs), corpus.tokens, np.int64), "base_score": add(base), "score": add(auto.walk(ends, there)), "n": docs["n"],
    })


def score_texts(docs: DataFrame, held_out, params: LmParams = LmParams()) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) with a model of the rows where ``held_out`` isn't true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, add one) and score.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(math.ceil(size / params.block_bytes), shuffle_partitions(spark))
    bits = max(8, math.ceil(math.log2(max(1, size / params.bucket_bytes))))
    given = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    order = F.xxhash64("doc_id", "text", "held_out", F.lit(1)).alias("order")
    dealt = given.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "held_out", order, text_bytes().alias("text"))
    packed = dealt.mapInArrow(_pack_docs, "block int, docs binary")
    counts = packed.groupBy("block").applyInArrow(lambda t: _count_block(t, params.order, bits), _LISTED)
    model = materialize(counts.groupBy("bucket").applyInArrow(_merge_bucket, _TOLD))
    corpus = Corpus(*(x or 0 for x in model.where("block = -1").agg(*map(F.sum, ("tokens", "types", "once", "twice"))).first()))
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n int"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score_block(left, right, params, bits, corpus)

    # every block of the model has documents
    scored = packed.groupBy("block").cogroup(model.where("block >= 0").groupBy("block")).applyInArrow(score, out)
    return scored.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
