"""Hard negatives by Fagin's threshold algorithm, exact and in whole numbers.

Each component x becomes floor(256 x) and a score is an inner product of such integers. Rows are dealt by label into shards
of bounded size. A shard keeps, for each dimension, its rows in the order of that component. For an anchor these lists are read
from the end that its own component's sign favours, all in step; every row met is scored at once by random access, and the
threshold, the sum of the anchor's components times the values reached, bounds the score of every row not met. Reading stops
once the threshold lies strictly below the kth score of every window asked for (strictly: a row that ties may have a smaller
id), or below the window's least score where it has fewer rows. What all shards found is then merged by score and id.

First each anchor's shards of its own label are read for its positives; each positive then sets a window of scores, and the
shards of all other labels are read for the best rows inside each window, all windows of an anchor in one reading. Anchors are
a stated query set: they go out in blocks of ``block`` rows and each block's rows are written before the next starts.

Nulls and odd rows: rows of a null id or label, a null vector, or with a null or non-finite component take no part. Rows equal
in id, label and vector count once; an anchor never has a row of its own id as a positive; several rows of one id with other
contents are rows of their own, as anchors too. Shorter vectors count as ending in zeros. Components beyond 2**26 in size are
held at that, so that scores fit 64 bits. An anchor without positives gives no rows; a positive with a negative score has no
window; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Components are held within this.
LARGEST = 1 << 26
#: Labels whose numbers of shards are broadcast, at most.
LABELS = 100_000
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class MineParams:
    """positives, negatives: how many. low, high: a negative's score in hundredths of the positive's. shard_bytes: of the
    rows and lists that a task holds, about. block: anchors that are broadcast at a time."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    shard_bytes: int = 64 << 20
    block: int = 4096


def usable(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, v: arrays of floor(256 x), of the rows that take part; ``label`` replaces the given one."""
    v = F.col("embedding").cast("array<double>")
    given = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    given = given.where(F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * 256), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long"))
    return given.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), whole.alias("v")).distinct()


class Lists:
    """A shard's rows and, for each dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.sort(x, axis=0).T
        self.size = int(np.abs(x).max(initial=0))
        self.real = x.astype(np.float64)

    def scores(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        if self.size * int(np.abs(a).max(initial=0)) * len(a) < 1 << 53:  # whole numbers are exact in doubles
            return (self.real[rows] @ a.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ a

    def search(self, a: np.ndarray, k: int, windows: np.ndarray, own: int | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window (least, most score) the k best rows in it as (scores, ids), and how many rows were scored. ``own``:
        an id that isn't looked for."""
        n = len(self.ids)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        met = np.zeros(n, bool)
        score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, 16
        while True:
            to = min(n, depth + step)
            now = np.zeros(n, bool)
            now[self.order[up, n - to : n - depth].ravel()] = True
            now[self.order[down, depth:to].ravel()] = True
            if to == n:
                now[:] = True  # also where the anchor has no component but zeros
            now &= ~met
            met |= now
            rows = np.flatnonzero(now)
            score, ids = np.concatenate([score, self.scores(rows, a)]), np.concatenate([ids, self.ids[rows]])
            keep = (score >= windows[:, 0].min()) & (score <= windows[:, 1].max())
            if own is not None:
                keep &= ids != own
            score, ids = score[keep], ids[keep]
            by = np.lexsort((ids, -score))
            score, ids = score[by], ids[by]
            first = np.searchsorted(-score, -windows[:, 1], side="left")
            last = np.minimum(np.searchsorted(-score, -windows[:, 0], side="right"), first + k)
            if to == n:
                break
            bound = int(a[up] @ self.values[up, n - to]) + int(a[down] @ self.values[down, to - 1])
            full = last - first == k
            floor = np.where(full, score[np.maximum(last - 1, 0)] if len(score) else 0, windows[:, 0])
            if (bound < floor).all():
                break
            depth, step = to, 2 * step
        return [(score[i:j], ids[i:j]) for i, j in zip(first, last)], int(met.sum())


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    sizes, out = np.concatenate([np.diff(c.offsets.to_numpy()) for c in vectors.chunks]), np.zeros((len(vectors), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = np.concatenate([c.flatten().to_numpy() for c in vectors.chunks])
    return out


def _search(shards: DataFrame, anchors: list[dict], dims: int, k: int, same: bool) -> DataFrame:
    """Every shard's best rows for the anchors: key, window, score, id. ``anchors``: key, vec_id, label, v, windows (lists of
    least, most). ``same``: in shards of the anchor's own label, else in all others."""
    asking = [(a["key"], a["vec_id"], a["label"], np.array(a["v"] + [0] * (dims - len(a["v"])), np.int64), np.array(a["windows"], np.int64)) for a in anchors if a["windows"]]
    sent = shards.sparkSession.sparkContext.broadcast(asking)

    def run(t: pa.Table) -> pa.Table:
        label = t["label"][0].as_py()
        mine = [x for x in sent.value if (x[2] == label) == same]
        out = [(np.zeros(0, np.int64),) * 4]
        lists = Lists(t["vec_id"].to_numpy(), _matrix(t["v"], dims)) if mine else None
        for key, own, _, a, windows in mine:
            for i, (scores, ids) in enumerate(lists.search(a, k, windows, own if same else None)[0]):
                out.append((np.full(len(ids), key), np.full(len(ids), i), scores, ids))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["key", "window", "score", "id"])

    return shards.groupBy("label", "part").applyInArrow(run, "key long, window long, score long, id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Of what all shards found, the first k of each anchor's windows."""
    place = F.row_number().over(W.partitionBy("key", "window").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


@tidy
def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, params: MineParams = MineParams()) -> DataFrame:
    """``vectors`` (vec_id, embedding, label); ``anchor``, a condition on vec_id, says which rows ask; ``label`` replaces the
    label -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark, p = vectors.sparkSession, params
    rows = usable(vectors, label)
    rows = materialize(rows)
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    asked = rows.where(F.coalesce(anchor, F.lit(False)))
    blocks = -(-asked.count() // p.block)
    if dims < 1 or not blocks:
        return spark.createDataFrame([], SCHEMA)
    parts = rows.groupBy("label").agg(F.ceil(F.count("*") * (32 * dims) / p.shard_bytes).alias("parts"))
    shards = materialize(rows.join(F.broadcast(parts) if parts.count() <= LABELS else parts, "label").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts")))
    block = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks))
    found = []
    for i in range(blocks):
        anchors = [r.asDict() | {"key": key} for key, r in enumerate(sorted(asked.where(block == i).collect()))]  # about ``block`` rows
        found.append(materialize(_mine(shards, anchors, dims, p)))
    return reduce(DataFrame.unionByName, found)


def _mine(shards: DataFrame, anchors: list[dict], dims: int, p: MineParams) -> DataFrame:
    for a in anchors:
        a["windows"] = [[-(1 << 62), 1 << 62]]
    best = _best(_search(shards, anchors, dims, p.positives, True), p.positives).collect()  # ``positives`` for each anchor of a block
    positives = []
    for a in anchors:
        a["windows"] = []
    for r in sorted(best, key=lambda r: (r.key, r.place)):
        least, most = -(-p.low * r.score // 100), p.high * r.score // 100
        if least <= most:
            a = anchors[r.key]
            positives.append((r.key, len(a["windows"]), a["vec_id"], r.id, r.score))
            a["windows"].append([least, most])
    named = shards.sparkSession.createDataFrame(positives, "key long, window long, anchor_id long, positive_id long, positive_score long")
    kept = _best(_search(shards, anchors, dims, p.negatives, False), p.negatives).join(F.broadcast(named), ["key", "window"])
    return kept.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
