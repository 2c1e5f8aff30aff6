"""Shards by vector bin packing: bytes, tokens and rows are balanced together.

Rows of equal text are a group, and a group goes to the shard where the dot product of its and the shard's residual vector,
both in shares of the total, is highest. Groups over a small part of a shard (by bytes or rows; a bounded number) are placed
first, largest first, on the driver; only one that is larger than a shard is split, by a hash of the id. All other groups
are dealt by a hash of the text into blocks of bounded size, and each block places its own, largest first, against its share
of what the large ones have left of every shard: so blocks are packed side by side, and shards come out as even as blocks do.
Rows get gapless slots from the rows of earlier blocks in their shard and their place in the block, so no task holds a shard.

The law held is ``bytes``: sizes near equal. Nulls and odd rows: a null text has no bytes, size 1 and the checksum of an empty
one, with which it shares a group; rows of equal text and id stay together; null ids come first in an item; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, tidy
from .mixing import WORD


@dataclass(frozen=True)
class PackParams:
    """pieces: a group over 1 / pieces of a shard, by bytes or rows, is placed first; one over a shard is split into items of
    that size. block_groups: small groups that a block packs, about. slices: parts in which a block's share of a shard is numbered."""

    shards: int = 16
    pieces: int = 128
    block_groups: int = 20_000
    slices: int = 16


def pack(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """``items``: a row (bytes, tokens, rows) each, in shares of all -> shard of each, by the highest dot product with
    ``residual`` (a row per shard), which is used up."""
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items[:, 0])):
        room = residual[:, 0]
        # bytes are the law: a shard without room for them is chosen only if none has
        fit = np.where(room >= items[i, 0], residual @ items[i], -np.inf)
        best = int(fit.argmax())
        out[i] = best if fit[best] > -np.inf else int(room.argmax())
        residual[out[i]] -= items[i]
    return out


@tidy
def pack_shards(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, for every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    slim = materialize(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"), F.xxhash64(text).alias("h"),
    ))
    groups = materialize(slim.groupBy("h").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    *total, count = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "tokens", "rows")], F.count("*")).first()
    total = np.maximum(np.array(total, float), 1)
    piece = total / (params.shards * params.pieces)
    parts = F.greatest(F.ceil(F.col("bytes") / piece[0]), F.ceil(F.col("rows") / piece[2])).cast("int")
    # each has over a piece of the bytes or of the rows: at most 2 * shards * pieces of them
    large = materialize(groups.where((F.col("bytes") > piece[0]) | (F.col("rows") > piece[2])).select("h", parts.alias("parts"), (F.col("bytes") * params.shards > total[0]).alias("split")))
    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.col("parts"))
    in_large = materialize(slim.join(F.broadcast(large), "h").select("doc_id", "size", "text_crc32", "tokens", "h", "split", part.cast("int").alias("part")))
    # parts of a group that fits a shard stay together; they only keep its rows from being numbered in one task
    sums = sorted(in_large.groupBy("h", "part", "split").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect())
    units = [(r.h, r.part if r.split else -1) for r in sums]
    place = {u: i for i, u in enumerate(dict.fromkeys(units))}
    whole = np.zeros((len(place), 3))
    for r, u in zip(sums, units):
        whole[place[u]] += r[3:]
    residual = np.full((params.shards, 3), 1 / params.shards)
    shard = pack(whole / total, residual)
    left = np.maximum(residual, 0)
    left = left / np.maximum(left.sum(0), 1e-12)

    blocks = max(1, math.ceil(count / params.block_groups))
    small = groups.join(F.broadcast(large), "h", "left_anti").withColumn("block", F.pmod(F.xxhash64("h", F.lit(31)), F.lit(blocks)).cast("int"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        items = np.column_stack([table[c].to_numpy() for c in ("bytes", "tokens", "rows")]) / total
        return pa.table({"h": table["h"], "block": table["block"], "shard": pa.array(pack(items, left * items.sum(0)).astype(np.int32)), "rows": table["rows"]})

    filled = materialize(small.groupBy("block").applyInArrow(fill, "h long, block int, shard int, rows long"))
    # places ahead of each item in its shard: large items first, then block by block
    used, ahead = [0] * params.shards, []
    for r, u in zip(sums, units):
        s = int(shard[place[u]])
        ahead.append((r.h, r.part, s, used[s]))
        used[s] += r[5]
    ahead_large = spark.createDataFrame(ahead, "h long, part int, shard int, ahead long")
    # numbered by slices of a block's shard, so that few blocks are no few tasks
    filled = filled.withColumn("slice", F.pmod(F.xxhash64("h", F.lit(37)), F.lit(params.slices)).cast("int"))
    per_block = filled.groupBy("block", "slice", "shard").agg(F.sum("rows").alias("n"))
    first = F.element_at(F.array(*map(F.lit, used)), F.col("shard") + 1)
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block", "slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead_small = per_block.select(F.col("block").alias("b"), F.col("slice").alias("c"), F.col("shard").alias("s"), (first + before).cast("long").alias("ahead"))
    order = ("doc_id", "size", "text_crc32")
    rows = in_large.withColumn("rank", F.row_number().over(W.partitionBy("h", "part").orderBy(*order))).join(F.broadcast(ahead_large), ["h", "part"])
    rest = slim.join(filled.select("h", "block", "slice", "shard"), "h").withColumn("rank", F.row_number().over(W.partitionBy("block", "slice", "shard").orderBy(*order)))
    rest = rest.join(ahead_small, (rest.block == ahead_small.b) & (rest["slice"] == ahead_small.c) & (rest.shard == ahead_small.s))
    out = [c.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")) for c in (rows, rest)]
    return out[0].unionByName(out[1])
