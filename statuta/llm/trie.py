"""Prefix trie of conversations: every distinct sequence of first turns is a node, and ROLLUP aggregates all of them together.

Each turn (role, text) has an id: two 64-bit hashes and its bytes. A conversation's turns stand side by side in blocks of
``WIDTH`` columns t1 to t8; a longer one goes on in further blocks, whose key is the node at which the block before ended (the
xor of the hashes of (depth, turn) up to there, 128 bits). One GROUP BY key, ROLLUP(t1, ..., t8) thus makes all nodes of all
blocks, however long the conversations, and grouping_id() tells a node's depth. Equal conversations and common first turns
are summed in the map tasks, as ROLLUP's aggregates are.

What a node tells about its subtree is also a sum over its members, so no task walks the tree. A node belongs to its smallest
member; what belongs to a conversation c is the end of c's own path. So the text of a node's subtree, each node once, is that
of the nodes that belong to its members, less what its own member has above it; and its leaves are members that own a leaf.
That takes a second ROLLUP, over what the first has found of every conversation.

The ids of conversations that end at a node are joined by ranges of 65,536 ids (no more can be in one) and their hash is then
taken as a stream, range by range, so that no task ever holds all ids of a node where a third of all conversations end.

Turns are numbered by ``carried``, so one very long conversation is no single task. Nulls and odd rows: rows of a null id
take no part; a null role or text is empty; null turns come first and turns of equal number go by their hashes; equal rows
are so many turns; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.carried import Running, carried

from .common import materialize, shuffle_partitions, tidy

#: Columns of a block.
WIDTH = 8
#: Conversation ids of one range, whose decimal forms make one string.
IDS = 65_536


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a, b (the turn's hashes), bytes (of its text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    given = conversations.where("conv_id IS NOT NULL")
    return given.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def rebuild(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation as the first ``head`` turns of conversation ``base`` and its own turns after its first ``head``.

    ``turns`` has places from 1 -> (conversations: conv_id, length; their turns: conv_id, depth, a, b, bytes). ``base`` and
    ``head`` are expressions of conv_id; ``head`` is at most ``most``, a small number.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"base": base, "head": head})
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = sizes.join(of_base, "base", "left").withColumn("taken", F.least("head", F.coalesce("of_base", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))))
    keep = ("conv_id", F.col("depth").cast("long").alias("depth"), "a", "b", "bytes")
    first = turns.where(F.col("place") <= most).withColumnsRenamed({"conv_id": "base", "place": "depth"})
    first = first.join(convs.select("base", "conv_id", "taken"), "base").where(F.col("depth") <= F.col("taken")).select(*keep)
    rest = turns.join(convs.select("conv_id", "head", "taken"), "conv_id").where(F.col("place") > F.col("head"))
    rest = rest.withColumn("depth", F.col("taken") + F.col("place") - F.col("head")).select(*keep)
    return convs.select("conv_id", "length"), first.unionByName(rest)


def _step(depth: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """What a turn adds to the hashes of the node before it."""
    return tuple(F.xxhash64(F.lit(seed), depth.cast("long"), a, b) for seed in (3, 4))


def blocks(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conversation and WIDTH turns of it: conv_id, block, k1, k2 (the node before it), above (bytes up to
    there), x, y, n (what the block adds to these), t1 ... (turn ids, null after the last). Conversations without turns have one."""
    x, y = _step(F.col("depth"), F.col("a"), F.col("b"))
    slots = turns.select("conv_id", F.floor((F.col("depth") - 1) / WIDTH).alias("block"), ((F.col("depth") - 1) % WIDTH).alias("slot"), "a", "b", "bytes", x.alias("x"), y.alias("y"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("a", "b", "bytes", "x", "y")]
    none = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("slot"), *zero)
    at = [F.min(F.when(F.col("slot") == i - 1, F.col(c))).alias(f"{c}{i}") for i in range(1, WIDTH + 1) for c in ("a", "b", "bytes")]
    own = slots.unionByName(none).groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("n"), *at)
    run = carried(own, ["conv_id"], ["block"], {"k1": Running("xor", "x"), "k2": Running("xor", "y"), "above": Running("sum", "n")})
    run = run.withColumns({"k1": F.expr("k1 ^ x"), "k2": F.expr("k2 ^ y"), "above": F.expr("above - n")})
    turn = [F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"bytes{i}").alias("bytes"))).alias(f"t{i}") for i in range(1, WIDTH + 1)]
    return run.select("conv_id", "block", "k1", "k2", "above", "x", "y", "n", *turn)


def _rollup(rows: DataFrame, values: str) -> DataFrame:
    """A row for each node: depth, n1, n2 (its id), p1, p2 (its parent's), above (bytes before its text), bytes (of its text)
    and ``values``, aggregates over its members."""
    turns = [f"t{i}" for i in range(1, WIDTH + 1)]
    found = rows.sparkSession.sql(
        f"""SELECT block, k1, k2, above, {", ".join(turns)}, CAST({WIDTH} - bit_count(grouping_id()) AS INT) AS place, {values}
        FROM {{rows}} GROUP BY block, k1, k2, above, ROLLUP({", ".join(turns)})""",
        rows=rows,
    )
    last = F.get(F.array(*turns), F.col("place") - 1)
    # block 0 alone has the root; a block's other row without turns is the node that the block before has; turns end where a conversation does
    found = found.where(((F.col("place") == 0) & (F.col("block") == 0)) | last.isNotNull())
    depth = F.col("block") * WIDTH + F.col("place")
    steps = [_step(F.col("block") * WIDTH + i, F.col(f"{t}.a"), F.col(f"{t}.b")) for i, t in enumerate(turns, 1)]
    ids = {}
    for side, name in enumerate(("1", "2")):
        node, parent = F.col(f"k{name}"), F.col(f"k{name}")
        for i, t in enumerate(turns, 1):
            node = node.bitwiseXOR(F.when(F.col(t).isNotNull(), steps[i - 1][side]).otherwise(0))
            parent = parent.bitwiseXOR(F.when(F.col(t).isNotNull() & (F.col("place") > i), steps[i - 1][side]).otherwise(0))
        ids |= {f"n{name}": node, f"p{name}": F.when(depth > 0, parent)}
    above = F.col("above")
    for i, t in enumerate(turns, 1):
        above = above + F.when(F.col("place") > i, F.coalesce(F.col(f"{t}.bytes"), F.lit(0))).otherwise(0)
    named = [F.col(c) for c in found.columns if c not in {"block", "k1", "k2", "above", "place", *turns}]
    return found.select(depth.alias("depth"), *[c.alias(n) for n, c in ids.items()], above.alias("above"), F.coalesce(last["bytes"], F.lit(0)).alias("bytes"), *named)


def _ends(ends: DataFrame) -> DataFrame:
    """n1, n2, conv_id -> n1, n2, ends_sha256 of the ids that end at a node, in ascending order."""
    part = F.shiftright("conv_id", 16)
    text = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    parts = ends.groupBy("n1", "n2", part.alias("part")).agg(text.alias("ids"))
    parts = parts.repartition(shuffle_partitions(ends.sparkSession), "n1", "n2").sortWithinPartitions("n1", "n2", "part")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            done = []
            for n1, n2, ids in zip(*(b.column(c).to_pylist() for c in ("n1", "n2", "ids"))):
                if node == (n1, n2):
                    sha.update(b",")
                else:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (n1, n2), hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["n1", "n2", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], names=["n1", "n2", "ends_sha256"])

    return parts.mapInArrow(digest, "n1 long, n2 long, ends_sha256 string")


@tidy
def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``convs`` (conv_id, length), ``turns`` (conv_id, depth from 1, a, b, bytes) -> a row for each node of their trie:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialize(blocks(convs, turns))
    nodes = materialize(_rollup(rows, "count(*) AS n_convs, min(conv_id) AS conv_id"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    node = ["depth", "n1", "n2"]
    nodes = materialize(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # of each conversation: its end, its bytes, the bytes and the leaves that belong to it
    owned = nodes.groupBy("conv_id").agg(F.sum("bytes").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    paths = rows.groupBy("conv_id").agg(F.bit_xor("x").alias("n1"), F.bit_xor("y").alias("n2"), F.sum("n").alias("total"))
    paths = materialize(paths.join(owned, "conv_id", "left").na.fill(0, ["owned", "leaves"]))
    members = rows.join(paths.select("conv_id", "total", "owned", "leaves"), "conv_id")
    sums = _rollup(members, "sum(total) AS totals, sum(owned) AS all_owned, sum(leaves) AS n_leaves").select(*node, "totals", "all_owned", "n_leaves")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums, node).join(paths.select("conv_id", "total", "owned"), "conv_id").join(parents, ["depth", "p1", "p2"], "left")
    found = found.join(_ends(paths.select("n1", "n2", "conv_id")), ["n1", "n2"], "left")
    # each member's bytes from here on, less each node's once: those that belong to members, of the own member from here on
    saved = F.expr("totals - n_convs * above - (all_owned - owned + total - above)")
    long = {"conv_id": F.col("conv_id"), "depth": F.col("depth"), "parent_conv_id": F.col("parent_conv_id"), "n_convs": F.col("n_convs"), "n_children": F.col("n_children"), "n_leaves": F.col("n_leaves"), "saved_tokens": saved}
    return found.select(*[c.cast("long").alias(n) for n, c in long.items()], F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1, by turn), a, b, bytes."""
    found = carried(turn_ids(conversations), ["conv_id"], ["turn", "a", "b"], {"place": Running("count")})
    return materialize(found.drop("turn"))


@tidy
def rebuilt_trie(conversations: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), each rebuilt as ``rebuild`` says."""
    return prefix_trie(*rebuild(numbered(conversations), base, head, most))
