import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from statuta.llm import queries, trie

COLUMNS = "conv_id long, turn long, role string, text string, place long, depth long, a long, n1 string, block int"


def brute(rows):
    """Nodes of the rebuilt conversations by dictionaries of paths."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        here = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = here + sum(saved[k] for k in kids[path])
        ends = ",".join(str(c) for c in sorted(members[path]) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def built(df):
    found = trie.rebuilt_trie(df, F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9, 8)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def case(rng, long):
    rows = []
    word = lambda: rng.choice(["ja", "né", "ok then", "", None, "x" * 300])
    for c in range(60):
        if c % 11 != 3:
            rows += [(c, t, rng.choice(["user", "bot", None]), word()) for t in range(rng.choice([1, 2, 5, 8, 9, 17, long]))]
    same = [(t, "user" if t % 2 else "bot", f"same {t}") for t in range(20)]
    for c in range(1000, 1100):  # equal conversations, some of which go on
        rows += [(c, *x) for x in same] + ([(c, 50, "user", f"own {c % 7}")] if c % 3 else [])
    rows += [(7, t, "user", "endless") for t in range(100, 100 + long)]
    return rows


@pytest.mark.parametrize("long", [12, 300])
def test_trie_against_dictionaries(spark, long):
    rng = random.Random(long)
    rows = [(*r, 1, 2, 3, "n", 4) for r in case(rng, long)]
    rng.shuffle(rows)
    assert built(spark.createDataFrame(rows, COLUMNS)) == sorted(brute(rows), key=str)


def test_odd_conversations(spark):
    """Null ids, turns, roles and texts; equal rows; conversations that are rebuilt without turns; very long texts."""
    rows = [
        (None, 1, "user", "nobody"), (1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", "z" * 200_000), (2, 1, "user", "same"), (2, 1, "user", "same"),
        (3, 5, "bot", "only"), (4, None, None, None), (4, 2, "é", "İ"), (10**12, 1, "user", "far"), (10**12 + 1, 1, "user", "far"), (70_000, 1, "user", "same"), (70_001, 1, "user", "same"),
    ]
    rows = [(*r, None, None, None, None, None) for r in rows]
    assert built(spark.createDataFrame(rows, COLUMNS)) == sorted(brute(rows), key=str)
    assert built(spark.createDataFrame([], COLUMNS)) == []


def test_ends_in_many_ranges(spark, monkeypatch):
    """Ids of several ranges make one hash, in order, across the batches of a task."""
    ids = [i * 40_000 for i in range(30)] + [5, 7]
    rows = [(c, t, "user", f"t{t}", None, None, None, None, None) for c in ids for t in range(9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert built(spark.createDataFrame(rows, COLUMNS)) == sorted(brute(rows), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query(spark, data):
    rows = list(map(tuple, spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    found = queries.op11_prefix_trie(spark, data)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(rows), key=str)
