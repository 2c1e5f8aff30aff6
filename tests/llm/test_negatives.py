import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.llm import queries
from statuta.llm.negatives import Lists, MineParams, hard_negatives

COLUMNS = "vec_id long, embedding array<double>, label int, score long, key long, window string, anchor_id int"


def brute(rows, anchor, positives=5, negatives=3):
    kept = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, a in kept:
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in kept)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            found = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, j, rank, n, -s, -m) for rank, (m, n, _) in enumerate(found, 1)]
    return sorted(out)


def mined(df, every, params=MineParams()):
    found = hard_negatives(df, F.col("vec_id") % every == 0, params=params)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("params", [MineParams(), MineParams(shard_bytes=4000, block=7), MineParams(positives=2, negatives=1)])
def test_negatives_against_all_pairs(spark, params):
    """Ties, a label with a third of all rows, repeated ids and rows, vectors of few values."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], 0 if i % 3 == 0 else rng.randint(0, 4)) for i in range(400)]
    rows += rows[:30] + [(10, [1.0] * 6, 2), (10, [0.25] * 6, 3), (20, [0.5] * 6, rows[20][2])]
    df = spark.createDataFrame([(*r, 1, 2, "w", 3) for r in rows], COLUMNS)
    assert mined(df, 10, params) == brute(rows, lambda i: i % 10 == 0, params.positives, params.negatives)


def test_odd_vectors(spark):
    """Nulls in any column, components that aren't finite, zeros, other lengths, very large components, labels of one row."""
    inf, nan = float("inf"), float("nan")
    rows = [
        (None, [1.0, 2.0], 1), (0, None, 1), (0, [1.0, None], 1), (0, [nan, 1.0], 1), (0, [inf, 1.0], 1), (0, [-inf, 1.0], 1), (0, [1.0, 2.0], None), (0, [], 1),
        (0, [0.0, 0.0], 1), (10, [1.0, 2.0], 1), (1, [1.0, 2.0, 3.0], 1), (2, [2.0], 1), (3, [0.9, 1.7], 2), (4, [1.0, 1.0, 5.0], 2), (20, [4.0, 4.0], 7), (30, [-1.0, -2.0], 1),
        (40, [1000.0, 0.001], 3), (5, [999.0, 0.001], 3), (6, [800.0, 0.0], 4), (-10, [1.0, 1.0], 2),
    ]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], COLUMNS)
    assert mined(df, 10) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark.createDataFrame([], COLUMNS), 10) == []
    assert mined(df.where("vec_id = 1"), 10) == []
    assert mined(spark.createDataFrame([(0, [1e300] * 3, 1, *[None] * 4), (1, [1e300] * 3, 1, *[None] * 4), (2, [1e300, 9.0, 1.0], 2, *[None] * 4)], COLUMNS), 10) == []


def test_reading_stops_at_the_threshold():
    """Few of many rows stand out: the lists are read a short way, and what is found is what all rows would give."""
    rng = np.random.default_rng(1)
    x = rng.integers(-5, 6, (20_000, 8))
    x[rng.choice(20_000, 40, replace=False)] *= 20
    ids = rng.permutation(20_000)
    lists = Lists(ids, x)
    for a in (np.array([3, -2, 0, 1, 0, 0, 5, -1]), np.array([0, 0, 0, 0, 0, 0, 0, 9])):
        scores = x @ a
        for windows in ([[-(10**6), 10**6]], [[300, 10**6], [100, 290]]):
            found, met = lists.search(a, 3, np.array(windows))
            for (least, most), (s, i) in zip(windows, found):
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                want = inside[np.lexsort((ids[inside], -scores[inside]))][:3]
                assert list(s) == list(scores[want]) and list(i) == list(ids[want])
            assert met < 10_000


def test_query(spark, data):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, data).collect())) == brute(rows, lambda i: i % 50 == 0)
