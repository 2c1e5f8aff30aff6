import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from statuta.llm import queries, spans
from statuta.llm.spans import SpanParams, remove_repeats, repeated_windows


def brute(texts, length):
    """n_bytes, n_removed, n_spans, kept_sha256, kept of each."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def removed(df, params):
    found = remove_repeats(df, ["doc_id"], params, kept=True)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    return sorted((tuple(r)[:5] + (bytes(r.kept),) for r in found.collect()), key=str)


def wanted(rows, length):
    return sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], length))), key=str)


def test_transform_against_counting():
    rng = random.Random(1)
    for _ in range(200):
        length, letters = rng.choice([1, 2, 3, 5, 8, 13]), rng.choice([b"a", b"ab", b"abc\x00\xff", bytes(range(256))])
        segments = [bytes(rng.choice(letters) for _ in range(rng.randint(length, 40))) for _ in range(rng.randint(1, 12))]
        segments += [s for s in (segments[0], segments[-1][1:] + b"a") if rng.random() < 0.5 and len(s) >= length]
        seen = Counter(s[i : i + length] for s in segments for i in range(len(s) - length + 1))
        assert [list(map(bool, x)) for x in repeated_windows(segments, length)] == [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in segments]


def test_equal_windows_have_one_hash():
    """Runs cover each window once, and the smallest hash of a window doesn't depend on where it is."""
    rng = random.Random(2)
    p = SpanParams(20, 8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(20, 90))) for _ in range(60)]
    of, start, count, value, _, _ = spans._runs_of(texts, p)
    found, times = {}, Counter()
    for o, s, n, v in zip(of, start, count, value):
        for i in range(s, s + n):
            times[o, i] += 1
            assert found.setdefault(texts[o][i : i + 20], v) == v
    assert times == Counter((o, i) for o, t in enumerate(texts) for i in range(len(t) - 19))
    assert len(np.unique(spans.string_hashes(np.frombuffer(b"".join(texts), np.uint8), 13))) == len({b"".join(texts)[i : i + 13] for i in range(sum(map(len, texts)) - 12)})


def planted(rng):
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, pair, line = prose(40), prose(30), "-" * 300
    rows = [(i, prose(rng.randint(0, 80))) for i in range(60)]
    rows += [(100 + i, prose(20) + common + prose(20)) for i in range(60)]  # a passage that many share
    rows += [(200, prose(5) + pair), (201, pair + prose(9)), (202, pair + pair), (203, pair[:-1]), (204, line), (205, "x" + line + line), (206, line[:49])]
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1])]  # equal texts, equal rows
    return rows + [(None, None), (None, pair + "!"), (400, ""), (401, None)]


@pytest.mark.parametrize("params", [SpanParams(50, 16), SpanParams(50, 4, 3000), SpanParams(50, 32, 200), SpanParams(7, 4)])
def test_spans_against_counting(spark, params):
    """Large shards, shards of few runs, and hashes that fill a shard alone."""
    rows = planted(random.Random(4))
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, start long, key string, count int")
    assert removed(df, params) == wanted(rows, params.length)


def test_a_window_of_very_many_runs_is_split(spark):
    """The join of windows with repeated ones is one whose skewed partitions Spark splits; its ranges are the counted ones."""
    rng = random.Random(6)
    common = bytes(rng.choice(b"abcdefgh") for _ in range(50))
    runs = [(7, i, 1 + (i == 5), common + rng.randbytes(2)) for i in range(3_000)] + [(7, 3_000, 1, rng.randbytes(60)), (7, 3_001, 2, rng.randbytes(50))]
    seen = Counter()
    for _, _, copies, data in runs:
        seen.update({data[i : i + 50]: copies for i in range(len(data) - 49)})
    expected = {(7, seg, i) for _, seg, _, data in runs for i in range(len(data) - 49) if seen[data[i : i + 50]] > 1}
    held = {"autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for k, v in held.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        df = spans._by_windows(spark.createDataFrame(runs, "value long, seg long, copies long, data binary").repartition(8), 50)
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in held:
            spark.conf.unset(f"spark.sql.{k}")
    assert sum(r["count"] for r in rows) == len(expected)
    assert {(r.value, r.seg, i) for r in rows for i in range(r.start, r.start + r["count"])} == expected
    assert "skew=true" in plan


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    rows = [(1, base), (2, base[:9_000] + "#" + base[9_000:20_000]), (3, base[100:900] * 3), (4, "z" * 20_000)]
    monkeypatch.setattr(spans, "BLOCK", 4096)
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), SpanParams()) == wanted(rows, 400)


def test_odd_rows(spark, odd, odd_rows, none):
    assert removed(odd, SpanParams()) == wanted(odd_rows, 400)
    assert removed(none, SpanParams()) == []


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_suffix_dedup(spark, data)
    assert sorted(map(tuple, found.collect())) == sorted(x[:5] for x in wanted(rows, 400))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("spans_")]
