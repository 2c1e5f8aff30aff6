import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statuta.operators import bm25


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(docs, queries, k, allowed=None):
    held = [(i, Counter(w := words(t)), len(w)) for i, t in docs]
    n, avgdl = len(held), sum(x[2] for x in held) / len(held)
    df = Counter(t for _, c, _ in held for t in c)
    idf = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    mean = sum(idf.values()) / len(idf)
    out = []
    for q, text in queries:
        scores = defaultdict(float)
        for t, qf in Counter(words(text)).items():
            w = idf.get(t, 0.0)
            for i, c, dl in held:
                if t in c and (allowed is None or i in allowed):
                    scores[i] += qf * (0.25 * mean if w < 0 else w) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / avgdl))
        first = sorted((-round(s, 9), i) for i, s in scores.items() if s > 0)[:k]
        out += [(q, i, round(-s, 6), rank) for rank, (s, i) in enumerate(first, 1)]
    return sorted(out)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    return [(i, " ".join(["The"] * rng.randint(0, 3) + rng.choices(vocabulary, [1 / (x + 1) for x in range(300)], k=rng.randint(0, 60)))) for i in range(n)]


def frames(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


class Near(float):
    """Equal up to the order of adding."""

    def __eq__(self, other):
        return abs(self - other) < 1e-5

    __hash__ = None


def hits(df):
    return sorted((r.query_id, r.doc_id, Near(r.score), r["rank"]) for r in df.collect())


QUERIES = [(1, "w200 w3 the w3"), (2, "w0 w1 w2 w250 w251"), (3, "nothing here"), (4, ""), (5, None), (6, "W290, w17-w18"), (7, " ".join(f"w{i}" for i in range(0, 300, 7)))]


@pytest.mark.parametrize("k,shard_bytes", [(1, 16 << 20), (5, 4000), (1000, 4000)])
def test_search_against_the_formula(spark, monkeypatch, k, shard_bytes):
    monkeypatch.setattr(bm25, "SHARD_BYTES", shard_bytes)
    docs = corpus(400, 1) + [(900, None), (901, "")]
    d, q = frames(spark, docs, QUERIES)
    index = bm25.build_bm25(d)
    assert hits(bm25.search_bm25(index, q, k)) == brute(docs, QUERIES, k)
    some = d.where("doc_id % 3 = 0 OR doc_id > 1000")
    assert hits(bm25.search_bm25(index, q, k, some)) == brute(docs, QUERIES, k, {i for i, _ in docs if i % 3 == 0})


def test_segments(spark, tmp_path):
    """Documents that come later change frequencies and lengths for all; an index that was read before stays as it was."""
    docs = corpus(300, 2)
    d, q = frames(spark, docs, QUERIES)
    first = bm25.append_bm25(d.where("doc_id < 100"), str(tmp_path))
    bm25.append_bm25(d.where("doc_id BETWEEN 100 AND 250"), str(tmp_path))
    bm25.append_bm25(d.where("doc_id > 250"), str(tmp_path))
    assert hits(bm25.search_bm25(bm25.read_bm25(spark, str(tmp_path)), q, 8)) == brute(docs, QUERIES, 8)
    assert hits(bm25.search_bm25(first, q, 8)) == brute(docs[:100], QUERIES, 8)
    allowed = d.where("doc_id % 2 = 1")
    assert hits(bm25.search_bm25(bm25.read_bm25(spark, str(tmp_path)), q, 8, allowed)) == brute(docs, QUERIES, 8, {i for i, _ in docs if i % 2})


def test_blocks_and_many_terms(spark, monkeypatch):
    docs = corpus(120, 3)
    d, q = frames(spark, docs, QUERIES)
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 9)
    monkeypatch.setattr(bm25, "FILTER_TERMS", 3)
    assert hits(bm25.search_bm25(bm25.build_bm25(d), q, 4)) == brute(docs, QUERIES, 4)


def test_only_asked_terms_are_read(spark, tmp_path):
    d, q = frames(spark, corpus(50, 4), [(1, "w7 w9")])
    found = bm25.search_bm25(bm25.build_bm25(d, str(tmp_path)), q, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term,[w7,w9])" in plan.replace(" ", "")


def test_lists_that_cannot_matter_are_passed_over():
    """A rare term decides; of the common term only documents that may still win are added."""
    n = 2000
    rare, common = list(range(0, n, 100)), list(range(n))
    t = pa.table({"term": ["rare", "common"], "most": pa.array([5, 1], pa.int32()), "least": pa.array([10, 10], pa.int32()), "docs": [rare, common], "tf": [[5] * len(rare), [1] * n], "dl": [[10] * len(rare), [10] * n]})
    lists = bm25._Lists(t, 10.0, None)
    rows, scores, added = lists.first([("common", 0.1), ("rare", 5.0)], 10)
    assert set(lists.ids.take(pa.array(rows)).to_pylist()) == set(rare) and added <= 2 * len(rare)
    whole = lists.first([("common", 0.1), ("rare", 5.0)], n)
    assert len(whole[0]) == n and whole[2] == n + len(rare)


def test_empty(spark):
    d, q = frames(spark, [], QUERIES)
    assert bm25.bm25(d, q, 3).count() == 0
    d, q = frames(spark, corpus(5, 5), [])
    assert bm25.bm25(d, q, 3).count() == 0


def test_counted_columns(spark):
    found = bm25.term_counts(spark.createDataFrame([(1, "A a b"), (2, None)], "doc_id long, text string"), "doc_id")
    assert sorted(map(tuple, found.collect())) == [(1, 3, "a", 2), (1, 3, "b", 1)]
    assert found.agg(F.sum("tf")).first()[0] == 3
