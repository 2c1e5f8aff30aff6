"""What a task holds beside its rows: workers share an executor's memory with the JVM's whole heap."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from statuta.llm import toxicity


def _shard(rng, rows, common, alone):
    """Sorted features of each row: some of a few that many share, the others of that row alone."""
    own = [np.unique(np.concatenate([rng.integers(0, 500, common), 1000 + r * alone + np.arange(alone)])).astype(np.uint32) for r in range(rows)]
    return np.concatenate(own), np.array([len(x) for x in own]), np.array([int(7 in x) for x in own])


def test_features_of_one_row_take_no_memory_in_a_fit():
    keys, sizes, toxic = _shard(np.random.default_rng(1), 1000, 60, 1500)
    tracemalloc.start()
    try:
        found, _ = toxicity._fit_features(keys, sizes, toxic, -1.0, toxicity.Ftrl())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 7 in found.tolist() and peak < 6 * keys.nbytes


def test_features_without_a_place_would_have_had_no_weight(monkeypatch):
    """The same weights as with a place for each feature, also where one row can pass the penalty."""
    every = lambda keys, sizes, p: (*np.unique(keys, return_inverse=True), np.cumsum(np.concatenate(([0], sizes))))
    for seed, p in enumerate([toxicity.Ftrl(), toxicity.Ftrl(l1=0.5), toxicity.Ftrl(l1=12.0), toxicity.Ftrl(l1=30.0, positive=0.5)]):
        rng = np.random.default_rng(seed)
        for shard in (_shard(rng, 300, 12, 20), _shard(rng, 1, 3, 4), (np.zeros(0, np.uint32), np.zeros(3, np.int64), np.zeros(3, np.int64))):
            got = toxicity._fit_features(*shard, -1.0, p)
            with monkeypatch.context() as m:
                m.setattr(toxicity, "_coordinates", every)
                want = toxicity._fit_features(*shard, -1.0, p)
            assert got[0].tolist() == want[0].tolist() and np.allclose(got[1], want[1])


def test_texts_are_taken_a_megabyte_at_a_time():
    texts = pa.array([b"x" * 100_000] * 100, pa.binary())
    assert max(sum(map(len, g)) for _, g in toxicity._groups(texts)) <= 1 << 20


def test_a_text_is_sent_once_with_its_row(spark, odd, none):
    weights = toxicity.Weights(np.zeros(0, np.uint32), np.zeros(0, np.float32), -1.0)
    boxed = corpus_pipeline._boxed(odd.where("doc_id is not null or text is not null or lang is null"))
    once = toxicity.score_toxicity(boxed, weights, ["__row"], row="__row")
    assert "__text" not in once._jdf.queryExecution().optimizedPlan().toString()
    word = toxicity._features([b"one"], toxicity.WordHashes())[0]
    weights = toxicity.Weights(word, np.ones(1, np.float32), -1.0)
    scores = lambda df: sorted(map(str, df.select(F.col("__row.doc_id"), F.col("__row.text"), "score").collect()))
    got = scores(toxicity.score_toxicity(boxed, weights, ["__row"], row="__row"))
    assert got == scores(toxicity.score_toxicity(boxed, weights, ["__row"])) and len({x.rpartition("=")[2] for x in got}) == 2
    assert scores(toxicity.score_toxicity(corpus_pipeline._boxed(none), weights, ["__row"], row="__row")) == []
