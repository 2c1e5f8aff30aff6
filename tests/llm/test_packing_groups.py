from collections import Counter, defaultdict

import numpy as np

from statuta.llm import packing


def check(df, params, parts):
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = packing.pack_shards(df, params).collect()
    size, shards, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in rows:
        size[texts[r.doc_id]] += r["size"]
        shards[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    fits = [t for t in size if size[t] * params.shards <= sum(size.values())]
    assert len(fits) == len(size) - parts and all(len(shards[t]) == 1 for t in fits)
    assert len(rows) == df.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = Counter()
    for r in rows:
        by[r.shard] += r["size"]
    return shards, by


def test_equal_texts_that_fit_share_a_shard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    big = spark.createDataFrame([(10_000 + i, "copied text " * 200) for i in range(40)] + [(20_000 + i, "very hot text " * 200) for i in range(300)], "doc_id long, text string")
    shards, by = check(docs.union(big), packing.PackParams(), 1)
    assert len(shards["very hot text " * 200]) > 1
    assert max(by.values()) < 1.03 * min(by.values())


def test_very_many_empty_texts_are_one_group(spark):
    """A third of all rows in few bytes: numbered in parts, but in one shard."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    empty = spark.range(50_000, 50_500).selectExpr("id as doc_id", "'' as text")
    shards, by = check(docs.union(empty), packing.PackParams(), 0)
    assert len(shards[""]) == 1


def test_small_groups_in_several_blocks(spark):
    """No group is large: every one is placed in its block."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('text ', id div 2, repeat(' word', cast(id div 2 % 7 as int))) as text")
    _, by = check(docs, packing.PackParams(block_groups=700), 0)
    assert len(by) == 16 and max(by.values()) < 1.02 * min(by.values())


def test_groups_go_where_the_dot_product_is_highest():
    rng = np.random.default_rng(4)
    items = rng.random((300, 3))
    items /= items.sum(0)
    residual = np.full((4, 3), 0.25)
    got, left = packing.pack(items, residual.copy()), residual.tolist()
    for i in sorted(range(300), key=lambda i: (-items[i, 0], i)):
        fit = [sum(a * b for a, b in zip(r, items[i])) if r[0] >= items[i, 0] else None for r in left]
        best = max((s for s in range(4) if fit[s] is not None), key=lambda s: fit[s], default=max(range(4), key=lambda s: left[s][0]))
        assert fit[best] is None or abs(fit[best] - (fit[got[i]] if fit[got[i]] is not None else 9)) < 1e-12
        left[got[i]] = [a - b for a, b in zip(left[got[i]], items[i])]
