import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from test_operators import SPACE, brute_hits, fill, lower

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __h string, __key string, __id long, size long, score double"
stage = dict(corpus_pipeline.STAGES)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Documents with nulls in every column, repeated rows, near copies, toxic texts and benchmark passages, and clashing columns."""
    rng = random.Random(3)
    item, rows = words(rng, 30), []
    for i in range(60):
        rows.append((i, words(rng, rng.randint(20, 80)), "en", f"s{i % 3}"))
    base = words(rng, 100)
    near = base.split()
    near[50] = "changed"
    rows += [(60, base, "en", "s0"), (61, " ".join(near), "en", "s1"), (62, base.upper(), "en", "s2"), (63, base, "en", "s0"), (63, base, "en", "s0")]
    rows += [(i, f"{words(rng, 10)} vile slur {words(rng, 10)}", "en", "s1") for i in range(70, 110)]
    rows += [(120, f"{words(rng, 5)} {' '.join(item.split()[8:20])} {words(rng, 5)}", "de", "s2"), (121, f"{words(rng, 5)} {' '.join(item.split()[8:16])} {words(rng, 5)}", "de", "s2")]
    rows += [(None, None, None, None), (None, "a text without an id", None, None), (130, "", "", ""), (131, None, "en", "s1"), (132, words(rng, 20_000), "en", None), (133, "one", "en", "s0"), (2, rows[2][1], "en", "s2")]
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "h", "k", 5, 6, 0.5) for r in rows], COLUMNS)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 0, int(70 <= i < 110)) for i in range(110) if i % 4] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return spark.read.parquet(f"{sf}/documents.parquet"), sf, item


def plain(rows):
    return Counter((r.doc_id, r.text, r.source) for r in rows)


def brute_fp(text):
    w = [x.encode() for x in SPACE.findall(lower(text or ""))]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_toxic_texts_go_and_clean_ones_stay(spark, fixture, monkeypatch):
    docs, sf, _ = fixture
    monkeypatch.setattr(corpus_pipeline.toxicity.fit_toxicity, "__defaults__", (corpus_pipeline.toxicity.Ftrl(l1=1.0),))
    got = stage["toxicity"](spark, docs, sf)
    assert got.columns == docs.columns
    assert plain(got.collect()) == plain([r for r in docs.collect() if "vile slur" not in (r.text or "")])


def test_one_of_each_group_of_near_copies_stays(spark, fixture):
    docs, sf, _ = fixture
    rows = docs.collect()
    fps, root = [brute_fp(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    groups = defaultdict(list)
    for r, g in zip(rows, root):
        groups[g].append(r)
    got = stage["near_duplicates"](spark, docs, sf)
    kept = got.collect()
    assert got.columns == docs.columns and len(kept) == len(groups)
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        mine = [k for k in kept if any((k.doc_id, k.text) == (r.doc_id, r.text) for r in g)]
        assert len(mine) == 1 and mine[0].doc_id == (min(ids) if ids else None)


def test_benchmark_passages_go(spark, fixture):
    docs, sf, item = fixture
    rows = docs.collect()
    hits = brute_hits([r.text for r in rows], [(1, item), (2, None)], 10)
    got = stage["decontamination"](spark, docs, sf)
    assert got.columns == docs.columns
    assert plain(got.collect()) == plain([r for r, h in zip(rows, hits) if not h[-1]]) and sum(h[-1] for h in hits) == 1


def test_sources_come_near_their_targets(spark, fixture):
    docs, sf, _ = fixture
    rows, got = docs.collect(), stage["mixing"](spark, docs, sf)
    size = lambda t: len(SPACE.findall(t or ""))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    texts = {(r.doc_id, r.source): r.text for r in rows}
    for r in got.collect():
        taken[r.source] += size(r.text)
        whole = texts[r.doc_id, r.source]
        assert SPACE.findall(r.text) == SPACE.findall(whole)[: size(r.text)] and r.n_chars == len(r.text)
    want = fill(dict(sizes), [3, 1, 2], 1.5, 2)
    assert got.columns == docs.columns and all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_token_ids_of_all_rows(spark, fixture):
    from tokenizers import Tokenizer

    docs, sf, _ = fixture
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, zlib.crc32(np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))) for r in docs.collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in stage["token_ids"](spark, docs, sf).collect()) == want


def test_run_is_its_stages(spark, fixture, tmp_path):
    docs, sf, _ = fixture
    for name, f in corpus_pipeline.STAGES[:-1]:
        at = str(tmp_path / name)
        f(spark, docs, sf).write.parquet(at)
        docs = spark.read.parquet(at)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(rows) == docs.count() and Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())


def test_empty_tables(spark, fixture):
    docs, sf, _ = fixture
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs.limit(0), sf)
        assert got.count() == 0 and (name == "token_ids" or got.columns == docs.columns)
