import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
import xxhash
from pyspark.sql import functions as F

from statuta.llm import decontam, lm, mih, mixing, packing, pii, queries, simhash, tokens, toxicity, warc
from statuta.llm.common import fold, scratch_dir

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: t.translate({i: i + 32 for i in range(65, 91)})


def table(data, name):
    return ds.dataset(f"{data}/{name}.parquet").to_table().to_pylist()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# toxicity


def test_toxicity_finds_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.7 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.01 * len(clean)


def test_ftrl_against_a_plain_loop():
    """The same updates, one coordinate after the other."""
    rng = np.random.default_rng(8)
    p = toxicity.Ftrl(alpha=0.7, beta=0.5, l1=0.3, l2=0.2, positive=2.0, epochs=3)
    rows = [sorted(set(rng.integers(0, 40, rng.integers(1, 12)).tolist())) for _ in range(120)]
    toxic = np.array([int(3 in r or 7 in r) for r in rows])
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for row, y in zip(rows, toxic):
            w = {i: weight(i) for i in row}
            g = (1 / (1 + math.exp(-(-1.0 + sum(w.values())))) - y) * (p.positive if y else 1.0)
            for i in row:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in range(40) if weight(i)}
    keys, values = toxicity._fit_features(np.concatenate([np.array(r, np.uint32) for r in rows]), np.array([len(r) for r in rows]), toxic, -1.0, p)
    assert keys.tolist() == sorted(want) and np.allclose(values, [want[i] for i in sorted(want)])


def test_toxicity_counts_repeated_rows_once(spark):
    docs = spark.createDataFrame([(1, "bad words here"), (2, "good words there"), (3, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    many = docs.union(docs.where("doc_id = 1").crossJoin(spark.range(500)).select("doc_id", "text"))
    one, two = toxicity.fit_toxicity(docs, labels, toxicity.Ftrl(l1=0.01)), toxicity.fit_toxicity(many, labels, toxicity.Ftrl(l1=0.01))
    assert one.keys.tolist() == two.keys.tolist() and np.allclose(one.values, two.values) and one.intercept == two.intercept and len(one.keys)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, 0), (3, 0), (None, 1), (8, None), (11, 1)], "doc_id long, toxic int")
    w = toxicity.fit_toxicity(odd, labels)
    got = toxicity.score_toxicity(odd, w, ["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    prior = toxicity.fit_toxicity(odd, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(odd, prior, ["doc_id"]).collect())
    assert toxicity.score_toxicity(none, w, ["doc_id"]).count() == 0


# personal data

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind == "card" and (not 12 <= len(d) <= 19 or sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10):
                continue
            out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def check_pii(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        want = base_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:300]
        kinds = Counter(s.split(":")[0] for s in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in KINDS)
        assert set(want) <= set(r.spans.split(",")) if want else r.n_added or r.spans == ""


def test_pii_against_python(spark, data):
    docs = table(data, "documents")
    got = by_id(queries.op2_pii(spark, data))
    check_pii([got[d["doc_id"]] for d in docs], [d["text"] for d in docs])


def test_pii_odd_texts(spark, odd, none):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("a1.@+-_ ()2é\U0001f600"), 60)) for _ in range(300)]
    texts += ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8", "0001.2.3.0255 256.1.1.1", "+1 2 3 4 5 6 7 8 9 ", "4041894974608795 4041-8949-7460-8796", "a@b.c " * 3000, "9" * 30_000, "1 " * 30_000, "Mail Dr. Anna Smith, call (212) 555-0199 or ssn 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.find_pii(df, ["doc_id"]))
    check_pii([got[i] for i in range(len(texts))], texts)
    assert got[len(texts) - 1].n_added > 0
    rows = pii.find_pii(odd, ["doc_id", "text"]).collect()
    check_pii(rows, [r.text for r in rows])
    assert len(rows) == odd.count() and pii.find_pii(none, ["doc_id"]).count() == 0


# language model


def brute_lm(docs, order, mu):
    """Sequential formula: counts in plain dictionaries, one token after the other."""
    seqs = {i: ["<s>", *[("w", w) for w in SPACE.findall(lower(t or ""))], "</s>"] for i, t, _ in docs}
    c, h = Counter(), Counter()
    for i, _, out in docs:
        if not out:
            s = seqs[i]
            for k in range(1, order + 1):
                for p in range(max(1, k - 1), len(s)):
                    c[tuple(s[p - k + 1 : p + 1])] += 1
            h[("<s>",)] += 1
    ones = {g: n for g, n in c.items() if len(g) == 1}
    n, v = sum(ones.values()), len(ones)
    n1, n2 = sum(x == 1 for x in ones.values()), sum(x == 2 for x in ones.values())
    d = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))

    def prob(hist, w):
        if not hist:
            return (c[(w,)] - d) / n if c[(w,)] else d * v / n
        total = h[hist] if hist == ("<s>",) else c[hist]
        return (c[(*hist, w)] + mu * prob(hist[1:], w)) / (total + mu)

    out = {}
    for i, s in seqs.items():
        score = sum(math.log10(prob(tuple(s[max(0, p - order + 1) : p]), s[p])) for p in range(1, len(s)))
        base = sum(math.log10((c[(w,)] + 1) / (n + v + 1)) for w in s[1:])
        out[i] = (len(s) - 1, sum(c[(w,)] > 0 for w in s[1:]), n, base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_against_formula(spark, data, order, monkeypatch):
    monkeypatch.setattr(lm.Automaton, "STRETCH", 7)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = by_id(lm.score_texts(docs, fold("doc_id", 7) == 2, lm.LmParams(order=order, mu=30.0, block_bytes=50_000)))
    want = brute_lm([(d["doc_id"], d["text"], zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2) for d in table(data, "documents")], order, 30.0)
    assert got.keys() == want.keys()
    for i, (tokens_, known, n, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens_, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_lm_odd_rows(spark, odd, none):
    got = lm.score_texts(odd, fold("doc_id", 7) == 2).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert lm.score_texts(none, fold("doc_id", 7) == 2).count() == 0
    all_out = lm.score_texts(odd, F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known) for r in all_out} == {(0, 0)}


# mixing


def fill(sizes, weights, budget, cap):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while True:
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        level = left / sum(w[x] for x in free)
        for s in over:
            if level * w[s] > cap * sizes[s]:
                target[s] = cap * sizes[s]
                left -= target[s]
                free.discard(s)


def test_mixing_targets_and_words(spark, odd, data):
    for df in (spark.read.parquet(f"{data}/documents.parquet"), odd):
        rows = mixing.mix_sources(df, [3.0, 1.0, 2.0]).collect()
        assert len(rows) == df.count()
        sizes, taken = Counter(), Counter()
        for r in rows:
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r["size"]
        want = fill(dict(sizes), [3, 1, 2], 1.5, 2)
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        for s in sizes:
            assert abs(taken[s] - want[s]) <= 0.5 + 1e-9
        again = mixing.mix_sources(df, [3.0, 1.0, 2.0]).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_empty(none):
    assert mixing.mix_sources(none, [3.0, 1.0, 2.0]).count() == 0


def test_repeat_mixed_cuts_words(spark):
    docs = spark.createDataFrame([(1, " a b\tc d ", 9)], "doc_id long, text string, n_chars long")
    mixed = spark.createDataFrame([(1, 4, 10)], "doc_id long, size long, taken long")
    got = mixing.repeat_mixed(docs, mixed, "doc_id", docs.columns).collect()
    assert sorted(r.text for r in got) == [" a b\tc d ", " a b\tc d ", "a b"]


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, window):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text or ""))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add("null" if item is None else str(item))
    out = []
    for text in docs:
        w, hit, found = WORD.findall(lower(text or "")), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000])
def test_decontamination(spark, odd, none, data, block_bytes):
    p = decontam.Winnow(block_bytes=block_bytes, piece_words=40)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    more = spark.createDataFrame([(900, "one"), (901, "another text of seven"), (None, "a b c " * 9), (902, None), (903, ""), (904, "x y " * 200)], "item_id long, text string")
    docs = docs.union(odd.select("doc_id", "text")).union(spark.createDataFrame([(70, "A-b C a b, c a b c a b c"), (71, "x y " * 6)], docs.schema))
    bench = bench.unionByName(more)
    rows = decontam.find_contamination(docs, bench, ["doc_id", "text"], p).collect()
    want = brute_hits([r.text for r in rows], [(r.item_id, r.text) for r in bench.collect()], 10)
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows] == want
    assert len(rows) == docs.count() and any(r.contaminated for r in rows)
    assert decontam.find_contamination(none, bench, ["doc_id"]).count() == 0
    assert not any(r.contaminated for r in decontam.find_contamination(odd, bench.limit(0), ["doc_id"]).collect())


# token ids


def test_tokens_round_trip(spark, odd, none, data):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    p = tokens.TokenParams(public_tokenizers.path("word_bpe_49k.json"), seq_len=64)
    real = spark.read.parquet(f"{data}/documents.parquet")
    for df in (real, odd):
        root = scratch_dir(spark)
        files = tokens.write_tokens(df, root, p)
        got = tokens.read_tokens(spark, root).orderBy("start").collect()
        given = sorted([(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()], key=lambda r: (r[0] is not None, r[0] or 0))
        assert [r.doc_id for r in got] == [i for i, _ in given]
        at, want = 0, Counter()
        for r in got:
            assert r.start == at
            at += r.n_tokens
        for i, t in given:
            ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4")
            want[i, len(ids), zlib.crc32(ids)] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        assert files.agg(F.sum("tokens")).first()[0] == at
    root = root.removeprefix("file:")
    shard = files.orderBy(F.desc("tokens")).first()
    f = tokens.TokenFile(f"{root}/tokens-{shard.shard:07d}.arrow")
    assert len(f) == shard.sequences and sum(sum(f[i][1].to_pylist()) for i in range(len(f))) == shard.tokens
    ids, mask = f[0]
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata
    empty = scratch_dir(spark)
    tokens.write_tokens(none, empty, p)
    assert tokens.read_tokens(spark, empty).count() == 0


# simhash


def brute_fp(text):
    w = [x.encode() for x in SPACE.findall(lower(text or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_against_pairs(spark, odd, none, data):
    for df in (spark.read.parquet(f"{data}/documents.parquet"), odd):
        rows = simhash.near_duplicates(df, ["doc_id", "text"]).collect()
        assert len(rows) == df.count()
        fps = [brute_fp(r.text) for r in rows]
        assert [r.fp % (1 << 64) for r in rows] == fps
        assert [r.component_id for r in rows] == brute_components([r.doc_id for r in rows], fps)
    assert simhash.near_duplicates(none, ["doc_id"]).count() == 0


@pytest.mark.parametrize("code,crowd", [(None, 50_000), ((3, 4), 50_000), ((2, 5), 50_000), ((5, 3), 50_000), ((4, 4), 50_000), ((2, 3), 50_000), ((3, 4), 40), ((5, 3), 7)])
def test_links_at_every_distance(spark, code, crowd):
    rng = np.random.default_rng(11)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    fps = set(seeds)
    for s in seeds:
        for d in (1, 3, 4, 5, 8):
            fps.add(s ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    chain = seeds[0]
    for i in range(0, 48, 4):  # a chain whose ends are far apart, and a dense ball
        chain ^= 0b1111 << i
        fps.add(chain)
    fps |= {seeds[1] ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    roots = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, code, crowd)).collect()}
    arr = np.array(signed, np.int64).view(np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4
    label = np.arange(len(arr))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(arr))])
        if (new == label).all():
            break
        label = new
    groups = defaultdict(set)
    for x, g in zip(signed, label):
        groups[g].add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


# WARC


def test_warc_round_trip(spark, data):
    pages = table(data, "pages")
    rows = [(p["page_id"], p["url"], p["html"]) for p in pages]
    rows += [(9001, "u", rows[3][2]), (8000, None, rows[3][2]), (9002, "e", None), (9003, "e", ""), (None, "http://x/\r\n ü", "late"), (9004, "a", "late"), (9005, "t", "twice"), (9005, "s", "twice"), (9005, "s", "twice")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    root = scratch_dir(spark)
    files = warc.write_warc(df, root, warc.WarcParams(roll_bytes=20_000)).collect()
    got = warc.read_warc(spark, root).collect()
    assert len(got) == len(rows) and sum(f.records for f in files) == len(rows) and max(f.bytes for f in files) < 60_000
    first = {}
    for i, u, h in rows:
        key = (i is None, i or 0, u is None, u or "")
        first[h or ""] = min(first.get(h or "", (key, i)), (key, i))
    want = Counter()
    for i, u, h in rows:
        p = (h or "").encode()
        again = (i is None, i or 0, u is None, u or "") != first[h or ""][0]
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[h or ""][1] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    again = scratch_dir(spark)
    assert sorted(files) == sorted(warc.write_warc(df.repartition(7), again, warc.WarcParams(roll_bytes=20_000)).collect())
    empty = scratch_dir(spark)
    warc.write_warc(df.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


# top k


def test_exact_top_k(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in table(data, "embeddings")]
    rows += [(1000 + i, rows[100][1]) for i in range(40)] + [(None, rows[0][1]), (2000, None), (3000, [0.5, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit(1))
    got = mih.top_k(df, df.where("vec_id % 100 = 0"), 10).collect()
    codes = {i: sum(1 << b for b, x in enumerate(v) if x > 0) for i, v in rows if i is not None and v and None not in v}
    answers = defaultdict(list)
    for r in sorted(got):
        answers[r.query_id].append((r.distance, r.neighbor_id))
    asked = [i for i in codes if i % 100 == 0]
    assert sorted(answers) == sorted(asked)
    for q in asked:
        assert answers[q] == sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items())[:10]
    few = df.limit(3)
    assert mih.top_k(few, few, 10).count() == 9
    assert mih.top_k(df.limit(0), df.limit(0), 10).count() == 0


# sharding


def test_packing(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hot = docs.unionByName(spark.range(10_000, 11_000).select(F.col("id").alias("doc_id"), F.lit("the same text " * 200).alias("text")), allowMissingColumns=True)
    for df in (docs, hot, odd):
        rows = packing.pack_shards(df).collect()
        texts = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r.doc_id].append(((r.text or "").encode()))
        assert len(rows) == df.count()
        slots, sizes = defaultdict(list), Counter()
        for r in rows:
            assert (r["size"] - 1, r.text_crc32) in {(len(t), zlib.crc32(t)) for t in texts[r.doc_id]} and r.law == "bytes"
            slots[r.shard].append(r.slot)
            sizes[r.shard] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if df is not odd:
            assert max(sizes.values()) < 1.03 * min(sizes.values()) and len(sizes) == 16
    assert packing.pack_shards(none).count() == 0


def test_key_packing():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 1000):
        for top in (1 << 30, 1 << 50, (1 << 64) - 1):
            for low in (5, 4):
                keys = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True) & ~np.uint64(0 if low == 5 else 0xFF))
                assert (lm._unpack_keys(lm._pack_keys(keys, low), low) == keys).all()
        counts = rng.choice([0, 1, 2, 254, 255, 256, 1 << 40], n)
        assert (lm._unpack_counts(lm._pack_counts(counts), n) == counts).all()


def test_lm_repeated_rows(spark):
    """Equal rows travel as one: they count as often as they occur, and each has its row."""
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "c d"), (None, None)], "doc_id long, text string")
    many = docs.union(docs.where("doc_id = 1").crossJoin(spark.range(99)).select("doc_id", "text"))
    got = lm.score_texts(many, F.lit(False), lm.LmParams(mu=2.0)).collect()
    want = brute_lm([(i, r.doc_id and r.text, False) for i, r in enumerate(many.collect())], 3, 2.0)
    assert Counter((r.n_tokens, round(r.score, 9)) for r in got) == Counter((w[0], round(w[4], 9)) for w in want.values())
    assert len(got) == 102 and {r.train_tokens for r in got} == {next(iter(want.values()))[2]}


def test_lm_rows_follow_the_blocks(spark, data):
    """Rows that blocks send are as many for each block, whatever the number of blocks."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one = lm._count_block(pa_docs(docs.collect()), 3, 8)
    two = lm._count_block(pa_docs(docs.collect() * 2), 3, 8)
    assert one.num_rows == two.num_rows <= 256


def pa_docs(rows):
    import pyarrow as pa

    table = pa.record_batch([pa.array([0] * len(rows), pa.int32()), pa.array([r.doc_id for r in rows]), pa.array([False] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([(r.text or "").encode() for r in rows])], names=["block", "doc_id", "held_out", "order", "text"])
    return pa.Table.from_batches(list(lm._pack_docs(iter([table]))))


def test_lm_few_texts_in_many_blocks(spark):
    """Hash ranges that hold longer n-grams alone, all of them counted in one block, send nothing back."""
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = {r.doc_id: r for r in lm.score_texts(docs, F.lit(False)).collect()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        got = {r.doc_id: r for r in lm.score_texts(docs, F.lit(False)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.n_tokens, r.train_tokens) == (want[i].n_tokens, want[i].train_tokens) and abs(r.score - want[i].score) < 1e-9


def test_second_attempt_of_a_task(spark, tmp_path):
    """A task that runs again leaves one file, and a file that no manifest names isn't read."""
    from tokenizers import Tokenizer  # noqa: F401

    p = tokens.TokenParams(public_tokenizers.path("word_bpe_49k.json"), seq_len=8)
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    root = scratch_dir(spark)
    tokens.write_tokens(docs, root, p)
    before = sorted(map(tuple, tokens.read_tokens(spark, root).collect()))
    name = spark.read.parquet(f"{root}/files").first()
    again = tokens._Writer(root, name.shard, p, np.uint16)
    encoder = tokens._encoder(p.tokenizer)
    rows = sorted((r.doc_id, r.n_tokens) for r in tokens.read_tokens(spark, root).collect())
    import pyarrow as pa

    mine = [i for i, _ in rows][: name.docs] if name.shard == 0 else None
    if mine:
        again.add(pa.array(mine), *encoder.ids(pa.array([f"text number {i}" for i in mine]), 1))
        assert again.close()[5] == name.sha1
    stray = tokens._Writer(root, 999, p, np.uint16)
    stray.add(pa.array([7]), *encoder.ids(pa.array(["stray"]), 1))
    stray.close()
    assert sorted(map(tuple, tokens.read_tokens(spark, root).collect())) == before


def test_ranges_cut_inside_a_hot_key(spark):
    from statuta.llm.common import range_bounds, range_shard

    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).cast("long").alias("k"), F.xxhash64("id").alias("t"))
    cuts = range_bounds(df, F.col("k"), F.col("t"), 16)
    rows = df.withColumn("s", range_shard(spark, F.col("k"), F.col("t"), cuts)).collect()
    assert max(Counter(r.s for r in rows).values()) < 600 and len({r.s for r in rows}) == 16
    order = sorted(rows, key=lambda r: (r.k, r.t))
    assert [r.s for r in order] == sorted(r.s for r in rows)
