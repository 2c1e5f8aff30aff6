"""The registered queries of the corpus operators and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lm, mih, mixing, negatives, packing, pii, simhash, spans, tokens, toxicity, trie, warc
from .common import fold, scratch_dir


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    weights = toxicity.fit_toxicity(docs, labels.where(fold("doc_id", 5) != 0))
    marked = docs.select("doc_id", "text", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return toxicity.score_toxicity(marked, weights, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_read(spark, sf_dir, "documents"), ["doc_id"])


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_read(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"), [3.0, 1.0, 2.0])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), ["doc_id"])


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark)
    tokens.write_tokens(_read(spark, sf_dir, "documents"), root, tokens.TokenParams(public_tokenizers.path("word_bpe_49k.json")))
    return tokens.read_tokens(spark, root)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark)
    warc.write_warc(_read(spark, sf_dir, "pages"), root)
    return warc.read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return mih.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_shards(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return trie.rebuilt_trie(_read(spark, sf_dir, "conversations"), conv - conv % 5, fold("conv_id", 9), 8)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(_read(spark, sf_dir, "documents"), ["doc_id"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, label = F.col("vec_id"), F.col("label")
    return negatives.hard_negatives(_read(spark, sf_dir, "embeddings"), vec % 50 == 0, F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_pii, op3_lm_score, op4_mixing, op5_decontamination, op6_token_ids, op7_simhash, op8_warc, op9_exact_topk, op10_sharding, op11_prefix_trie, op12_suffix_dedup, op13_hard_negatives)
    return {f.__name__: f for f in found}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 2.0 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT arg_min(x.level, x.cap / x.w) FROM l x WHERE x.level * x.w <= x.cap) AS shared FROM l),
t AS (SELECT source, source_size, CASE WHEN shared IS NULL OR shared * w > cap THEN cap ELSE shared * w END AS target FROM f),
g AS (SELECT *, CAST(round(target) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, g.source_size, g.target, g.whole, g.goal - g.whole * g.source_size AS part,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, part - earlier)) AS BIGINT) AS taken FROM r
"""

OP5_SQL = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, dw.n, p, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


OP9_SQL = """
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY d, v.vec_id) AS INT) AS rank, v.vec_id AS neighbor_id, CAST(d AS INT) AS distance
FROM (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings) q, (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings) v,
  LATERAL (SELECT len(list_filter(list_zip(q.s, v.s), lambda p: p[1] <> p[2])) AS d) WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10
"""


OP11_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, coalesce("role", '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY p) AS own FROM t GROUP BY conv_id),
crc AS (SELECT n, CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END AS k, 1 AS i FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS n, unnest(generate_series(0, 255))::BIGINT AS k)
  UNION ALL SELECT n, CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END, i + 1 FROM crc WHERE i < 8),
tab AS (SELECT list(k ORDER BY n) AS tab FROM crc WHERE i = 8),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda z: ord(z)::BIGINT)),
  lambda s, z: xor(tab[(xor(s, z) & 255) + 1], s >> 8)), 4294967295) % 9 AS h FROM c, tab),
b AS (SELECT h.conv_id, list_concat(coalesce(list_slice(o.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS q FROM h LEFT JOIN c o ON o.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, len(q) AS n, unnest(generate_series(0, len(q))) AS d, q FROM b),
k AS (SELECT d AS depth, list_slice(q, 1, d) AS q, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(octet_length(encode(q[d].x)), 0) AS bytes,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM m GROUP BY ALL),
a AS (SELECT k.*, (k.n_convs - 1) * k.bytes AS saved, p.conv_id AS parent_conv_id FROM k LEFT JOIN k p ON k.depth = p.depth + 1 AND list_slice(k.q, 1, k.depth - 1) = p.q),
f AS (SELECT *, NOT EXISTS (SELECT 1 FROM k y WHERE y.depth = a.depth + 1 AND list_slice(y.q, 1, a.depth) = a.q) AS leaf FROM a),
u AS (SELECT list_slice(q, 1, g) AS q, g AS depth, leaf, saved, f.depth AS own FROM (SELECT *, unnest(generate_series(0, depth)) AS g FROM f) f)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, CAST(s.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN (SELECT q, depth, count(*) FILTER (WHERE own = depth + 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY ALL) s ON f.q = s.q AND f.depth = s.depth
"""


OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[]) AS BIGINT) AS score FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op5_decontamination": OP5_SQL, "op9_exact_topk": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_hard_negatives": OP13_SQL}
