"""The registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta import schema
from statuta.functions import ids, tagging, text
from statuta.operators import answers, chunking, conflicts, dedup, embedding, quality, retrieval, rewrite, store, structure
from statuta.sources import readers, records

from . import corpus, views
from .registry import QUERIES, SQL, Query
from .registry import query as _query

_REGS, _HEALTH = corpus.REGULATIONS_SQL, corpus.HEALTH_SQL
_META = ["regulation_id", "version_id", "title", "jurisdiction", "regulation_type", "effective_date", "source_hash"]
_J_SQL = "(VALUES ('EU', 'European Union'), ('UK', 'United Kingdom'), ('US', 'United States'), ('DE', 'Germany'), ('FR', 'France'), ('CA', 'Canada'), ('AU', 'Australia'), ('UNKNOWN', 'Unknown')) j(code, name)"


@_query(f"""WITH {_REGS} SELECT r.jurisdiction, name AS jurisdiction_name, count(DISTINCT regulation_id) AS regulation_count, count(DISTINCT regulation_type) AS type_diversity,
  min(effective_date) AS earliest_date, max(effective_date) AS latest_date, CAST(sum(CASE WHEN version_id > 1 THEN 1 ELSE 0 END) AS BIGINT) AS amendment_count
  FROM regs r LEFT JOIN {_J_SQL} ON r.jurisdiction = code GROUP BY 1, 2""")
def jurisdiction_stats(spark, sf):
    return views.jurisdiction_stats(corpus.regulations(spark, sf), schema.jurisdictions(spark))


@_query(f"WITH {_REGS} SELECT {', '.join(_META)} FROM regs r WHERE version_id = (SELECT max(version_id) FROM regs x WHERE x.regulation_id = r.regulation_id)")
def regulations_latest(spark, sf):
    return views.regulations_latest(corpus.regulations(spark, sf)).select(*_META)


@_query(f"""WITH {_REGS} SELECT regulation_id, title, jurisdiction, version_id, effective_date, lag(source_hash) OVER (PARTITION BY regulation_id ORDER BY version_id) AS prev_hash,
  source_hash AS current_hash FROM regs WHERE regulation_id IN (SELECT regulation_id FROM regs GROUP BY 1 HAVING count(*) > 1)""")
def amendment_history(spark, sf):
    return views.amendment_history(corpus.regulations(spark, sf))


@_query(f"""WITH {_HEALTH} SELECT source, count(*) AS total_runs, CAST(sum(rows_ingested) AS BIGINT) AS total_rows, round(avg(null_rate) * 100, 2) AS avg_null_rate_pct,
  CAST(sum(CASE WHEN NOT sla_met THEN 1 ELSE 0 END) AS BIGINT) AS sla_breaches, CAST(sum(CASE WHEN schema_drift THEN 1 ELSE 0 END) AS BIGINT) AS drift_events, max(run_at) AS last_run_at
  FROM health WHERE run_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAYS GROUP BY source""")
def pipeline_health_recent(spark, sf):
    return views.pipeline_health_recent(corpus.pipeline_health(spark, sf), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


@_query(f"""WITH {_REGS} SELECT (SELECT count(DISTINCT regulation_id) FROM regs) AS regulations, (SELECT count(DISTINCT jurisdiction) FROM regs) AS jurisdictions,
  (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM benchmark) AS conflicts, (SELECT count(*) FROM events) AS runs""")
def total_counts(spark, sf):
    read = lambda n: corpus.read(spark, sf, n)
    return views.total_counts(corpus.regulations(spark, sf), read("embeddings"), read("benchmark"), read("events"))


@_query(f"""WITH {_REGS} SELECT {', '.join(_META)} FROM (SELECT * FROM regs WHERE jurisdiction = 'FR') r WHERE version_id =
  (SELECT max(version_id) FROM regs x WHERE x.regulation_id = r.regulation_id AND x.jurisdiction = 'FR') ORDER BY effective_date DESC NULLS LAST, regulation_id, version_id LIMIT 100""")
def regulation_browser(spark, sf):
    return views.browse(corpus.regulations(spark, sf), jurisdiction="FR").select(*_META)


@_query(f"WITH {_REGS} SELECT regulation_type, count(*) AS n FROM regs GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8")
def type_share(spark, sf):
    return views.top_values(corpus.regulations(spark, sf), "regulation_type")


@_query(f"WITH {_REGS} SELECT jurisdiction, regulation_type, count(*) AS n FROM regs GROUP BY 1, 2")
def type_heatmap(spark, sf):
    return views.sizes(corpus.regulations(spark, sf), "jurisdiction", "regulation_type")


@_query(f"WITH {_REGS} SELECT year(effective_date) AS year, jurisdiction, count(*) AS n FROM regs GROUP BY 1, 2")
def timeline(spark, sf):
    return views.sizes(corpus.regulations(spark, sf), F.year("effective_date").cast("long").alias("year"), "jurisdiction")


@_query("SELECT min(doc_id) AS doc_id, substr(sha256(text), 1, 32) AS source_hash FROM documents GROUP BY 2")
def exact_dedup(spark, sf):
    d = corpus.read(spark, sf, "documents").select("doc_id", ids.source_hash("text").alias("source_hash"))
    return dedup.keep_first(d, "source_hash", "doc_id")


@_query("""SELECT h AS source_hash, arg_min(id, (part, id)) AS doc_id, min(part) AS part FROM (SELECT substr(sha256(text), 1, 32) AS h, doc_id AS id, 1 - doc_id % 2 AS part FROM documents) GROUP BY h""")
def union_dedup(spark, sf):
    d = corpus.read(spark, sf, "documents").select("doc_id", ids.source_hash("text").alias("source_hash"))
    odd, even = (d.where(F.col("doc_id") % 2 == x).withColumn("part", F.lit(1 - x).cast("long")) for x in (1, 0))
    return dedup.union_first([odd, even], "source_hash", "doc_id").select("source_hash", "doc_id", "part")


_QUALITY_SQL = f"""WITH {_REGS}, l AS (SELECT r.*, TIMESTAMP '2024-01-30' AS ingested_at, CASE WHEN toxic = 1 THEN NULL ELSE r.title END AS t FROM regs r LEFT JOIN labels USING (doc_id)),
 n AS (SELECT count(*) AS n FROM l)"""


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    regs, labels = corpus.regulations(spark, sf), corpus.read(spark, sf, "labels").select("doc_id", "toxic")
    rows = regs.join(labels, "doc_id", "left").withColumn("title", F.when(F.coalesce(F.col("toxic"), F.lit(0)) != 1, F.col("title")))
    return rows.withColumn("ingested_at", F.lit("2024-01-30").cast("timestamp_ntz"))


@_query(f"{_QUALITY_SQL} SELECT column_name, null_rate FROM (SELECT avg(CAST(t IS NULL AS INT)) AS title, avg(CAST(raw_text IS NULL AS INT)) AS raw_text, avg(CAST(effective_date IS NULL AS INT)) AS effective_date FROM l) UNPIVOT (null_rate FOR column_name IN (title, raw_text, effective_date))")
def null_rates(spark, sf):
    return quality.null_rates(_landed(spark, sf), ["title", "raw_text", "effective_date"])


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    """The landed batch with values that fail every kind of check."""
    every = lambda n, bad, c: F.when(F.col("doc_id") % n == 0, bad).otherwise(F.col(c).cast("string"))
    number = lambda n: (F.col("doc_id") % n).cast("string")
    return _landed(spark, sf).withColumns({
        "jurisdiction": every(11, F.concat(F.lit("XX"), number(3)), "jurisdiction"), "source_url": every(13, F.lit("ftp:/x"), "source_url"), "regulation_type": every(17, F.concat(F.lit("Memo "), number(7)), "regulation_type"),
        "effective_date": every(19, F.concat(F.lit("March "), number(28)), "effective_date"), "source_hash": every(23, F.concat(F.lit("zz"), F.col("source_hash")), "source_hash"),
    })


_DIRTY_SQL = f"""{_QUALITY_SQL}, b AS (SELECT * REPLACE (CASE WHEN doc_id % 11 = 0 THEN 'XX' || CAST(doc_id % 3 AS VARCHAR) ELSE jurisdiction END AS jurisdiction,
  CASE WHEN doc_id % 17 = 0 THEN 'Memo ' || CAST(doc_id % 7 AS VARCHAR) ELSE regulation_type END AS regulation_type, CASE WHEN doc_id % 19 = 0 THEN 'March ' || CAST(doc_id % 28 AS VARCHAR) ELSE CAST(effective_date AS VARCHAR) END AS effective_date,
  CASE WHEN doc_id % 23 = 0 THEN 'zz' || source_hash ELSE source_hash END AS source_hash) FROM l)"""
_NULL_CHECKS = " ".join(f"UNION ALL SELECT {i + 2}, 'null_rate_{c}', '{'critical' if x == 0 else 'warning'}', CAST(count(*) FILTER (WHERE {'t' if c == 'title' else c} IS NULL) AS BIGINT), count(*) FILTER (WHERE {'t' if c == 'title' else c} IS NULL) <= {x} * count(*) FROM l" for i, (c, x) in enumerate(quality.NULL_LIMITS.items()))


def _every(n: int) -> str:
    return f"count(*) FILTER (WHERE doc_id % {n} = 0), count(*) FILTER (WHERE doc_id % {n} = 0) = 0 FROM b"


@_query(f"""{_DIRTY_SQL} SELECT CAST(position AS INT) AS position, check_name, severity, passed, CAST(failing AS BIGINT) AS failing FROM (
  SELECT 0 AS position, 'not_empty' AS check_name, 'critical' AS severity, CAST(0 AS BIGINT) AS failing, n > 0 AS passed FROM n UNION ALL SELECT 1, 'schema_completeness', 'critical', 1, false {_NULL_CHECKS}
  UNION ALL SELECT 11, 'duplicate_source_hash', 'warning', count(*) - count(DISTINCT source_hash), count(*) = count(DISTINCT source_hash) FROM b
  UNION ALL SELECT 12, 'valid_jurisdictions', 'warning', {_every(11)} UNION ALL SELECT 13, 'valid_regulation_types', 'info', {_every(17)} UNION ALL SELECT 14, 'url_format', 'warning', {_every(13)}
  UNION ALL SELECT 15, 'effective_date_format', 'warning', {_every(19)} UNION ALL SELECT 16, 'source_hash_format', 'critical', {_every(23)} UNION ALL SELECT 17, 'minimum_row_count', 'warning', greatest(1000000000 - n, 0), n >= 1000000000 FROM n
  UNION ALL SELECT 18, 'raw_text_min_length', 'warning', count(*) FILTER (WHERE length(raw_text) < 20), count(*) FILTER (WHERE length(raw_text) < 20) = 0 FROM l)""".replace(f"UNION ALL SELECT 11, 'null_rate_ingested_at', 'critical', CAST(count(*) FILTER (WHERE ingested_at IS NULL) AS BIGINT), count(*) FILTER (WHERE ingested_at IS NULL) <= 0.0 * count(*) FROM l", ""))
def quality_suite(spark, sf):
    """Every kind of check fails: values, a column is missing, and a source that expects more rows."""
    return quality.run_checks(_dirty(spark, sf).drop("ingested_at"), "vast", {"vast": 1_000_000_000})


@_query(f"""{_DIRTY_SQL}, v AS (SELECT 'valid_jurisdictions' AS check_name, jurisdiction AS value, 10 AS k FROM b WHERE doc_id % 11 = 0 UNION SELECT 'valid_regulation_types', regulation_type, 5 FROM b WHERE doc_id % 17 = 0
  UNION SELECT 'effective_date_format', effective_date, 3 FROM b WHERE doc_id % 19 = 0) SELECT check_name, CAST(row_number() OVER (PARTITION BY check_name ORDER BY value) AS INT) AS place, value FROM v QUALIFY place <= k""")
def quality_samples(spark, sf):
    return quality.bad_values(_dirty(spark, sf))


@_query(f"""WITH {_REGS}, old AS (SELECT regulation_id, max(version_id) AS v, arg_max(source_hash, version_id) AS h FROM regs WHERE doc_id % 5 < 2 AND doc_id % 7 <> 0 GROUP BY 1),
  n AS (SELECT r.*, v, h FROM regs r LEFT JOIN old o USING (regulation_id) WHERE NOT (doc_id % 5 < 2 AND doc_id % 7 <> 0) AND (h IS NULL OR h <> source_hash))
  SELECT regulation_id, doc_id, source_hash, h AS old_hash, CASE WHEN v IS NULL THEN 'new' ELSE 'amended' END AS status,
  CAST(CASE WHEN v IS NULL THEN version_id ELSE v + row_number() OVER (PARTITION BY regulation_id ORDER BY doc_id) END AS INT) AS version_id FROM n""")
def amendment_detect(spark, sf):
    regs = corpus.regulations(spark, sf)
    known = (F.col("doc_id") % 5 < 2) & (F.col("doc_id") % 7 != 0)
    return dedup.amendments(regs.where(~known), regs.where(known), "doc_id").select("regulation_id", "doc_id", "source_hash", "old_hash", "status", "version_id")


@_query(f"""WITH {_REGS}, o AS (SELECT regulation_id, version_id, title, source_hash, jurisdiction FROM regs WHERE doc_id % 3 <> 0),
  n AS (SELECT regulation_id, version_id, 'New ' || title AS title, substr(source_hash, 1, 8) AS source_hash, 'XX' AS jurisdiction FROM regs WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
  SELECT regulation_id, version_id, coalesce(n.title, o.title) AS title, coalesce(n.source_hash, o.source_hash) AS source_hash, coalesce(o.jurisdiction, n.jurisdiction) AS jurisdiction FROM o FULL JOIN n USING (regulation_id, version_id)""")
def upsert_regulations(spark, sf):
    regs = corpus.regulations(spark, sf).select("regulation_id", "version_id", "title", "source_hash", "jurisdiction", "doc_id")
    new = regs.where("doc_id % 2 = 0 or doc_id % 3 = 0").withColumns({"title": F.concat(F.lit("New "), "title"), "source_hash": F.substring("source_hash", 1, 8), "jurisdiction": F.lit("XX")})
    return store.upsert(regs.where("doc_id % 3 != 0").drop("doc_id"), new, ["regulation_id", "version_id"], ["title", "source_hash"])


@_query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'old' ELSE 'new' END AS origin FROM documents")
def insert_ignore(spark, sf):
    d = corpus.read(spark, sf, "documents").select("doc_id")
    return store.insert_ignore(d.where("doc_id % 3 != 0").withColumn("origin", F.lit("old")), d.where("doc_id % 2 = 0 or doc_id % 3 = 0").withColumn("origin", F.lit("new")), "doc_id")


@_query("SELECT vec_id, label, CASE WHEN doc_id IS NOT NULL THEN 'parquet' END AS vector_store FROM embeddings LEFT JOIN (SELECT DISTINCT doc_id FROM labels) ON vec_id = doc_id")
def mark_embedded(spark, sf):
    rows = corpus.read(spark, sf, "embeddings").select("vec_id", "label", F.lit(None).cast("string").alias("vector_store"))
    return store.mark(rows, "vec_id", corpus.read(spark, sf, "labels").select(F.col("doc_id").alias("vec_id")), {"vector_store": "parquet"})


@_query("SELECT vec_id, label FROM embeddings WHERE label <> 3")
def vector_delete(spark, sf):
    return store.delete_where(corpus.read(spark, sf, "embeddings").select("vec_id", "label"), {"label": 3})


#: Longest common subsequences by a row of bits: where[c] has a bit for each place of c in the one, row loses one for each match.
@_query("""WITH t AS (SELECT p_partkey AS id, p_brand AS src, concat_ws(' ', p_name, p_type, p_brand) AS title FROM part),
  s AS (SELECT *, array_to_string(list_sort(list_filter(string_split_regex(title, '\\s+'), lambda x: x <> '')), ' ') AS s FROM t),
  u AS (SELECT s, length(s) AS n, string_split(s, '') AS cs, list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''), lambda c: length(s) - length(replace(lower(s), c, ''))) AS bag FROM (SELECT DISTINCT s FROM s)),
  c AS (SELECT a.s AS a, b.s AS b, a.n AS m, b.n AS n, a.cs AS acs, b.cs AS bcs FROM u a, u b
    WHERE 2 * least(a.n, b.n) >= 0.92 * (a.n + b.n) - 1e-9 AND list_sum(list_transform(list_zip(a.bag, b.bag), lambda x: abs(x[1] - x[2]))) <= 0.08 * (a.n + b.n) + 1e-9),
  w AS (SELECT *, map_from_entries(list_transform(list_distinct(acs), lambda x: {'k': x, 'v': list_sum(list_transform(acs, lambda y, i: CASE WHEN y = x THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END))::HUGEINT})) AS mask FROM c WHERE m <= 120),
  r AS (SELECT a, b, m, n, list_reduce(list_prepend((1::HUGEINT << m) - 1, list_transform(bcs, lambda x: coalesce(mask[x], 0::HUGEINT))), lambda z, hit: ((z + (z & hit)) | (z - (z & hit))) & ((1::HUGEINT << m) - 1)) AS z FROM w),
  p AS (SELECT a, b FROM r WHERE 2.0 * (m - bit_count(z)) / (m + n) >= 0.92 - 1e-12)
  SELECT id, title FROM s WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM p JOIN s o ON o.s = p.b WHERE p.a = s.s AND o.id % 2 = 1 AND o.src <> s.src)""")
def fuzzy_dedup(spark, sf):
    p = corpus.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source_name"), F.col("p_partkey").cast("string").alias("regulation_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))
    return dedup.drop_similar(p.where("id % 2 = 0"), p.where("id % 2 = 1")).select("id", "title")


@_query("""SELECT page_id, regexp_matches(url, '^https?://\\S+$') AS url_ok, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def url_check(spark, sf):
    return corpus.read(spark, sf, "pages").select("page_id", F.col("url").rlike(quality.URL).alias("url_ok"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


@_query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_text(spark, sf):
    return corpus.read(spark, sf, "pages").select("page_id", F.md5(text.strip_html(F.col("html")).cast("binary")).alias("text_md5"))


@_query(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
  b AS (SELECT page_id, unnest(generate_series(1, len(h))) AS i, h, t FROM a WHERE len(h) > 0)
  SELECT page_id, CAST(i - 1 AS INT) AS link_index, CASE WHEN regexp_matches(h[i], '^https?://') THEN h[i] ELSE 'https://example.org' || h[i] END AS source_url,
  trim(regexp_replace(regexp_replace(t[i], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM b WHERE length(trim(regexp_replace(regexp_replace(t[i], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) >= 5""")
def html_links(spark, sf):
    return records.links(corpus.read(spark, sf, "pages"), "html", "https://example.org", "").select("page_id", "link_index", "source_url", "title")


_TOKENS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@_query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS_SQL}) AS term FROM documents) GROUP BY 1")
def term_statistics(spark, sf):
    words = corpus.read(spark, sf, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    per_doc = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_BM25_SQL = f"""w AS (SELECT doc_id, {_TOKENS_SQL} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
  p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
  idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, s GROUP BY term, n), m AS (SELECT avg(idf) AS mean FROM idf),
  q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_TOKENS_SQL}) AS term FROM benchmark) GROUP BY ALL),
  sc AS (SELECT query_id, doc_id, sum(qf * CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term), s, m GROUP BY ALL),
  sparse AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc QUALIFY rank <= {{k}})"""


@_query(f"WITH {_BM25_SQL.replace("{k}", "10")} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM sparse WHERE score > 0")
def bm25_topk(spark, sf):
    asked = corpus.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(corpus.read(spark, sf, "documents"), asked, 10).withColumn("score", F.round("score", 6))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = corpus.read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    # the stated query set: ids divisible by 100
    return rows, rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


def _dense_sql(where: str, k: int, asked: str = "q.vec_id % 100 = 0") -> str:
    return f"""SELECT query_id, chunk_id, round(c, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, chunk_id) AS INT) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS c
  FROM embeddings v, embeddings q WHERE {asked} AND {where}) QUALIFY rank <= {k}"""


@_query(_dense_sql("true", 10))
def dense_topk(spark, sf):
    return retrieval.dense(*_vectors(spark, sf), 10)


@_query(_dense_sql("v.label = 3", 5))
def dense_filtered(spark, sf):
    return retrieval.dense(*_vectors(spark, sf), 5, F.col("label") == 3)


@_query(f"""WITH {_BM25_SQL.replace("{k}", "15")}, d AS ({_dense_sql("true", 15, "q.vec_id IN (SELECT item_id FROM benchmark)")}), f AS (SELECT query_id, id, sum(part) AS score, min(dr) AS dr, min(sr) AS sr FROM (
  SELECT query_id, chunk_id AS id, 0.6 / (60 + rank) AS part, rank AS dr, NULL AS sr FROM d UNION ALL SELECT query_id, doc_id, 0.4 / (60 + rank), NULL, rank FROM sparse WHERE score > 0) GROUP BY ALL)
  SELECT query_id, id AS chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, dr NULLS LAST, sr NULLS LAST, id) AS INT) AS rank FROM f QUALIFY rank <= 5""")
def hybrid_rrf(spark, sf):
    """Flagship: benchmark items against texts by BM25, the vectors of the same numbers by cosine, fused."""
    rows, _ = _vectors(spark, sf)
    asked = corpus.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = asked.join(rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")
    return retrieval.retrieve(retrieval.build_bm25(corpus.read(spark, sf, "documents")), rows, asked, 5)


@_query(f"""WITH a AS ({_dense_sql("true", 6)}), b AS ({_dense_sql("v.label = 3", 3)}), m AS (SELECT query_id, chunk_id, min(l * 1000 + rank) AS place FROM (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL)
  SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id) AS INT) AS rank FROM m QUALIFY rank <= 7""")
def merge_ranked(spark, sf):
    rows, asked = _vectors(spark, sf)
    return retrieval.merge_ranked([retrieval.dense(rows, asked, 6), retrieval.dense(rows, asked, 3, F.col("label") == 3)], "chunk_id", 7)


_LAST = lambda what: f"CASE WHEN contains(piece, {what}) THEN pos + length(piece) - (strpos(reverse(piece), reverse({what})) - 1) - length({what}) ELSE -1 END"
#: Windows of 1945 characters that overlap by 193; stop: the last blank line, else the end of the last sentence, past the middle of the step.
CHUNKS_SQL = f"""RECURSIVE cut(doc_id, pos, stop) AS (SELECT doc_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents UNION ALL
  SELECT doc_id, pos, CASE WHEN pos + 1945 < n AND blank > pos + 876 THEN blank WHEN pos + 1945 < n AND sentence > pos + 876 THEN sentence + 1 ELSE pos + 1945 END FROM (
    SELECT *, {_LAST("chr(10) || chr(10)")} AS blank, {_LAST("'. '")} AS sentence FROM (
      SELECT c.doc_id, greatest(c.stop - 193, 0) AS pos, length(text) AS n, substr(text, greatest(c.stop - 193, 0) + 1, 1945) AS piece FROM cut c JOIN documents d USING (doc_id) WHERE greatest(c.stop - 193, 0) < length(text))) ),
  chunks AS (SELECT doc_id, pos, regexp_replace(substr(text, pos + 1, stop - pos), '^\\s+|\\s+$', '', 'g') AS chunk_text FROM cut JOIN documents USING (doc_id) WHERE pos >= 0)"""


CHUNK_ROWS_SQL = f"""WITH {CHUNKS_SQL}, k AS (SELECT doc_id, chunk_text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks FROM chunks WHERE chunk_text <> '')
  SELECT doc_id, total_chunks, chunk_index, chunk_text, CAST(greatest(1, length(chunk_text) // 3) AS INT) AS token_estimate, substr(sha256(CAST(doc_id AS VARCHAR) || '::' || CAST(chunk_index AS VARCHAR) || '::' || substr(chunk_text, 1, 64)), 1, 24) AS chunk_id FROM k"""


@_query(CHUNK_ROWS_SQL)
def chunk_text(spark, sf):
    d = corpus.read(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_text(d, "doc_id", "text").drop("text")


@_query(CHUNK_ROWS_SQL)
def chunk_function(spark, sf):
    """The same chunks by the table function, in SQL."""
    chunking.register_chunks(spark)
    rows = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk(d.text, 512, 51) c", docs=corpus.read(spark, sf, "documents"))
    return rows.withColumn("chunk_id", ids.chunk_id("doc_id", "chunk_index", "chunk_text"))


def _paged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of the legal structure: each line a paragraph, every third one under a heading."""
    d = corpus.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    n = (F.floor(F.col("line") / 3) + 1).cast("string")
    head = F.when(F.col("line") % 12 == 0, F.concat(F.lit("Chapter "), n, F.lit("\n"))).when(F.col("line") % 3 == 0, F.concat(F.lit("Article "), n, F.lit("a\n"))).when(F.col("line") % 3 == 1, F.concat(F.lit("Section "), n, F.lit(".2\n"))).otherwise("")
    return d.select("doc_id", (F.floor(F.col("line") / 6) + 1).cast("int").alias("page_number"), F.col("line"), F.concat(head, "body").alias("text"))


@_query(r"""WITH l AS (SELECT doc_id, i - 1 AS line, s[i] AS body FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
  k AS (SELECT *, line // 3 + 1 AS n, CASE WHEN line % 12 = 0 THEN 'chapter' WHEN line % 3 = 0 THEN 'article' WHEN line % 3 = 1 THEN 'section' ELSE 'body' END AS kind FROM l)
  SELECT doc_id, CAST(line AS INT) AS block_idx, kind AS block_type, 'chapter_' || CAST(line // 12 * 4 + 1 AS VARCHAR) AS chapter_ref,
  CASE WHEN line % 12 >= 3 THEN 'article_' || CAST(n AS VARCHAR) || 'a' END AS article_ref,
  CASE WHEN line % 3 > 0 THEN 'section_' || CAST(n AS VARCHAR) || '_2' END AS section_ref FROM k WHERE kind <> 'body' OR regexp_matches(body, '\S')""")
def structure_context(spark, sf):
    paras = _paged(spark, sf).withColumnRenamed("line", "para").where(F.col("text").rlike(r"\S"))
    rows = structure.with_context(structure.classify(paras), "doc_id")
    return rows.select("doc_id", F.col("para").alias("block_idx"), "block_type", "chapter_ref", "article_ref", "section_ref")


@_query()
def block_chunks(spark, sf):
    paras = _paged(spark, sf).withColumnRenamed("line", "para").where(F.col("text").rlike(r"\S"))
    blocks = structure.with_context(structure.classify(paras), "doc_id")
    return chunking.chunk_blocks(blocks, "doc_id")


#: Function words of the corpus' languages, so that the label scorer has something to find in invented prose.
_LANGUAGES = {"en": [r"\bthe\b", r"\band\b", r"\bof\b"], "fr": [r"\bles\b", r"\bdes\b", r"\bet\b"], "de": [r"\bder\b", r"\bdie\b", r"\bund\b"], "es": [r"\bque\b", r"\blos\b", r"\bdel\b"]}
_COUNTS = ", ".join(f"CAST({' + '.join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in ps)} AS INT) AS {n}" for n, ps in _LANGUAGES.items())


@_query(f"""SELECT doc_id, CASE WHEN g = 0 THEN 'UNKNOWN' WHEN en = g THEN 'en' WHEN fr = g THEN 'fr' WHEN de = g THEN 'de' ELSE 'es' END AS label, CASE WHEN g = 0 THEN 0.0 ELSE round(CAST(g AS DOUBLE) / (en + fr + de + es), 3) END AS confidence
  FROM (SELECT *, greatest(en, fr, de, es) AS g FROM (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, regexp_replace(text, '[^ -~\\s]', 'x', 'g') AS text FROM documents)))""")
def label_scores(spark, sf):
    plain = F.regexp_replace("text", r"[^ -~\s]", "x")
    d = corpus.read(spark, sf, "documents").select("doc_id", plain.alias("text"))
    return tagging.with_label(d, F.col("text"), _LANGUAGES, "label", "confidence").drop("text")


def _first_ones(lists: str) -> str:
    """SQL: the list's distinct values in their first order."""
    return f"list_filter({lists}, lambda x, i: list_position({lists}, x) = i)"


#: Ends for texts, so that the tags have something to find in invented prose.
_ENDS = (
    " On 2021-03-04 under Article 5(1) of the GDPR and Article 9a DSA, Article 9a DSA.", " A fine of £1,200 million; March 5, 2023.", " NPRM by the FTC and the FCC on 7 May 2022, USD 3.5 bn.",
    " The European Parliament, the UK: EU Directive. Overruling.", " Guidelines of the CNIL, €12 and 03/04/2020.", " Regulation (EU) of Canada, $1,200 million", "",
)
_END_SQL = "text || [" + ", ".join(f"'{e}'" for e in _ENDS) + f"][doc_id % {len(_ENDS)} + 1]"


def _with_ends(text: str = "text"):
    return F.concat(text, F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("doc_id") % len(_ENDS) + 1).cast("int")))


def _plain(pattern: str) -> str:
    return re.sub(r"[^\x00-\x7f£€]", "x", pattern).replace("'", "''")


_COUNT_SQL = ", ".join(f"{' + '.join(f"len(regexp_extract_all(p, '(?i){_plain(x)}'))" for x in ps)} AS n_{name}" for name, ps in tagging.JURISDICTION_PATTERNS.items())
_MOST_SQL = f"greatest({', '.join(f'n_{n}' for n in tagging.JURISDICTION_PATTERNS)})"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_CITED = r"(?i)(Article\s+\d+[a-z]?(?:\(\d+\))?(?:\s+(?:of\s+)?(?:the\s+)?(?:GDPR|UK\s+GDPR|DSA|DMA|AI\s+Act))?)"
_MONEY = r"(?i)(?:£|€|\$|USD|EUR|GBP)\s*([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s*(million|billion|bn|m)\b)?"


@_query(rf"""WITH {_REGS}, t AS (SELECT *, {_END_SQL.replace("text ||", "raw_text ||")} AS t FROM regs), p AS (SELECT *, regexp_replace(t, '[^\x00-\x7F\P{{L}}]', 'x', 'g') AS p FROM t), n AS (SELECT *, {_COUNT_SQL} FROM p),
  f AS (SELECT *, regexp_extract_all(t, '{_CITED}', 1) AS c, regexp_extract_all(p, '{_MONEY}', 1) AS m, regexp_extract_all(p, '{_MONEY}', 2) AS w, regexp_extract(p, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1) AS iso,
    regexp_extract(p, '\b(\d{{1,2}}\s+{_MONTH}\s+\d{{4}})\b', 1) AS dmy, regexp_extract(p, '\b({_MONTH}\s+\d{{1,2}},?\s+\d{{4}})\b', 1) AS mdy FROM n)
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN jurisdiction WHEN {_MOST_SQL} = 0 THEN 'UNKNOWN' {' '.join(f"WHEN n_{n} = {_MOST_SQL} THEN '{n}'" for n in tagging.JURISDICTION_PATTERNS)} END AS jurisdiction,
  CASE WHEN doc_id % 4 = 0 THEN regulation_type {' '.join(f"WHEN regexp_matches(p, '(?i){'|'.join(map(_plain, ps))}') THEN '{n}'" for n, ps in tagging.TYPE_PATTERNS)} ELSE 'Legal Document' END AS regulation_type,
  CASE WHEN doc_id % 3 = 0 THEN effective_date WHEN iso <> '' THEN TRY_CAST(iso AS DATE) WHEN dmy <> '' THEN CAST(try_strptime(regexp_replace(dmy, '\s+', ' ', 'g'), '%d %B %Y') AS DATE)
    WHEN mdy <> '' THEN CAST(try_strptime(regexp_replace(replace(mdy, ',', ''), '\s+', ' ', 'g'), '%B %d %Y') AS DATE) END AS effective_date,
  array_to_string({_first_ones("c")}, '|') AS article_citations, CAST(len(m) AS INT) AS n_amounts,
  round(list_sum(list_transform(range(1, len(m) + 1), lambda i: CAST(replace(m[i], ',', '') AS DOUBLE) * CASE WHEN lower(w[i]) IN ('million', 'm') THEN 1e6 WHEN lower(w[i]) IN ('billion', 'bn') THEN 1e9 ELSE 1 END)), 2) AS amounts, CAST(0 AS INT) AS named_entities_count,
  CASE WHEN {_MOST_SQL} = 0 THEN 0.0 ELSE round(CAST({_MOST_SQL} AS DOUBLE) / ({' + '.join(f'n_{n}' for n in tagging.JURISDICTION_PATTERNS)}), 3) END AS confidence FROM f""")
def tag_documents(spark, sf):
    """Half of the rows without a jurisdiction, three quarters without a type, two thirds without a date."""
    regs = corpus.regulations(spark, sf).withColumn("raw_text", _with_ends("raw_text")).withColumns({
        "jurisdiction": F.when(F.col("doc_id") % 2 == 0, F.col("jurisdiction")), "regulation_type": F.when(F.col("doc_id") % 4 == 0, F.col("regulation_type")), "effective_date": F.when(F.col("doc_id") % 3 == 0, F.col("effective_date")),
    })
    money = F.from_json("fine_amounts", "array<double>")
    return tagging.tag_regulations(regs).select(
        "doc_id", "jurisdiction", "regulation_type", "effective_date", "article_citations", F.size(money).alias("n_amounts"), F.round(F.when(F.size(money) > 0, F.aggregate(money, F.lit(0.0), lambda a, x: a + x)), 2).alias("amounts"),
        "named_entities_count", F.round(F.col("jurisdiction_confidence").cast("double"), 3).alias("confidence"),
    )


_SIGNAL_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(l, '{w}')" for w in ws)} THEN '{n}'" for n, ws in rewrite.SIGNALS.items()) + " ELSE 'UNKNOWN' END"
_TYPE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(l, '{w}')" for w in ws)} THEN '{n}'" for n, ws in rewrite.TYPES.items()) + " END"


_TERMS_SQL = "flatten([" + ", ".join(f"regexp_extract_all(t, '(?i)({p})', 1)" for p in rewrite.TERMS) + "])"


@_query(f"""WITH b AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'Article 12b and Section 7 of the GDPR: ' WHEN 1 THEN 'The DMA in 2031? ' WHEN 2 THEN 'latest AI Act, CELEX 32024R and CCPA ' WHEN 3 THEN 'GDPR, DSA, DMA, gdpr ' ELSE '' END || text AS t FROM benchmark),
  c AS (SELECT *, lower(t) AS l, {_TERMS_SQL} AS f FROM b), d AS (SELECT *, {_first_ones("f")} AS terms, {_SIGNAL_SQL} AS jurisdiction FROM c)
  SELECT item_id, jurisdiction, {_TYPE_SQL} AS regulation_type, CASE WHEN {' OR '.join(f"contains(l, '{w}')" for w in rewrite.RECENT)} THEN 'recent' WHEN regexp_matches(l, '\\b20[0-9][0-9]\\b') THEN regexp_extract(l, '\\b(20[0-9][0-9])\\b', 1) END AS temporal,
  array_to_string(terms, '|') AS legal_terms, t || CASE WHEN jurisdiction <> 'UNKNOWN' THEN '||' || jurisdiction || ' regulation: ' || t ELSE '' END || CASE WHEN len(terms) > 0 THEN '||' || array_to_string(terms[1:3], ' ') || ' ' || t ELSE '' END AS all_queries FROM d""")
def query_rewrite(spark, sf):
    head = F.element_at(F.array(*map(F.lit, ("Article 12b and Section 7 of the GDPR: ", "The DMA in 2031? ", "latest AI Act, CELEX 32024R and CCPA ", "GDPR, DSA, DMA, gdpr ", ""))), (F.col("item_id") % 5 + 1).cast("int"))
    rows = rewrite.rewrite(corpus.read(spark, sf, "benchmark").select("item_id", F.concat(head, "text").alias("text")), "text")
    return rows.select("item_id", "jurisdiction", "regulation_type", "temporal", F.array_join("legal_terms", "|").alias("legal_terms"), F.array_join("all_queries", "||").alias("all_queries"))


_RULES = tuple(conflicts.Rule(t, a, (pa,), b, (pb,), s, t) for t, a, pa, b, pb, s in (("articles", "US", "% the %that%", "FR", "% les %", "high"), ("licences", "US", "%licensed under%", "DE", "%licensed under%", "low"), ("nothing", "US", "%qqq%", "DE", "%der%", "low")))


@_query(f"""WITH {_REGS}, lt AS (SELECT * FROM regs r WHERE version_id = (SELECT max(version_id) FROM regs x WHERE x.regulation_id = r.regulation_id)),
  s AS ({' UNION ALL '.join(f"SELECT '{r.topic}' AS topic, '{r.jurisdiction_a}' AS jurisdiction_a, '{r.jurisdiction_b}' AS jurisdiction_b, (SELECT min(regulation_id) FROM lt WHERE jurisdiction = '{r.jurisdiction_a}' AND raw_text ILIKE '{r.a_any[0]}') AS regulation_id_a, (SELECT min(regulation_id) FROM lt WHERE jurisdiction = '{r.jurisdiction_b}' AND raw_text ILIKE '{r.b_any[0]}') AS regulation_id_b, '{r.severity}' AS severity" for r in _RULES)})
  SELECT *, substr(sha256(topic || '::' || jurisdiction_a || '::' || jurisdiction_b), 1, 24) AS signal_id FROM s WHERE regulation_id_a IS NOT NULL AND regulation_id_b IS NOT NULL""")
def conflict_rules(spark, sf):
    latest = views.regulations_latest(corpus.regulations(spark, sf))
    return conflicts.detect_conflicts(latest, _RULES).drop("conflict_summary")


@_query("""SELECT conv_id, string_agg('[' || CAST(i AS VARCHAR) || '] ' || role || chr(10) || substr(text, 1, 800), chr(10) || '---' || chr(10) ORDER BY i) AS context
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations) GROUP BY conv_id""")
def prompt_build(spark, sf):
    turns = corpus.read(spark, sf, "conversations")
    numbered = turns.withColumn("i", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    return answers.build_prompts(numbered, "conv_id", "i", ["role"], "text").select("conv_id", "context")


@_query("SELECT conv_id, turn, role, substr(text, 1, 200) AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS place FROM conversations QUALIFY place <= 5")
def history_last5(spark, sf):
    return views.last_turns(corpus.read(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", F.substring("text", 1, 200).alias("text"), "place")


@_query(f"""WITH {_HEALTH} SELECT run_id, source, run_at, CASE WHEN sla_met THEN 'yes' ELSE 'no' END AS sla, CASE WHEN schema_drift THEN 'yes' ELSE 'no' END AS drift,
  printf('%.1f%%', null_rate * 100) AS null_rate FROM health ORDER BY run_at DESC, run_id LIMIT 200""")
def health_log(spark, sf):
    return views.health_log(corpus.pipeline_health(spark, sf))


@_query(f"""WITH {_HEALTH}, t AS (SELECT * FROM health ORDER BY run_at DESC, run_id LIMIT 200) SELECT count(*) AS runs, CAST(coalesce(sum(rows_ingested), 0) AS BIGINT) AS total_rows,
  CAST(count(*) FILTER (WHERE sla_met) AS BIGINT) AS sla_met, CAST(count(*) FILTER (WHERE schema_drift) AS BIGINT) AS drifted FROM t""")
def health_scorecard(spark, sf):
    return views.scorecard(corpus.pipeline_health(spark, sf))


@_query(f"""WITH {_HEALTH}, t AS (SELECT * FROM health ORDER BY run_at DESC, run_id LIMIT 200) SELECT run_id, source, run_at FROM t ORDER BY run_at, run_id DESC LIMIT 100""")
def health_tail(spark, sf):
    return views.oldest_of_newest(corpus.pipeline_health(spark, sf)).select("run_id", "source", "run_at")


@_query(f"{_QUALITY_SQL} SELECT 'eurlex' AS source, count(*) AS rows_ingested, count(*) - count(DISTINCT source_hash) AS duplicate_count, avg(CAST(t IS NULL AS INT)) / 5 AS null_rate FROM l")
def landing_metrics(spark, sf):
    return records.health_row(_landed(spark, sf), "eurlex")


@_query(f"""{_DIRTY_SQL}, f AS (SELECT count(*) AS n, count(*) FILTER (WHERE t IS NULL) AS no_title, count(*) FILTER (WHERE length(raw_text) < 20) AS short, count(*) - count(DISTINCT source_hash) AS twice,
  count(*) FILTER (WHERE doc_id % 11 = 0) AS places, count(*) FILTER (WHERE doc_id % 13 = 0) AS urls, count(*) FILTER (WHERE doc_id % 19 = 0) AS dates, count(*) FILTER (WHERE doc_id % 23 = 0) AS hashes FROM b)
  SELECT n > 0 AND hashes = 0 AS passed, CAST(19 AS BIGINT) + 1 AS total, CAST(n = 0 AS BIGINT) + CAST(hashes > 0 AS BIGINT) AS critical_failures,
  CAST(CAST(no_title > 0.05 * n AS INT) + CAST(short > 0 AS INT) + CAST(twice > 0 AS INT) + CAST(n < 5 AS INT) + CAST(places > 0 AS INT) + CAST(urls > 0 AS INT) + CAST(dates > 0 AS INT) AS BIGINT) AS warnings FROM f""")
def quality_summary(spark, sf):
    return quality.summarize(quality.run_checks(_dirty(spark, sf), "eurlex"))


@_query(f"""WITH {_REGS} SELECT regulation_type, coalesce(j, '') AS jurisdiction, source_url || repeat('/x', 150) AS source_url, substr(title || ' ' || raw_text, 1, 200) AS title, coalesce(v, 0) AS version_id
  FROM (SELECT *, CASE WHEN doc_id % 3 > 0 THEN jurisdiction END AS j, CASE WHEN doc_id % 4 > 0 THEN version_id END AS v FROM regs)""")
def vector_metadata(spark, sf):
    """Titles longer than the cut, addresses that are not cut, nulls as empty or 0."""
    regs = corpus.regulations(spark, sf).select(
        F.col("doc_id").cast("string").alias("chunk_id"), "regulation_type", F.when(F.col("doc_id") % 3 > 0, F.col("jurisdiction")).alias("jurisdiction"), F.concat("source_url", F.repeat(F.lit("/x"), 150)).alias("source_url"),
        F.concat_ws(" ", "title", "raw_text").alias("title"), F.when(F.col("doc_id") % 4 > 0, F.col("version_id")).alias("version_id"),
    )
    return embedding.metadata(regs).select("metadata.*")


@_query(f"""WITH {_HEALTH} SELECT source, run_id, run_at FROM health QUALIFY row_number() OVER (PARTITION BY source ORDER BY run_at DESC, run_id) = 1""")
def last_runs(spark, sf):
    return readers.last_runs(corpus.pipeline_health(spark, sf)).select("source", "run_id", "run_at")


@_query(f"""WITH {_REGS} SELECT doc_id, regulation_id, CASE WHEN contains(l, 'privacy') THEN 'Privacy' WHEN contains(l, 'license') THEN 'Licence' WHEN contains(l, 'copyright') THEN 'Copyright' ELSE 'Other' END AS label
  FROM (SELECT *, lower(raw_text) AS l FROM regs)""")
def keyword_labels(spark, sf):
    rules = [("privacy", "Privacy"), ("license", "Licence"), ("copyright", "Copyright")]
    return corpus.regulations(spark, sf).select("doc_id", "regulation_id", text.first_label(F.col("raw_text"), rules, "Other").alias("label"))


@_query(r"""SELECT doc_id, substr(sha256('https://example.org/' || CAST(doc_id AS VARCHAR)), 1, 32) AS regulation_id, substr(sha256(text), 1, 32) AS source_hash,
  substr(sha256(CAST(doc_id AS VARCHAR) || '::0::' || substr(text, 1, 64)), 1, 24) AS chunk_id FROM documents""")
def document_keys(spark, sf):
    d = corpus.read(spark, sf, "documents")
    return d.select("doc_id", ids.regulation_id(F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))).alias("regulation_id"), ids.source_hash("text").alias("source_hash"), ids.chunk_id("doc_id", F.lit(0), "text").alias("chunk_id"))


@_query(f"""WITH {_REGS} SELECT jurisdiction, regulation_id FROM regs WHERE raw_text ILIKE '%licensed under%' OR raw_text ILIKE '%all rights reserved%' OR raw_text ILIKE '%copyright%2%'""")
def wildcard_search(spark, sf):
    hit = reduce(or_, [F.col("raw_text").ilike(p) for p in ("%licensed under%", "%all rights reserved%", "%copyright%2%")])
    return corpus.regulations(spark, sf).where(hit).select("jurisdiction", "regulation_id")


def queries() -> dict[str, Query]:
    from . import hot_queries, index_queries, more_queries  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
