"""Registered queries over payloads, tags and reports that Spark derives from the given tables, and the SQL they are held against."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta import schema
from statuta.functions import text
from statuta.operators import answers, chunking, conflicts, dedup, embedding, retrieval, store, structure
from statuta.scratch import scratch_dir
from statuta.sources import readers, records
from statuta.streaming import landing

from . import corpus, views
from .registry import query

_REGS, _HEALTH = corpus.REGULATIONS_SQL, corpus.HEALTH_SQL
_HASH = lambda x: f"substr(sha256({x}), 1, 32)"


def _at():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def _parts(spark, sf):
    """A payload per part: a source's answer with one record in it."""
    p = corpus.read(spark, sf, "part")
    day = F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")
    return p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), day.alias("day"))


_PARTS_SQL = "p AS (SELECT p_partkey AS k, p_name AS name, p_type AS kind, lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS day FROM part)"


def _pick(n: str, *values: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(n) % len(values) + 1).cast("int"))


def _pick_sql(n: str, *values: str) -> str:
    return f"[{', '.join(f'NULL' if v is None else repr(v) for v in values)}][{n} % {len(values)} + 1]"


_LANDED = ("regulation_id", "source_hash", "title", "jurisdiction", "regulation_type", "effective_date", "source_url", "raw_text", "version_id", "source_name")
_ID_SQL = f"{_HASH('source_url')} AS regulation_id, {_HASH('raw_text')} AS source_hash"


@query(f"""WITH {_PARTS_SQL}, r AS (SELECT CASE WHEN k % 3 = 0 THEN 'EUR-Lex 3' || CAST(k AS VARCHAR) ELSE name END AS title, 'EU' AS jurisdiction, {_pick_sql("k", "Regulation", "Directive", "Decision", "Legal Act", "Recommendation")} AS regulation_type,
  '2024-03-' || day AS effective_date, 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:3' || CAST(k AS VARCHAR) AS source_url, 3 AS x, 1 AS version_id, 'eurlex' AS source_name,
  CASE WHEN k % 3 = 0 THEN 'EUR-Lex 3' || CAST(k AS VARCHAR) ELSE name END || ' 3' || CAST(k AS VARCHAR) || ' ' || {_pick_sql("k", "Council regulation", "A directive", "Decision", "Opinion", "Recommendation")} AS raw_text FROM p) SELECT * EXCLUDE (x), {_ID_SQL} FROM r""")
def parse_sparql(spark, sf):
    cell = lambda c: F.struct(c.alias("value"))
    kind = _pick("k", "Council regulation", "A directive", "Decision", "Opinion", "Recommendation")
    row = F.struct(cell(F.concat(F.lit("3"), F.col("k").cast("string"))).alias("celex"), F.when(F.col("k") % 3 != 0, cell(F.col("name"))).alias("title"), cell(F.concat(F.lit("2024-03-"), "day", F.lit("T00:00:00"))).alias("date"), cell(kind).alias("type"))
    payloads = _parts(spark, sf).select(F.to_json(F.struct(F.struct(F.array(row).alias("bindings")).alias("results"))).alias("payload"))
    return records.eurlex(payloads, _at()).select(*_LANDED)


@query(f"""WITH {_PARTS_SQL}, r AS (SELECT name AS title, 'US' AS jurisdiction, {_pick_sql("k", "House Bill", "Senate Joint Resolution", "Legislation", "House Simple Resolution")} AS regulation_type, '2024-04-' || day AS effective_date,
  'https://www.congress.gov/bill/118th-congress/' || CAST(k AS VARCHAR) AS source_url, name || ' ' || kind || ' ' || {_pick_sql("k", "House Bill", "Senate Joint Resolution", "Legislation", "House Simple Resolution")} || ' Congress 118' AS raw_text, 1 AS version_id, 'congress' AS source_name FROM p)
  SELECT *, {_ID_SQL} FROM r""")
def parse_bills(spark, sf):
    bill = F.struct(
        _pick("k", "HR", "SJRES", "XX", "HRES").alias("type"), F.col("k").cast("string").alias("number"), F.lit(118).alias("congress"), F.col("name").alias("title"), F.struct(F.col("kind").alias("name")).alias("policyArea"),
        F.struct(F.concat(F.lit("2024-04-"), "day").alias("actionDate")).alias("latestAction"),
    )
    return records.congress(_parts(spark, sf).select(F.to_json(F.struct(F.array(bill).alias("bills"))).alias("payload")), _at()).select(*_LANDED)


@query(f"""WITH {_PARTS_SQL}, r AS (SELECT name AS title, 'US' AS jurisdiction, {_pick_sql("k", "Proposed Rulemaking", "Final Rule", "Federal Notice", "Memo")} AS regulation_type, '2024-02-' || day AS effective_date,
  'https://www.regulations.gov/document/D-' || CAST(k AS VARCHAR) AS source_url, name || ' ' || {_pick_sql("k", "Proposed Rulemaking", "Final Rule", "Federal Notice", "Memo")} || ' FCC docket ' || kind AS raw_text, 1 AS version_id, 'regulations_gov' AS source_name FROM p)
  SELECT *, {_ID_SQL} FROM r""")
def parse_documents(spark, sf):
    about = F.struct(F.col("name").alias("title"), _pick("k", "Proposed Rule", "Rule", "Notice", "Memo").alias("documentType"), F.concat(F.lit("2024-02-"), "day", F.lit("T00:00:00Z")).alias("postedDate"), F.col("kind").alias("docketId"), F.lit("FCC").alias("agencyId"))
    row = F.struct(F.concat(F.lit("D-"), F.col("k").cast("string")).alias("id"), about.alias("attributes"))
    return records.regulations_gov(_parts(spark, sf).select(F.to_json(F.struct(F.array(row).alias("data"))).alias("payload")), _at()).select(*_LANDED)


_SAID = ("Complaint on privacy and a merger", "Annual report", "Settlement, antitrust", "Injunction", "Deceptive advertising")
_FINED = ("Monetary penalty of £200,000 under Article 5 GDPR", "Reprimand, Article 25(1) UK GDPR and Article 5a", "Undertaking: £1.5 million", "£3 is less than a million, Article 5, article 5", "Prosecution")


def _feed(spark, sf, said: tuple[str, ...]):
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    item = F.concat(tag("title", F.col("name")), tag("link", F.concat(F.lit("https://e.org/"), F.col("k").cast("string"))), tag("pubDate", F.concat(F.lit("Fri, "), "day", F.lit(" Mar 2024 10:00:00 GMT"))), tag("description", _pick("k", *said)))
    return _parts(spark, sf).select(tag("rss", tag("channel", tag("item", item))).alias("payload"))


def _feed_sql(said: tuple[str, ...], place: str, types: tuple[str, ...], source: str) -> str:
    return f"""{_PARTS_SQL}, r AS (SELECT k, name AS title, '{place}' AS jurisdiction, {_pick_sql("k", *types)} AS regulation_type, '2024-03-' || day AS effective_date, 'https://e.org/' || CAST(k AS VARCHAR) AS source_url,
  name || ' ' || {_pick_sql("k", *said)} AS raw_text, 1 AS version_id, '{source}' AS source_name FROM p)"""


@query(f"WITH {_feed_sql(_SAID, 'US', ('Privacy Enforcement', '-', 'Antitrust Action', 'Enforcement Action', 'Advertising Enforcement'), 'ftc')} SELECT * EXCLUDE (k), {_ID_SQL} FROM r WHERE k % 5 <> 1")
def parse_feed(spark, sf):
    return records.ftc(_feed(spark, sf, _SAID), _at()).select(*_LANDED)


@query(f"""WITH {_feed_sql(_FINED, 'UK', ('Monetary Penalty Notice', 'Reprimand', 'Undertaking', 'GDPR Enforcement Decision', 'Criminal Prosecution'), 'ico')} SELECT * EXCLUDE (k), {_ID_SQL}, [200000.0, NULL, 1.5e6, 3.0, NULL][k % 5 + 1]::DOUBLE AS fine_amount_gbp,
  {_pick_sql("k", "Article 5 GDPR", "Article 25(1) UK GDPR|Article 5a", "", "Article 5|article 5", "")} AS gdpr_articles FROM r""")
def parse_enforcement(spark, sf):
    """The feed has items, so the HTML list isn't asked."""
    return records.ico_with_fallback(_feed(spark, sf, _FINED), corpus.read(spark, sf, "pages").select(F.col("html").alias("payload")), _at(), 1 << 30).select(*_LANDED, "fine_amount_gbp", "gdpr_articles")


@query("""WITH p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS s FROM documents), l AS (SELECT doc_id, unnest(generate_series(1, len(s))) AS i, s FROM p)
  SELECT doc_id, CAST(i - 1 AS INT) AS para, regexp_replace(s[i], '^\\s+|\\s+$', '', 'g') AS text FROM l WHERE regexp_replace(s[i], '^\\s+|\\s+$', '', 'g') <> ''""")
def paragraphs(spark, sf):
    pages = corpus.read(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_number"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return structure.paragraphs(pages, "doc_id").select("doc_id", "para", "text")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def feed_dates(spark, sf):
    stamp = F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return corpus.read(spark, sf, "events").select("event_id", text.feed_date(F.when(F.col("event_id") % 2 == 0, stamp).otherwise(iso)).alias("day"))


@query(f"""WITH {_REGS} SELECT regulation_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(version_id AS INT) END AS version_id, CAST(NULL AS VARCHAR) AS article_citations, TRY_CAST(CASE WHEN doc_id % 4 = 0 THEN 'May 2024' ELSE CAST(effective_date AS VARCHAR) END AS DATE) AS effective_date, true AS drift FROM regs""")
def conform_rows(spark, sf):
    regs = corpus.regulations(spark, sf)
    given = regs.select("regulation_id", F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.col("version_id").cast("string")).alias("version_id"), F.when(F.col("doc_id") % 4 == 0, F.lit("May 2024")).otherwise(F.col("effective_date").cast("string")).alias("effective_date"))
    rows, drift = schema.conform(given, schema.REGULATIONS)
    return rows.select("regulation_id", "version_id", "article_citations", "effective_date", F.lit(drift).alias("drift"))


#: Every eleventh title is one of a family that differs in a digit; no others are alike.
_TITLED_SQL = f"""{_REGS}, t AS (SELECT * REPLACE (CASE WHEN doc_id % 11 = 0 THEN 'Guidance on the retention of records, series ' || CAST(doc_id % 10 AS VARCHAR) ELSE 'Doc ' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) END AS title) FROM regs),
  o AS (SELECT * FROM t WHERE doc_id % 5 < 2), l AS (SELECT regulation_id, max(version_id) AS v FROM o GROUP BY 1), n AS (SELECT * FROM t WHERE doc_id % 3 > 0),
  f AS (SELECT * FROM n WHERE source_hash NOT IN (SELECT source_hash FROM o) QUALIFY row_number() OVER (PARTITION BY source_hash ORDER BY doc_id) = 1),
  a AS (SELECT f.*, v, CAST(coalesce(v, 0) + row_number() OVER (PARTITION BY f.regulation_id ORDER BY CASE WHEN v IS NULL THEN f.version_id END, doc_id) AS INT) AS version FROM f LEFT JOIN l ON f.regulation_id = l.regulation_id),
  k AS (SELECT * FROM a WHERE doc_id % 11 > 0 OR NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id % 11 = 0 AND o.source_name <> a.source_name AND o.regulation_id <> a.regulation_id))"""


def _titled(spark, sf):
    family = F.concat(F.lit("Guidance on the retention of records, series "), (F.col("doc_id") % 10).cast("string"))
    return corpus.regulations(spark, sf).withColumn("title", F.when(F.col("doc_id") % 11 == 0, family).otherwise(F.concat(F.lit("Doc "), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8))))


def _deduplicated(spark, sf):
    regs = _titled(spark, sf)
    return dedup.deduplicate(regs.where("doc_id % 3 > 0"), regs.where("doc_id % 5 < 2"), "doc_id")


@query(f"""WITH {_TITLED_SQL} SELECT (SELECT count(*) FROM n) AS input_rows, (SELECT count(*) FROM n) - (SELECT count(*) FROM a) AS exact_dropped, (SELECT count(*) FROM a WHERE v IS NOT NULL) AS amendments,
  (SELECT count(*) FROM a) - (SELECT count(*) FROM k) AS similar_dropped, (SELECT count(*) FROM k) AS output_rows""")
def dedup_report(spark, sf):
    """The whole chain; a row of the family is dropped if an old one of another source and regulation is in it."""
    return _deduplicated(spark, sf)[1]


@query(f"""WITH {_TITLED_SQL} SELECT doc_id, regulation_id, CASE WHEN v IS NULL THEN 'new' ELSE 'amended' END AS status, version AS version_id FROM k""")
def dedup_versions(spark, sf):
    """Every new version of a known or unknown regulation has a number of its own; similar titles go after that."""
    return _deduplicated(spark, sf)[0].select("doc_id", "regulation_id", "status", "version_id")


@query(f"""WITH {_REGS}, r AS (SELECT regulation_id, string_agg('[' || CAST(version_id AS VARCHAR) || '] ' || title || CASE WHEN doc_id % 3 = 0 THEN ' — Article ' || CAST(version_id AS VARCHAR) ELSE '' END || ' | ' || jurisdiction
  || CASE WHEN doc_id % 4 > 0 THEN ' (' || CAST(effective_date AS VARCHAR) || ')' ELSE '' END || ' | ' || source_url, chr(10) ORDER BY version_id) AS "references" FROM regs GROUP BY 1) SELECT * FROM r""")
def citations(spark, sf):
    regs = corpus.regulations(spark, sf)
    cited = regs.withColumns({"article_ref": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Article "), F.col("version_id").cast("string"))), "effective_date": F.when(F.col("doc_id") % 4 > 0, F.col("effective_date"))})
    return answers.format_citations(cited, "regulation_id", "version_id")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE '**X:** ' || trim(text) END AS section_1, CASE WHEN turn % 2 = 0 THEN '[' || CAST(turn AS VARCHAR) || ']' ELSE '' END AS section_2 FROM (
  SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z]+', ' ', 'g') AS text FROM conversations)""")
def answer_sections(spark, sf):
    plain = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("**Answer:** "), plain, F.lit("\n**Sources:** ["), F.col("turn").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("**X:** "), plain))
    return answers.parse_answer(corpus.read(spark, sf, "conversations").select("conv_id", "turn", said.alias("t")), "t", ("Answer", "Sources")).select("conv_id", "turn", "section_1", "section_2")


_OF = tuple(("AI Act of the cross-border data transfer", "CLOUD Act: artificial intelligence", "right to erasure, consent to any cookie", "legal hold and tracking")[i] for i in range(4))
_RULE_TEXT = f"raw_text || ' ' || {_pick_sql('doc_id', *_OF)}"


def _rule_sql(r: conflicts.Rule) -> str:
    side = lambda place, ps: f"(SELECT min(regulation_id) FROM t WHERE jurisdiction = '{place}' AND ({' OR '.join(f'x ILIKE {p!r}' for p in ps)}))"
    return f"SELECT '{r.topic}' AS topic, '{r.jurisdiction_a}' AS jurisdiction_a, '{r.jurisdiction_b}' AS jurisdiction_b, {side(r.jurisdiction_a, r.a_any)} AS regulation_id_a, {side(r.jurisdiction_b, r.b_any)} AS regulation_id_b, '{r.severity}' AS severity"


@query(f"""WITH {_REGS}, lt AS (SELECT * FROM regs r WHERE version_id = (SELECT max(version_id) FROM regs x WHERE x.regulation_id = r.regulation_id)), t AS (SELECT regulation_id, jurisdiction, {_RULE_TEXT} AS x FROM lt),
  s AS ({' UNION ALL '.join(map(_rule_sql, conflicts.RULES))}) SELECT substr(sha256(topic || '::' || jurisdiction_a || '::' || jurisdiction_b), 1, 24) AS signal_id, * FROM s WHERE regulation_id_a IS NOT NULL AND regulation_id_b IS NOT NULL AND topic <> 'Right to Erasure'""")
def conflict_signals(spark, sf):
    """All rules on texts that hold their words; one signal is stored already, and both detectors find the same ones."""
    latest = views.regulations_latest(corpus.regulations(spark, sf)).withColumn("raw_text", F.concat_ws(" ", "raw_text", _pick("doc_id", *_OF)))
    twice = conflicts.merge_signals([conflicts.detect_all(latest), conflicts.detect_all(latest)])
    stored, _ = schema.conform(conflicts.detect_all(latest).where("topic = 'Right to Erasure'"), schema.CONFLICT_SIGNALS)
    return conflicts.new_signals(stored, twice, _at()).select("signal_id", "topic", "jurisdiction_a", "jurisdiction_b", "regulation_id_a", "regulation_id_b", "severity")


@F.pandas_udf(T.StringType())
def _differ(topic: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """A stand-in for a model: texts whose lengths differ in parity."""
    return pd.Series(["high" if (len(x) + len(y)) % 2 else None for x, y in zip(a, b)])


@query(f"""WITH {_REGS}, s AS (SELECT regulation_type AS topic, jurisdiction, doc_id, regulation_id, substr(raw_text, 1, 1500) AS x, row_number() OVER (PARTITION BY regulation_type, jurisdiction ORDER BY doc_id) AS rank FROM regs),
  g AS (SELECT topic, jurisdiction, string_agg(x, chr(10) ORDER BY rank) AS x, arg_min(regulation_id, rank) AS id FROM s WHERE rank <= 2 GROUP BY ALL)
  SELECT a.topic, a.jurisdiction AS jurisdiction_a, b.jurisdiction AS jurisdiction_b, a.id AS regulation_id_a, b.id AS regulation_id_b, 'high' AS severity FROM g a JOIN g b ON a.topic = b.topic AND a.jurisdiction < b.jurisdiction WHERE (length(a.x) + length(b.x)) % 2 = 1""")
def topic_conflicts(spark, sf):
    """Types as topics, the first documents of a jurisdiction as its hits."""
    regs = corpus.regulations(spark, sf)

    def search(topics, place, k):
        return retrieval.first_k(regs.where(F.col("jurisdiction") == place).join(topics, F.col("regulation_type") == F.col("topic")).withColumnRenamed("raw_text", "text"), "topic", [F.col("doc_id")], k)

    hits = conflicts.topic_hits(search, ["US", "FR", "DE", "EU"], regs.select(F.col("regulation_type").alias("topic")).distinct())
    return conflicts.compare_topics(hits, _differ).drop("signal_id")


@query("""SELECT item_id, severity FROM (SELECT item_id, ['low', 'high', 'medium'][item_id % 3 + 1] AS severity FROM benchmark) ORDER BY severity DESC, CAST(item_id AS VARCHAR) LIMIT 50""")
def signals_by_severity(spark, sf):
    rows = corpus.read(spark, sf, "benchmark").select("item_id", F.col("item_id").cast("string").alias("signal_id"), _pick("item_id", "low", "high", "medium").alias("severity"))
    return views.by_severity(rows).select("item_id", "severity")


@query(f"""WITH {_REGS} SELECT {", ".join(("regulation_id", "version_id", "jurisdiction", "effective_date"))} FROM regs WHERE jurisdiction IN ('FR', 'DE') AND regulation_type IN ('Notice', 'Decision') ORDER BY effective_date DESC NULLS LAST, regulation_id, version_id LIMIT 100""")
def browse_lists(spark, sf):
    return views.browse(corpus.regulations(spark, sf), ["FR", "DE"], ["Notice", "Decision"], latest_only=False).select("regulation_id", "version_id", "jurisdiction", "effective_date")


@query(f"""WITH {_REGS}, c AS (SELECT jurisdiction AS j, count(*) AS n FROM regs GROUP BY 1) SELECT string_agg(j || '=' || CAST(n AS VARCHAR), ',' ORDER BY j) AS counts FROM c""")
def value_counts(spark, sf):
    counts = views.value_counts(corpus.regulations(spark, sf), "jurisdiction")
    return counts.select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query(f"""WITH {_HEALTH} SELECT run_id, source, CAST(CASE WHEN length(run_id) % 2 = 0 THEN rows_ingested ELSE 0 END AS INT) AS rows_ingested, CAST(0 AS INT) AS duplicate_count, true AS sla_met, false AS schema_drift, '[]' AS errors FROM health WHERE source <> 'error'""")
def health_defaults(spark, sf):
    """Runs with missing fields get defaults; those that are stored already are left out."""
    h = corpus.pipeline_health(spark, sf).select("run_id", "source", "run_at", F.when(F.length("run_id") % 2 == 0, F.col("rows_ingested")).alias("rows_ingested"))
    stored, _ = schema.conform(h.where("source = 'error'"), schema.PIPELINE_HEALTH)
    return readers.new_health(stored, h.union(h.where("source = 'error'"))).select("run_id", "source", "rows_ingested", "duplicate_count", "sla_met", "schema_drift", "errors")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'kept' END AS title, CAST(doc_id % 2 AS INT) AS kept FROM documents""")
def upsert_repeats(spark, sf):
    """New rows that repeat a key: the last counts, and a key stays unique."""
    d = corpus.read(spark, sf, "documents").select("doc_id", F.lit("kept").alias("title"), (F.col("doc_id") % 2).cast("int").alias("kept"))
    new = d.where("doc_id % 3 = 0")
    both = new.select("doc_id", F.lit("first").alias("title"), F.lit(1).alias("kept")).union(new.select("doc_id", F.lit("second").alias("title"), F.lit(2).alias("kept")))
    return store.upsert(d, both, ["doc_id"], ["title"], ["kept"])


@query("SELECT label, count(*) FILTER (WHERE label = 3) AS deleted FROM embeddings GROUP BY 1")
def delete_report(spark, sf):
    v = corpus.read(spark, sf, "embeddings").select("vec_id", "label")
    left, gone = store.delete_counted(v, {"label": 3})
    return left.groupBy("label").agg(F.lit(0).cast("long").alias("deleted")).union(v.where("label = 3").groupBy("label").agg(F.lit(gone).cast("long")))


def _numbers(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: length, and how many vowels; it refuses batches with a text that begins with I."""
    if any(t.startswith("I") for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(sum(t.count(v) for v in "aeiou"))] for t in texts]


@query("""SELECT CAST(item_id AS VARCHAR) AS chunk_id, CASE WHEN starts_with(text, 'I') THEN NULL ELSE CAST(length(text) AS FLOAT) END AS first, CASE WHEN starts_with(text, 'I') THEN NULL ELSE CAST(len(regexp_extract_all(text, '[aeiou]')) AS FLOAT) END AS second FROM benchmark""")
def embed_chunks(spark, sf):
    chunks = corpus.read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text")
    return embedding.embed(chunks, "text", _numbers, 1).select("chunk_id", F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second"))


@query("""SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE round(CAST(embedding[1] AS DOUBLE), 5) END AS first FROM embeddings""")
def upsert_vectors(spark, sf):
    """A third of the vectors is put anew; failed rows leave the old ones."""
    v = corpus.read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    new = v.where("chunk_id % 3 < 2").select("chunk_id", F.when(F.col("chunk_id") % 3 == 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    return embedding.upsert_vectors(v, new).select("chunk_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@F.pandas_udf(T.DoubleType())
def _longest(q: pd.Series, t: pd.Series) -> pd.Series:
    """A stand-in for a reranker: the longer the better; none for texts of even length."""
    return pd.Series([float(len(x)) if len(x) % 2 else None for x in t])


@query("""WITH h AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, d.doc_id // 40 + 1 AS place, length(d.text) AS n FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id)
  SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n % 2 = 1 THEN n END DESC NULLS LAST, place, chunk_id) AS INT) AS rank FROM h QUALIFY rank <= 5""")
def rerank_hits(spark, sf):
    """Every document is a hit of one item; hits without a score keep their order after the others."""
    asked = corpus.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = corpus.read(spark, sf, "documents")
    hits = d.join(asked, F.col("doc_id") % 40 == F.col("query_id")).select("query_id", "query", F.col("doc_id").alias("chunk_id"), "text", (F.floor(F.col("doc_id") / 40) + 1).cast("int").alias("rank"))
    return retrieval.rerank(hits, _longest, 5).select("query_id", "chunk_id", "rank")


@query("""WITH d AS (SELECT doc_id, text, doc_id % 2 = 0 AS blocked FROM documents) SELECT doc_id, blocked, CASE WHEN blocked THEN 'body' END AS block_type FROM d WHERE length(trim(text, chr(10) || ' ' || chr(9))) > 0""")
def chunk_dispatch(spark, sf):
    """Even documents have blocks and are chunked by them, odd ones by windows; one row each shows the way it went."""
    d = corpus.read(spark, sf, "documents").select("doc_id", "text")
    blocks = d.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("block_idx"), "text", F.lit(1).alias("page_number"), F.lit("body").alias("block_type"), *[F.lit(None).cast("string").alias(c) for c in ("article_ref", "section_ref", "chapter_ref")])
    rows = chunking.chunk_documents(d, "doc_id", "text", blocks)
    return rows.where("chunk_index = 0").select("doc_id", (F.col("doc_id") % 2 == 0).alias("blocked"), "block_type")


@query(f"""WITH {_HEALTH} SELECT time_bucket(INTERVAL 1 HOUR, run_at) AS start, source, count(*) AS runs, CAST(sum(rows_ingested) AS BIGINT) AS total_rows, CAST(count(*) FILTER (WHERE NOT sla_met) AS BIGINT) AS sla_breaches FROM health GROUP BY ALL""")
def stream_health(spark, sf):
    """The health runs as a stream, summed by hour and source; a window is written once, when the watermark has passed it."""
    events = corpus.pipeline_health(spark, sf)
    source, out = scratch_dir(spark), scratch_dir(spark)
    events.select("source", F.col("run_at").cast("timestamp").alias("run_at"), "rows_ingested", "sla_met").repartition(4).write.parquet(source)
    kind = spark.read.parquet(source).schema

    def step() -> None:
        windows = landing.health_windows(landing.landed_stream(spark, source, kind))
        landing.start(windows, lambda batch, _: batch.write.mode("append").parquet(f"{out}/rows"), f"{out}/state").awaitTermination()

    step()
    # a run much later closes all windows; the stream goes on from its checkpoint
    closing = spark.read.parquet(source).agg(F.max("run_at").alias("t")).select(F.lit("closing").alias("source"), (F.col("t") + F.expr("INTERVAL 2 DAYS")).alias("run_at"), F.lit(0).cast("long").alias("rows_ingested"), F.lit(True).alias("sla_met"))
    closing.write.mode("append").parquet(source)
    step()
    return spark.read.parquet(f"{out}/rows").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "source", "runs", "total_rows", "sla_breaches")


@query("SELECT substr(sha256(text), 1, 32) AS source_hash FROM documents GROUP BY 1")
def stream_dedup(spark, sf):
    """The texts as a stream, the first row of each key within the watermark."""
    source, out = scratch_dir(spark), scratch_dir(spark)
    d = corpus.read(spark, sf, "documents").select(F.substring(F.sha2("text", 256), 1, 32).alias("source_hash"), F.lit("2024-01-01").cast("timestamp").alias("ingested_at"))
    d.repartition(4).write.parquet(source)
    stream = landing.first_of_key(landing.landed_stream(spark, source, spark.read.parquet(source).schema), "source_hash", "ingested_at", "1 day")
    landing.start(stream, lambda batch, _: batch.write.mode("append").parquet(f"{out}/rows"), f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("source_hash")
