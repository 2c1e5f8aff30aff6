"""Registered queries over regulations of very many versions: the texts of a source and language are one regulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta import schema
from statuta.operators import dedup, distinct, structure
from statuta.plans import corpus, views
from statuta.plans.registry import SQL, query
from statuta.scratch import materialize, scratch_dir
from statuta.streaming import landing

_SRC = corpus.BY_SOURCE_SQL


@query(f"""WITH {_SRC} SELECT regulation_id, title, jurisdiction, version_id, effective_date, lag(source_hash) OVER (PARTITION BY regulation_id ORDER BY version_id) AS prev_hash,
  source_hash AS current_hash FROM src WHERE regulation_id IN (SELECT regulation_id FROM src GROUP BY 1 HAVING count(*) > 1)""")
def amendment_history_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.amendment_history(corpus.regulations_by_source(spark, sf_dir), hot=True)


@query(f"""WITH {_SRC} SELECT regulation_id, version_id, title, source_hash FROM src QUALIFY rank() OVER (PARTITION BY regulation_id ORDER BY version_id DESC) = 1""")
def regulations_latest_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that can't be the latest of a task's are dropped before the shuffle, so a large regulation is no large task."""
    return views.regulations_latest(corpus.regulations_by_source(spark, sf_dir)).select("regulation_id", "version_id", "title", "source_hash")


@query(f"""WITH {_SRC}, old AS (SELECT regulation_id, max(version_id) AS v, arg_max(source_hash, version_id) AS h FROM src WHERE doc_id % 3 = 0 GROUP BY 1),
  n AS (SELECT r.*, v, h FROM src r LEFT JOIN old o USING (regulation_id) WHERE doc_id % 3 > 0 AND (h IS NULL OR h <> source_hash))
  SELECT regulation_id, doc_id, h AS old_hash, CASE WHEN v IS NULL THEN 'new' ELSE 'amended' END AS status,
  CAST(CASE WHEN v IS NULL THEN version_id ELSE v + row_number() OVER (PARTITION BY regulation_id ORDER BY doc_id) END AS INT) AS version_id FROM n""")
def amendment_detect_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    regs = corpus.regulations_by_source(spark, sf_dir)
    found = dedup.amendments(regs.where("doc_id % 3 > 0"), regs.where("doc_id % 3 = 0"), "doc_id", hot=True)
    return found.select("regulation_id", "doc_id", "old_hash", "status", "version_id")


@query("""WITH b AS (SELECT source, doc_id, CASE doc_id % 7 WHEN 0 THEN 'chapter' WHEN 3 THEN 'article' WHEN 5 THEN 'section' ELSE 'body' END AS kind, CASE WHEN doc_id % 7 IN (0, 3, 5) THEN doc_id END AS n FROM documents),
  k AS (SELECT *, max(CASE WHEN kind = 'chapter' THEN n END) OVER w AS c, max(CASE WHEN kind = 'article' THEN n END) OVER w AS a, max(CASE WHEN kind = 'section' THEN n END) OVER w AS s, row_number() OVER w AS i FROM b WINDOW w AS (PARTITION BY source ORDER BY doc_id))
  SELECT source, doc_id, CAST(i - 1 AS INT) AS block_idx, kind AS block_type, CASE WHEN c IS NOT NULL THEN 'chapter_' || CAST(c AS VARCHAR) END AS chapter_ref, CASE WHEN a > coalesce(c, -1) THEN 'article_' || CAST(a AS VARCHAR) END AS article_ref,
  CASE WHEN s > coalesce(c, -1) AND s > coalesce(a, -1) THEN 'section_' || CAST(s AS VARCHAR) END AS section_ref FROM k""")
def structure_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source read as one long document with a paragraph for each text: chapters, articles and sections by number."""
    n, heading = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    line = F.when(n == 0, F.concat(F.lit("Chapter "), heading)).when(n == 3, F.concat(F.lit("Article "), heading)).when(n == 5, F.concat(F.lit("Section "), heading)).otherwise(F.concat(F.lit("Body of "), heading))
    paras = corpus.read(spark, sf_dir, "documents").select("source", "doc_id", F.lit(1).alias("page_number"), F.col("doc_id").alias("para"), line.alias("text"))
    return structure.with_context(structure.classify(paras), "source", hot=True).select("source", "doc_id", "block_idx", "block_type", "chapter_ref", "article_ref", "section_ref")


@query("""WITH r AS (SELECT concat_ws('-', source, CAST(doc_id % 40 AS VARCHAR)) AS regulation_id, doc_id AS seq, CAST(doc_id // 60 % 3 AS VARCHAR) AS source_hash FROM documents),
  c AS (SELECT *, lag(source_hash) OVER w AS old_hash FROM r WINDOW w AS (PARTITION BY regulation_id ORDER BY seq))
  SELECT regulation_id, seq, source_hash, CAST(row_number() OVER (PARTITION BY regulation_id ORDER BY seq) AS INT) AS version_id, old_hash FROM c WHERE old_hash IS DISTINCT FROM source_hash""")
def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that land in three batches, the stream restarted for each: a regulation's rows are numbered on by its state."""
    docs = corpus.read(spark, sf_dir, "documents")
    name = F.concat_ws("-", "source", (F.col("doc_id") % 40).cast("string"))
    rows = docs.select(name.alias("regulation_id"), F.col("doc_id").alias("seq"), F.floor(F.col("doc_id") / 60 % 3).cast("string").alias("source_hash"))
    source, out = scratch_dir(spark), scratch_dir(spark)
    third = docs.agg((F.max("doc_id") / 3).alias("x")).first().x or 0
    for i in range(3):
        rows.where((F.col("seq") > third * i if i else F.lit(True)) & (F.col("seq") <= third * (i + 1) if i < 2 else F.lit(True))).write.mode("append").parquet(source)
        versions = landing.Versions(landing.landed_stream(spark, source, rows.schema)).rows()
        landing.start(versions, lambda batch, _: batch.write.mode("append").parquet(f"{out}/rows"), f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(SQL["jurisdiction_stats"])
def jurisdiction_stats_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jurisdictions' numbers from what is stored of each day: bitmaps of regulations and types, dates and amendments."""
    regs = corpus.regulations(spark, sf_dir)
    day, place = ["effective_date", "jurisdiction"], ["jurisdiction"]
    sums = materialize(regs.groupBy(*day).agg(F.sum((F.col("version_id") > 1).cast("long")).alias("amended")))
    bits = {c: materialize(distinct.bitmaps(regs, day, c, materialize(distinct.grow_dictionary(regs, c)))) for c in ("regulation_id", "regulation_type")}
    found = sums.groupBy(*place).agg(F.min("effective_date").alias("earliest_date"), F.max("effective_date").alias("latest_date"), F.sum("amended").alias("amendment_count"))
    for column, name in (("regulation_id", "regulation_count"), ("regulation_type", "type_diversity")):
        found = found.join(distinct.counts(bits[column], place, name), place)
    names = schema.jurisdictions(spark).select(F.col("jurisdiction_code").alias("jurisdiction"), "jurisdiction_name")
    return found.join(F.broadcast(names), "jurisdiction", "left").select("jurisdiction", "jurisdiction_name", "regulation_count", "type_diversity", "earliest_date", "latest_date", "amendment_count")
