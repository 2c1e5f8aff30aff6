"""The given tables read as the engine's own: documents as regulations, events as pipeline health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.operators.carried import Running, carried

#: Documents that are versions of one regulation.
VERSIONS = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each five neighbouring documents are versions of one regulation, so no version window grows with the table."""
    d = read(spark, sf_dir, "documents")
    place = F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "FR").when(F.col("lang") == "de", "DE").otherwise("EU")
    kind = F.when(F.col("n_chars") < 500, "Notice").when(F.col("n_chars") < 2000, "Guidance").when(F.col("n_chars") < 5000, "Decision").otherwise("Regulation")
    rows = d.select(
        F.concat(F.lit("reg-"), F.floor(F.col("doc_id") / VERSIONS).cast("string")).alias("regulation_id"), F.substring(F.sha2("text", 256), 1, 32).alias("source_hash"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), place.alias("jurisdiction"), kind.alias("regulation_type"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")).alias("effective_date"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_url"), F.col("text").alias("raw_text"), F.col("source").alias("source_name"), "doc_id", "lang",
    )
    return rows.withColumn("version_id", F.row_number().over(W.partitionBy("regulation_id").orderBy("doc_id")))


REGULATIONS_SQL = """regs AS (SELECT *, row_number() OVER (PARTITION BY regulation_id ORDER BY doc_id) AS version_id FROM (
  SELECT 'reg-' || CAST(doc_id // 5 AS VARCHAR) AS regulation_id, substr(sha256(text), 1, 32) AS source_hash, 'Doc ' || CAST(doc_id AS VARCHAR) AS title,
  CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' ELSE 'EU' END AS jurisdiction,
  CASE WHEN n_chars < 500 THEN 'Notice' WHEN n_chars < 2000 THEN 'Guidance' WHEN n_chars < 5000 THEN 'Decision' ELSE 'Regulation' END AS regulation_type,
  CAST(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) AS DATE) AS effective_date, 'https://example.org/' || CAST(doc_id AS VARCHAR) AS source_url,
  text AS raw_text, source AS source_name, doc_id, lang FROM documents))"""


def regulations_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a source and language are versions of one regulation, in the order of their ids: few regulations of very many versions."""
    rows = regulations(spark, sf_dir).withColumn("regulation_id", F.concat_ws("-", "source_name", "lang")).drop("version_id")
    return carried(rows, ["regulation_id"], ["doc_id"], {"version_id": Running("count")})


BY_SOURCE_SQL = f"""{REGULATIONS_SQL}, src AS (SELECT * EXCLUDE (version_id) REPLACE (concat_ws('-', source_name, lang) AS regulation_id), row_number() OVER (PARTITION BY source_name, lang ORDER BY doc_id) AS version_id FROM regs)"""


def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp_ntz").alias("run_at"),
        F.floor("value").cast("long").alias("rows_ingested"), (F.col("event_id") % 100 / 1000).alias("null_rate"), (F.col("value") < 100).alias("sla_met"),
        (F.col("event_type") == "error").alias("schema_drift"), F.col("props").alias("errors"),
    )


HEALTH_SQL = """health AS (SELECT 'run-' || CAST(event_id AS VARCHAR) AS run_id, event_type AS source, ts AS run_at, CAST(floor(value) AS BIGINT) AS rows_ingested,
  CAST(event_id % 100 AS DOUBLE) / 1000 AS null_rate, value < 100 AS sla_met, event_type = 'error' AS schema_drift, props AS errors FROM events)"""
