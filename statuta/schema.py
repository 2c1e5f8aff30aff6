"""Table schemas, the conforming of landed records to them, and the jurisdictions' seed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "float": T.FloatType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(","))])


REGULATIONS = _schema(
    "regulation_id string, version_id int, source_hash string, title string, jurisdiction string, regulation_type string,"
    "effective_date date, source_url string, raw_text string, ingested_at timestamp, source_name string,"
    "article_citations string, fine_amounts string, named_entities_count int, jurisdiction_confidence float"
)
CHUNKS = _schema(
    "chunk_id string, regulation_id string, version_id int, chunk_index int, total_chunks int, text string, token_estimate int,"
    "jurisdiction string, regulation_type string, effective_date date, source_url string, page_number int,"
    "article_ref string, section_ref string, chapter_ref string, block_type string, embedded_at timestamp, vector_store string"
)
PIPELINE_HEALTH = _schema(
    "run_id string, source string, run_at timestamp, rows_ingested int, duplicate_count int, null_rate float, schema_drift boolean,"
    "sla_met boolean, elapsed_seconds float, errors string, quality_passed boolean, quality_critical_failures int, quality_warnings int"
)
CONFLICT_SIGNALS = _schema(
    "signal_id string, jurisdiction_a string, jurisdiction_b string, regulation_id_a string, regulation_id_b string,"
    "topic string, conflict_summary string, severity string, detected_at timestamp"
)
#: What every source must deliver.
LANDED = ("regulation_id", "source_hash", "title", "jurisdiction", "regulation_type", "effective_date", "source_url", "raw_text", "version_id", "ingested_at")

# Code, name, region, whether GDPR applies.
JURISDICTIONS = (
    ("EU", "European Union", "Europe", True),
    ("UK", "United Kingdom", "Europe", True),
    ("US", "United States", "North America", False),
    ("DE", "Germany", "Europe", True),
    ("FR", "France", "Europe", True),
    ("CA", "Canada", "North America", False),
    ("AU", "Australia", "Asia-Pacific", False),
    ("UNKNOWN", "Unknown", None, False),
)


def jurisdictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JURISDICTIONS, "jurisdiction_code string, jurisdiction_name string, region string, gdpr_applicable boolean")


def conform(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, bool]:
    """``df`` with exactly the schema's columns, cast where possible, null where missing; whether any was missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    columns = [F.lit(None).cast(f.dataType) if f.name in missing else F.col(f.name).try_cast(f.dataType) for f in schema]
    return df.select(*[c.alias(f.name) for c, f in zip(columns, schema)]), bool(missing)
