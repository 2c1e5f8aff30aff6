"""Reading and landing: page requests fetched by tasks, landed payloads, health logs, SQL with parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta import schema
from statuta.functions import ids, text
from statuta.operators import store
from statuta.schema import PIPELINE_HEALTH
from statuta.scratch import materialize


def page_requests(spark: SparkSession, url: str, limit: int, page: int) -> DataFrame:
    """A row per page of an offset-paged API: ``url`` has {offset} and {size}."""
    pages = spark.range(-(-limit // page)).select((F.col("id") * page).cast("int").alias("offset"))
    size = F.least(F.lit(page), F.lit(limit) - F.col("offset"))
    return pages.select("offset", F.replace(F.replace(F.lit(url), F.lit("{offset}"), F.col("offset").cast("string")), F.lit("{size}"), size.cast("string")).alias("url"))


def agency_requests(spark: SparkSession, url: str, limit: int, agencies: tuple[str, ...]) -> DataFrame:
    """A row per agency, its first page alone: ``url`` has {agency} and {size}; the limit is shared out, at most 25 a page."""
    each = min(max(1, limit // len(agencies)), 25)
    rows = spark.createDataFrame([(a,) for a in agencies], "agency string").repartition(len(agencies))
    return rows.select("agency", F.replace(F.replace(F.lit(url), F.lit("{agency}"), F.col("agency")), F.lit("{size}"), F.lit(str(each))).alias("url"))


def _fetched(requests: DataFrame, get, kind: T.DataType, of: pa.DataType, more=None) -> DataFrame:
    out = T.StructType([*requests.schema.fields, T.StructField("payload", kind), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going = True
        for b in batches:
            rows, kept = [], []
            for i, u in enumerate(b.column(b.schema.get_field_index("url")).to_pylist()):
                if not going:
                    break
                try:
                    rows.append((get(u), None))
                except Exception as e:  # a page that fails is an empty one; its message is kept
                    rows.append((None, str(e)))
                kept.append(i)
                going = more is None or rows[-1][0] is not None and more(rows[-1][0])
            b = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p for p, _ in rows], of), pa.array([e for _, e in rows], pa.string())], names=[*b.schema.names, "payload", "error"])

    return requests.mapInArrow(run, out)


def fetch(requests: DataFrame, get: Callable[[str], str | None]) -> DataFrame:
    """``requests`` (url) with ``payload``: get(url) in tasks, and ``error``: why there is none. Retries and delays are get's."""
    return _fetched(requests, get, T.StringType(), pa.string())


def fetch_bytes(requests: DataFrame, get: Callable[[str], bytes | None]) -> DataFrame:
    """As ``fetch`` for payloads of bytes, such as PDF files."""
    return _fetched(requests, get, T.BinaryType(), pa.binary())


def fetch_pages(requests: DataFrame, get: Callable[[str], str | None], has_rows: Callable[[str], bool]) -> DataFrame:
    """As ``fetch`` for the pages of one list (offset, url), one after the other in a task: the first empty or failed page is the last."""
    return _fetched(requests.coalesce(1).sortWithinPartitions("offset"), get, T.StringType(), pa.string(), has_rows)


def enrich(rows: DataFrame, get: Callable[[str], str | None], characters: int = 10_000) -> DataFrame:
    """Landed ``rows`` with the text of their own page, cut, and its hash; where there is none or it fails, they stay."""
    pages = fetch(rows.withColumn("url", F.coalesce("source_url", F.lit(""))), lambda u: get(u) if u else None)
    clean = text.strip_html(F.col("payload"), characters)
    whole = pages.withColumn("raw_text", F.coalesce(clean, "raw_text"))
    return whole.withColumn("source_hash", F.when(F.col("payload").isNotNull(), ids.source_hash("raw_text")).otherwise(F.col("source_hash"))).select(*rows.columns)


def ingest(sources: dict[str, Callable[[int], DataFrame]], limit: int, selected: list[str] | None = None) -> tuple[list[DataFrame], dict[str, str]]:
    """The frames of the selected sources (all if none are named), and why others gave none; an error if none did.

    ``sources``: name -> a function of the limit. A source is read once here, so that one that fails is known and left out.
    """
    frames, lost = [], {}
    for name in selected or list(sources):
        if name not in sources:
            lost[name] = "unknown source"
            continue
        try:
            frames.append(materialize(sources[name](limit)))
        except Exception as e:  # whatever a source raises, the others go on
            lost[name] = str(e)
    if not frames:
        raise ValueError(f"no source gave any data: {lost}")
    return frames, lost


def land(rows: DataFrame, path: str) -> None:
    """Append to the landing table, partitioned by source."""
    rows.write.mode("append").partitionBy("source_name").parquet(path)


def log_health(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").json(path)


def new_health(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Runs that ``stored`` lacks by run_id, with defaults (counts and rates 0, no drift, in time, no errors), as rows of the health table."""
    full, _ = schema.conform(rows, PIPELINE_HEALTH)
    defaults = {"rows_ingested": F.lit(0), "duplicate_count": F.lit(0), "null_rate": F.lit(0.0).cast("float"), "schema_drift": F.lit(False), "sla_met": F.lit(True), "errors": F.lit("[]"), "run_at": F.current_timestamp()}
    return store.unknown(stored, full.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()}), "run_id")


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """The JSON-lines log; malformed lines are skipped."""
    return spark.read.schema(PIPELINE_HEALTH).option("mode", "DROPMALFORMED").json(path)


def last_runs(health: DataFrame) -> DataFrame:
    """Newest run of each source."""
    return health.withColumn("__n", F.row_number().over(W.partitionBy("source").orderBy(F.col("run_at").desc_nulls_last(), "run_id"))).where("__n = 1").drop("__n")


def query(spark: SparkSession, sql: str, params: dict | list | None = None) -> DataFrame:
    return spark.sql(sql, args=params)
