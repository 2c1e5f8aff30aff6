"""Continuous form of the batch pipeline: landed files as a stream into a deduplicated table, health runs by window."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def landed_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_of_key(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """First row of each key while its watermark lasts, so state is bounded by ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def health_windows(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sums of runs by window and source. Written in append mode, a window comes once, closed; later rows of it are dropped and its
    state goes, so state is that of the windows of ``late``."""
    rows = stream.withWatermark("run_at", late).groupBy(F.window("run_at", width), "source")
    return rows.agg(F.count("*").alias("runs"), F.sum("rows_ingested").alias("total_rows"), F.count_if(~F.col("sla_met")).alias("sla_breaches"))


@dataclass(frozen=True)
class Versions:
    """What is kept of a regulation: its newest version and that one's hash."""

    stream: DataFrame
    key: str = "regulation_id"
    order: str = "seq"

    def rows(self) -> DataFrame:
        """The stream's rows whose hash isn't that of the version before, numbered on within each regulation: key, order, source_hash,
        version_id, old_hash. A batch's rows of a regulation go by ``order``. Rows without a key are left out. State is a number and
        a hash for each regulation, kept as long as the stream: numbers must never begin anew.
        """
        given = self.stream.where(F.col(self.key).isNotNull()).select(self.key, self.order, "source_hash")
        out = T.StructType([*given.schema.fields, T.StructField("version_id", T.IntegerType()), T.StructField("old_hash", T.StringType())])
        order, names = self.order, out.names

        def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            version, last = state.get if state.exists else (0, None)
            found = []
            for r in pd.concat(list(frames)).sort_values([order, "source_hash"]).itertuples(index=False):
                if version == 0 or r.source_hash != last:
                    version += 1
                    found.append((key[0], getattr(r, order), r.source_hash, version, last))
                    last = r.source_hash
            state.update((version, last))
            yield pd.DataFrame(found, columns=names)

        return given.groupBy(self.key).applyInPandasWithState(update, out, "version int, last string", "append", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run what there is, batch by batch, and stop."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
