"""Folders for intermediate tables: below the cluster's shared checkpoint folder, never a machine-local one on a cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Folders made inside the innermost ``tidy`` call that runs in this thread.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below the context's checkpoint folder, else a
    temporary folder if all runs in this process, else the warehouse, which must then be in a shared store."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="statuta-")
        spark.sparkContext.setCheckpointDir(root)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if ":" not in root or root.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root.rstrip('/')}/statuta-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function whose result is written to a folder of its own; the tables that it made on the way are then removed."""

    @wraps(build)
    def run(*args, **kwargs) -> DataFrame:
        made: list[str] = []
        outer = _MADE.set(made)
        try:
            found = build(*args, **kwargs)
        finally:
            _MADE.reset(outer)
        kept = materialize(found)
        remove(found.sparkSession, made)
        return kept

    return run
