"""The package for executors that were started elsewhere."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_NAME = "statuta-package"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session: needed where the driver finds it by its own folder alone."""
    sc = spark.sparkContext
    if not any(path.endswith(f"{_NAME}.zip") for path in sc._python_includes):
        root = str(Path(__file__).resolve().parent.parent)
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='statuta-')}/{_NAME}", "zip", root, "statuta"))
