"""PDF files as pages of text. Extraction is injected: a function of bytes, tried in order, that runs in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "path string, method string, errors array<string>, page_number int, text string"


def read_pdfs(spark: SparkSession, path: str, extractors: Sequence[tuple[str, Callable[[bytes], list[str]]]]) -> DataFrame:
    """A row per page. The first extractor that gives text is used; where none does, one row with method "none" and a null page."""
    return extract(spark.read.format("binaryFile").load(path).select("path", "content"), extractors)


def read_urls(requests: DataFrame, get: Callable[[str], bytes | None], extractors: Sequence[tuple[str, Callable[[bytes], list[str]]]]) -> DataFrame:
    """Pages of the PDF files at ``requests`` (url), fetched by tasks; one that can't be fetched has method "none"."""
    from .readers import fetch_bytes

    found = fetch_bytes(requests.select("url"), get)
    return extract(found.select(F.col("url").alias("path"), F.coalesce("payload", F.lit(b"")).alias("content")), extractors)


def extract(files: DataFrame, extractors: Sequence[tuple[str, Callable[[bytes], list[str]]]]) -> DataFrame:
    """``files`` (path, content) -> PAGES."""

    def pages_of(content: bytes) -> tuple[str, list[str], list[str]]:
        errors = []
        for name, run in extractors:
            try:
                pages = run(content)
            except Exception as e:  # any extractor may fail on a damaged file: its message is kept and the next is tried
                errors.append(f"{name}: {e}")
                continue
            if any(p.strip() for p in pages):
                return name, errors, pages
            errors.append(f"{name}: no text")
        return "none", errors, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string())
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name, errors, pages = pages_of(content)
                rows += [(path, name, errors, i + 1, t) for i, t in enumerate(pages)] or [(path, name, errors, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 5, kinds)], names=[c.split()[0] for c in PAGES.split(", ")])

    return files.select("path", "content").mapInArrow(run, PAGES)
