"""Deterministic keys: prefixes of hex digests over text, null read as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def sha_prefix(n: int, *parts: str | Column) -> Column:
    """First n hex digits of the SHA-256 of the parts joined by ``::``."""
    return F.substring(F.sha2(F.concat_ws("::", *map(_text, parts)), 256), 1, n)


def source_hash(text: str | Column) -> Column:
    return sha_prefix(32, text)


def regulation_id(url: str | Column) -> Column:
    return sha_prefix(32, url)


def run_id(source: str | Column, at: str | Column) -> Column:
    return F.substring(F.md5(F.concat(_text(source), _text(at))), 1, 12)


def chunk_id(regulation: str | Column, index: str | Column, text: str | Column) -> Column:
    return sha_prefix(24, regulation, index, F.substring(_text(text), 1, 64))


def signal_id(topic: str | Column, a: str | Column, b: str | Column) -> Column:
    return sha_prefix(24, topic, a, b)
