"""Exact distinct counts that merge: bitmaps of dictionary numbers, kept for each part of the data and joined by OR.

Values get dense numbers from a dictionary that only grows. A part (a day's rows, say) keeps a bitmap of the numbers that it
holds, in pieces of 32,768; the distinct count of any parts together is the bits of their pieces' OR, without the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.carried import Running, carried


def grow_dictionary(values: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """``known`` (value, n) and the values of ``column`` that it lacks, numbered on from its highest; nulls have no number.

    New values are numbered in their order, by ranges, so no task holds them all.
    """
    fresh = values.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    if known is not None:
        fresh = fresh.join(known, "value", "left_anti")
    numbered = carried(fresh.withColumn("one", F.lit(1)), ["one"], ["value"], {"n": Running("count")}).select("value", "n")
    if known is None:
        return numbered
    top = known.agg(F.coalesce(F.max("n"), F.lit(0)).alias("top"))
    return known.select("value", "n").unionByName(numbered.crossJoin(F.broadcast(top)).select("value", (F.col("n") + F.col("top")).alias("n")))


def bitmaps(rows: DataFrame, by: list[str], column: str, dictionary: DataFrame) -> DataFrame:
    """by, piece, bits: the numbers of ``column`` that each group holds. Groups without any value have no row."""
    named = dictionary.select(F.col("value").alias(column), "n")
    numbered = rows.select(*by, column).distinct().join(named, column)
    return numbered.groupBy(*by, F.bitmap_bucket_number("n").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """The same for coarser groups: OR of the pieces."""
    return parts.groupBy(*by, "piece").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(parts: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, ``name``: distinct values of each group."""
    return merged(parts, by).groupBy(*by).agg(_bits().alias(name))


def _bits() -> Column:
    return F.sum(F.bitmap_count("bits"))
