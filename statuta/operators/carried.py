"""Running values along an order within a key, also where one key holds most of the rows.

A window sends a key's rows to one task. Here the rows are cut into ranges of (key, order), so that a large key spans many
ranges; each range is a window of its own, and what a key has gathered in earlier ranges is carried in. A range goes on with
at most one key of the range before it, so there is less than a row to carry for each range: that table is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.scratch import materialize

_PART = "__range"


@dataclass(frozen=True)
class Running:
    """A running value. kind: ``count`` (1 for a key's first row), ``sum``, ``xor``, ``min``, ``max`` up to and with the row,
    ``last`` (the last non-null value, the row's own included) or ``prior`` (the value of the row before; null for the first)."""

    kind: str
    column: str | None = None


def in_window(r: Running, keys: list[str], order: list[str]) -> Column:
    """The value by a plain window: for keys of which none is large. ``prior`` is wrapped, to tell a null value from no row."""
    ordered = W.partitionBy(*keys).orderBy(*order)
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    match r.kind:
        case "count":
            return F.row_number().over(ordered).cast("long")
        case "sum" | "min" | "max":
            return getattr(F, r.kind)(r.column).over(so_far)
        case "xor":
            return F.bit_xor(r.column).over(so_far)
        case "last":
            return F.last(r.column, ignorenulls=True).over(so_far)
        case "prior":
            return F.lag(F.struct(r.column)).over(ordered)
    raise ValueError(r.kind)


def _of_range(r: Running, order: list[str]) -> Column:
    """What a range hands on of a key."""
    match r.kind:
        case "count":
            return F.count("*")
        case "last":
            return F.max_by(r.column, F.when(F.col(r.column).isNotNull(), F.struct(*order)))
        case "prior":
            return F.max_by(F.struct(r.column), F.struct(*order))
        case "xor":
            return F.bit_xor(r.column)
    return getattr(F, r.kind)(r.column)


def _before(r: Running, name: str) -> Column:
    """What all earlier ranges of the key hand on to this one."""
    earlier = W.partitionBy("__key").orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    match r.kind:
        case "count" | "sum":
            return F.sum(name).over(earlier)
        case "xor":
            return F.bit_xor(name).over(earlier)
        case "min" | "max":
            return getattr(F, r.kind)(name).over(earlier)
    return F.last(name, ignorenulls=True).over(earlier)


def _joined(r: Running, name: str) -> Column:
    here, carried = F.col(name), F.col(f"__{name}")
    match r.kind:
        case "count" | "sum":
            return F.when(carried.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + carried)
        case "xor":
            return F.when(carried.isNull(), here).otherwise(F.coalesce(here, F.lit(0)).bitwiseXOR(carried))
        case "min":
            return F.least(here, carried)
        case "max":
            return F.greatest(here, carried)
        case "last":
            return F.coalesce(here, carried)
    return F.coalesce(here, carried)[r.column]


def carried(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Running], ranges: int | None = None) -> DataFrame:
    """``df`` and a column for each of ``values``, in ascending order of ``order`` (nulls first) within ``keys``.

    Null keys are keys like any other. Rows that tie in ``order`` come in any sequence but are never cut apart: add a column
    that tells them apart where that matters or where many tie. ``ranges``: how many, the shuffle partitions by default.
    The cut rows are written once, so that every later step sees the same ranges.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.withColumn("__key", F.struct(*keys)).repartitionByRange(n, "__key", *order).withColumn(_PART, F.spark_partition_id()))
    sums = cut.groupBy(_PART, "__key").agg(*[_of_range(r, order).alias(name) for name, r in values.items()])
    # ranges follow the order, so a key of several ranges is the last of each but the last and the first of each but the first
    edges = cut.groupBy(_PART).agg(F.min("__key").alias("__first"), F.max("__key").alias("__last"))
    edges = edges.withColumn("__left", F.lag("__last").over(W.orderBy(_PART))).withColumn("__right", F.lead("__first").over(W.orderBy(_PART)))
    edges = edges.where(F.col("__left").eqNullSafe(F.col("__first")) | F.col("__right").eqNullSafe(F.col("__last")))
    at_edge = sums.join(F.broadcast(edges), _PART).where(F.col("__key").eqNullSafe(F.col("__first")) | F.col("__key").eqNullSafe(F.col("__last")))
    handed = at_edge.select(_PART, "__key", *[_before(r, name).alias(f"__{name}") for name, r in values.items()])
    handed = handed.where(reduce(Column.__or__, [F.col(f"__{name}").isNotNull() for name in values]))
    rows = cut.select("*", *[in_window(r, [_PART, "__key"], order).alias(name) for name, r in values.items()])
    # a range goes on with one key at most, which is then its first
    rows = rows.join(F.broadcast(handed.withColumnRenamed("__key", "__on")), _PART, "left")
    other = ~F.col("__key").eqNullSafe(F.col("__on"))
    rows = rows.withColumns({f"__{name}": F.when(other, None).otherwise(F.col(f"__{name}")) for name in values})
    return rows.withColumns({name: _joined(r, name) for name, r in values.items()}).drop(_PART, "__key", "__on", *[f"__{name}" for name in values])
