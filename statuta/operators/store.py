"""Set-based writes on Parquet tables: each returns the table's new content, ``replace`` puts it in place."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.scratch import materialize

#: Parts of a table by a hash of its key; a table keeps the number that it was begun with.
BUCKETS = 64


def one_per_key(new: DataFrame, keys: list[str], order: list[str | Column] | None, last: bool) -> DataFrame:
    """The first or last row of each key by ``order`` (if none is given by all other columns, so that reruns agree); rows with a null key go."""
    by = [F.col(c) if isinstance(c, str) else c for c in order or [c for c in new.columns if c not in keys]]
    by = [c.desc_nulls_last() if last else c.asc_nulls_last() for c in by] or [F.lit(0)]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*by))
    return new.na.drop(subset=keys).withColumn("__n", rank).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], order: list[str | Column] | None = None) -> DataFrame:
    """Rows of both by key: known keys take ``update`` from the new row and keep the rest, unknown ones are added.

    Of several new rows of one key the last by ``order`` counts, so a key stays unique.
    """
    o, n = old.alias("o"), one_per_key(new, keys, order, last=True).select(*old.columns).alias("n")
    matched = F.col(f"n.{keys[0]}").isNotNull()
    known = F.col(f"o.{keys[0]}").isNotNull()
    pick = [(F.when(matched, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in update else F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c) for c in old.columns]
    return o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full").select(*pick)


def unknown(old: DataFrame, new: DataFrame, key: str, order: list[str | Column] | None = None) -> DataFrame:
    """The rows of ``new`` whose key ``old`` lacks, the first of each key by ``order``: what an append has to add."""
    return one_per_key(new, [key], order, last=False).join(old.select(key), key, "left_anti").select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: list[str | Column] | None = None) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(unknown(old, new, key, order))


def mark(table: DataFrame, key: str, ids: DataFrame, values: dict) -> DataFrame:
    """Sets columns to literals in the rows whose key is in ``ids``."""
    hit = ids.select(F.col(key).alias("__key")).distinct()
    rows = table.join(hit, table[key] == F.col("__key"), "left")
    return rows.select(*[F.when(F.col("__key").isNotNull(), F.lit(values[c]).cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else c for c in table.columns])


def delete_where(table: DataFrame, equal: dict) -> DataFrame:
    """Rows that don't match all the equalities; a null never matches."""
    cond = F.lit(True)
    for c, v in equal.items():
        cond = cond & F.col(c).eqNullSafe(F.lit(v))
    return table.where(~cond)


def delete_counted(table: DataFrame, equal: dict) -> tuple[DataFrame, int]:
    """What ``delete_where`` leaves, and how many rows it takes away."""
    left = delete_where(table, equal)
    return left, table.count() - left.count()


def with_bucket(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The column ``bucket``, by which a table is partitioned."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def append_buckets(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    with_bucket(rows, key, buckets).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def merge_buckets(old: DataFrame, new: DataFrame, path: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> int:
    """Put ``merge(old rows, new rows)`` in place of the buckets of the table at ``path`` that ``new`` touches; returns their number.

    ``old``: the table, its column ``bucket`` included. Only touched buckets are read and written, in one job that swaps them at its
    end; all other files stay as they are, and the table is there at any time.
    """
    new = materialize(with_bucket(new, key, buckets))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    if touched:
        merged = materialize(with_bucket(merge(old.where(F.col("bucket").isin(touched)).drop("bucket"), new.drop("bucket")), key, buckets))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def replace(spark: SparkSession, content: DataFrame, path: str) -> None:
    """Write the content beside the table, then put it in the old one's place; ``content`` may read the old one.

    Two renames: a reader between them finds no table. Each is checked, and after a failed second one the old table is put back.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fresh, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{tag}-{uuid.uuid4().hex}") for tag in ("new", "old"))
    fs = target.getFileSystem(conf)
    content.write.parquet(fresh.toString())
    there = fs.exists(target)
    if there and not fs.rename(target, old):
        fs.delete(fresh, True)
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(fresh, target):
        if there:
            fs.rename(old, target)
        raise OSError(f"{fresh} could not be put in place of {path}")
    if there:
        fs.delete(old, True)
