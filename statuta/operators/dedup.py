"""Exact and cross-source deduplication, and versions of amended regulations."""

from __future__ import annotations

import itertools
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.operators.carried import Running, carried
from statuta.scratch import materialize


def keep_first(df: DataFrame, key: str | list[str], order: str | list[str | Column]) -> DataFrame:
    """First row of each key by ``order``; nulls are equal. One shuffle, rows that can't be first are dropped before it."""
    keys = [key] if isinstance(key, str) else key
    order = order if isinstance(order, list) else [order]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).where("__n = 1").drop("__n")


def union_first(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """All frames one after the other, missing columns null, first row of each key."""
    tagged = [f.withColumn("__source", F.lit(i)) for i, f in enumerate(frames)]
    rows = tagged[0]
    for f in tagged[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return keep_first(rows, key, ["__source", order]).drop("__source")


def numbered(df: DataFrame, key: str, order: list[Column] | list[str], name: str, hot: bool = False) -> DataFrame:
    """A row's place within its key, from 1. ``hot``: a key may hold a large part of the rows; ``order`` is then names of columns."""
    if hot:
        return carried(df, [key], order, {name: Running("count")})
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)))


def amendments(new: DataFrame, existing: DataFrame, order: str, hot: bool = False) -> DataFrame:
    """``new`` against ``existing`` (regulation_id, version_id, source_hash): status new or amended, rows with a known hash dropped.

    Amended rows get version_id = latest + 1, + 2, ... in the order given, others 1 if null; old_hash is the hash of the latest.
    ``hot``: one regulation may hold a large part of the rows.
    """
    old = existing.groupBy(F.col("regulation_id").alias("__id")).agg(F.max("version_id").alias("__version"), F.max_by("source_hash", "version_id").alias("old_hash"))
    rows = new.join(old, new.regulation_id == F.col("__id"), "left").where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("source_hash")))
    rows = numbered(rows, "regulation_id", [order], "__nth", hot)
    version = F.when(F.col("__id").isNotNull(), F.col("__version") + F.col("__nth")).otherwise(F.coalesce("version_id", F.lit(1)))
    return rows.withColumns({"status": F.when(F.col("__id").isNotNull(), "amended").otherwise("new"), "version_id": version.cast("int")}).drop("__id", "__version", "__nth")


def sorted_tokens(title: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(title, r"\s+"), lambda t: t != "")), " ")


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 LCS / (length + length) of two strings, 1 for two empty ones."""
    return pd.Series([2 * _common_subsequence(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b)])


def _segments(m: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the ith (from 1) of edits + 1 even segments of m characters; the longer ones are the last."""
    base = F.floor(m / (edits + 1))
    short = edits + 1 - (m - base * (edits + 1))
    return (i - 1) * base + F.greatest(i - 1 - short, F.lit(0)), base + (i > short).cast("int")


#: Words of 64 bits that a string's letters are noted in.
_WORDS = ["w0", "w1", "w2", "w3"]


@F.pandas_udf(T.StructType([T.StructField(w, T.LongType()) for w in _WORDS]))
def _letters(s: pd.Series) -> pd.DataFrame:
    """A bit for each letter and how often it came before, turned over where two share it: an edit turns one bit over, so two strings differ in no more bits than edits."""
    rows = []
    for x in s:
        seen: dict[str, int] = {}
        bits = 0
        for c in x:
            k = seen[c] = seen.get(c, 0) + 1
            bits ^= 1 << ((ord(c) + (k << 21)) * 0x9E3779B97F4A7C15 >> 32 & 255)
        rows.append([int.from_bytes(w, "little", signed=True) for w in itertools.batched(bits.to_bytes(32, "little"), 8)])
    return pd.DataFrame(rows, columns=_WORDS)


def similar_strings(new: DataFrame, old: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Pairs (a, b, similarity) of distinct strings of ``new`` and ``old`` (column s) whose Indel similarity reaches the threshold.

    Lossless by segment signatures: similar strings of n and m characters are at most (1 - t)(m + n) single-character edits
    apart, an even number of them if m + n is even and an odd one if not: e at most, which is 0 for short strings of one length.
    n is at most (2 - t) / t m. Of e + 1 segments of the one, an edit spoils one at most; so for some i the ith stands whole in
    the other, moved by no more than the i - 1 edits before it, and by no more than the others after it allow. Each string of
    ``old`` has e + 1 signatures for each e that it may have (its length, e, i, the segment); those of ``new``, the smaller side,
    are asked for at every place where a segment may stand, for every length that may be similar; lengths that the other side
    doesn't have are left out. The join of signatures is one that AQE splits where very many strings share one; pairs whose
    letters alone differ by over e edits don't leave it. Strings are few bytes and many signatures, so they are dealt to all
    partitions, and signatures aren't broadcast by the size of the strings.
    """
    if not 0.7 <= threshold <= 1:
        raise ValueError("below 0.7 a string can't be cut into enough segments")
    longest = (2 - threshold) / threshold
    lengths = lambda n: F.array_intersect(F.sequence(F.ceil(n / longest - 1e-9).cast("int"), F.floor(n * longest + 1e-9).cast("int")), "lengths")
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def edits(m: Column, n: Column) -> Column:
        most = F.floor((m + n) * (1 - threshold) + 1e-6).cast("int")
        return most - (most + m + n) % 2

    def size(df: DataFrame, other: DataFrame) -> DataFrame:
        found = other.select("s").distinct().agg(F.collect_set(F.length("s")).alias("lengths"))
        sized = df.select("s").distinct().repartition(parts, F.xxhash64("s")).withColumns({"n": F.length("s"), "letters": _letters("s")})
        return sized.select("s", "n", *[F.coalesce(f"letters.{w}", F.lit(0)).alias(w) for w in _WORDS]).crossJoin(F.broadcast(found))

    signature = lambda start, length: F.xxhash64("m", "e", "i", F.substring(F.col("s"), (start + 1).cast("int"), length.cast("int")))

    own = size(old, new).withColumnRenamed("n", "m")
    several = F.transform(F.filter(lengths(F.col("m")), lambda n: edits(F.col("m"), n) >= F.abs(n - F.col("m"))), lambda n: edits(F.col("m"), n))
    own = own.withColumn("e", F.explode(F.array_distinct(several))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("e") + 1)))
    own = own.select(F.col("s").alias("b"), "e", *[F.col(w).alias(f"b_{w}") for w in _WORDS], signature(*_segments(F.col("m"), F.col("e"), F.col("i"))).alias("sig"))

    asked = size(new, old).withColumn("m", F.explode(lengths(F.col("n"))))
    asked = asked.withColumn("e", edits(F.col("m"), F.col("n"))).where(F.col("e") >= F.abs(F.col("n") - F.col("m"))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("e") + 1)))
    start, length = _segments(F.col("m"), F.col("e"), F.col("i"))
    more, later = F.col("n") - F.col("m"), F.col("e") + 1 - F.col("i")
    # how far the segment may have moved, by the edits before it and by those after it
    first = F.greatest(start + F.greatest(1 - F.col("i"), more - later), F.lit(0))
    last = F.least(start + F.least(F.col("i") - 1, more + later), F.col("n") - length)
    asked = asked.withColumns({"first": first.cast("int"), "last": last.cast("int"), "length": length}).where("first <= last")
    places = F.array_distinct(F.transform(F.sequence("first", "last"), lambda at: signature(at, F.col("length"))))
    asked = asked.select(F.col("s").alias("a"), *_WORDS, F.explode(places).alias("sig"))

    differ = reduce(add, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"b_{w}"))) for w in _WORDS])
    pairs = asked.join(own.hint("merge"), (asked.sig == own.sig) & (differ <= F.col("e"))).select("a", "b").distinct()
    return pairs.withColumn("similarity", indel_similarity("a", "b")).where(F.col("similarity") >= threshold - 1e-12)


def _witnesses(rows: DataFrame, key: str) -> DataFrame:
    """Of each key's pairs (src, reg) five at most, so that if any pair differs from a given one in both, one of these does.

    A given pair rules out one reg, so a source's least and greatest are enough; likewise the least and greatest source of a reg.
    After that no source and no reg is in more than two pairs, a given one rules out four at most, and any five are enough.
    """
    for by, kept in (("src", "reg"), ("reg", "src")):
        rows = rows.groupBy(key, by).agg(F.array_distinct(F.array(F.min(kept), F.max(kept))).alias(kept)).withColumn(kept, F.explode(kept))
    place = F.row_number().over(W.partitionBy(key).orderBy("src", "reg"))
    return rows.withColumn("__n", place).where("__n <= 5").drop("__n")


def drop_similar(new: DataFrame, existing: DataFrame, threshold: float = 0.92) -> DataFrame:
    """``new`` without rows whose token-sorted title is similar to one of ``existing`` of another source and another regulation.

    Both have regulation_id, source_name and title; nulls are values. Equal titles are compared once. Of the old rows that are
    similar to a title only a few witnesses are kept, which decide for every (source, regulation); so a title that very many rows
    share is a few rows, and rows are never joined with all that are similar.
    """
    of = lambda df: df.withColumn("s", sorted_tokens(F.coalesce("title", F.lit(""))))
    n, e = of(new), of(existing)
    known = _witnesses(e.select(F.col("s").alias("b"), F.struct(F.col("source_name").alias("x")).alias("src"), F.struct(F.col("regulation_id").alias("x")).alias("reg")), "b")
    near = _witnesses(similar_strings(n, e, threshold).join(known, "b").select("a", "src", "reg"), "a").select("a", F.col("src.x").alias("__src"), F.col("reg.x").alias("__reg"))
    other = (n.s == near.a) & ~n.source_name.eqNullSafe(near["__src"]) & ~n.regulation_id.eqNullSafe(near["__reg"])
    return n.join(near, other, "left_anti").drop("s")


def _fresh(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Rows of unknown texts, with their versions."""
    first = keep_first(new, "source_hash", order)
    fresh = amendments(first.join(existing.select("source_hash").distinct(), "source_hash", "left_anti"), existing, order)
    nth = F.row_number().over(W.partitionBy("regulation_id").orderBy(F.col("version_id").asc_nulls_last(), order)).cast("int")
    return fresh.withColumn("version_id", F.when(F.col("status") == "new", nth).otherwise(F.col("version_id")))


def deduplicate_written(new: DataFrame, existing: DataFrame, order: str, threshold: float = 0.92) -> tuple[DataFrame, dict[str, int]]:
    """As ``deduplicate``, written as it goes, so that the chain runs once: the report counts what was written.

    Counts don't come from ``observe``: a job that proves a frame to be empty on the way drops what it observed before.
    """
    fresh = materialize(_fresh(new, existing, order))
    left = materialize(drop_similar(fresh, existing, threshold))
    came, stayed = new.count(), left.count()
    went, amended = fresh.agg(F.count("*"), F.count_if(F.col("status") == "amended")).first()
    return left, {"input_rows": came, "exact_dropped": came - went, "amendments": amended, "similar_dropped": went - stayed, "output_rows": stayed}


def deduplicate(new: DataFrame, existing: DataFrame, order: str, threshold: float = 0.92, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """A batch against what is stored: rows of known texts go, amended regulations get the next versions, near-equal titles of other sources go.

    Returns the rows left (status, version_id, old_hash added; new regulations are numbered from 1 in their order) and a report of
    one row: input_rows, exact_dropped, amendments, similar_dropped, output_rows.
    """
    fresh = _fresh(new, existing, order)
    left = drop_similar(fresh, existing, threshold) if fuzzy else fresh
    counts = [df.agg(F.count("*").alias("n"), *more) for df, more in ((new, []), (fresh, [F.count_if(F.col("status") == "amended").alias("amended")]), (left, []))]
    report = counts[0].withColumnRenamed("n", "input_rows").crossJoin(counts[1].withColumnRenamed("n", "fresh")).crossJoin(counts[2].withColumnRenamed("n", "output_rows"))
    report = report.select("input_rows", (F.col("input_rows") - F.col("fresh")).alias("exact_dropped"), F.col("amended").alias("amendments"), (F.col("fresh") - F.col("output_rows")).alias("similar_dropped"), "output_rows")
    return left, report
