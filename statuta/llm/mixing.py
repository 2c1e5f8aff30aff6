"""Mixing sources to target weights by capped water-filling.

A source's target is its share, by weight, of a budget of words. A source is clamped at ``max_epochs`` times its size and
what it can't take is shared out again by weight until none is above its clamp; over sources sorted by clamp / weight
that is one running sum. Inside a source documents stand in a seeded order (md5 of seed and id): each is repeated
whole as often as target / size says, the remainder goes to the first documents of that order, and the one on
the border is taken in part, so a source comes out at its target to the word.

The running sums go over (source, slice of the order) first and then inside a slice, so a source with a third of
all rows isn't one task. Only sums and counts decide; all is built from DataFrame functions.

Nulls and odd rows: a null source is a source of its own, last; a null text has size 0 and takes 0; null ids stand
together in the order, ties go by size; repeated rows are mixed as rows of their own. Sources without words have
target 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Source tables up to this many rows are broadcast, longer ones joined by a shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: list[float], budget: float, max_epochs: float) -> DataFrame:
    """``sizes`` (source, source_size: long), a row each, with ``target``: words to take from the source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    clamped = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * max_epochs)
    total = F.sum("source_size").over(W.partitionBy()) * budget
    by = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    # level: words per unit of weight if all sources before this one are clamped and the rest share what is left
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    level = (total - before) / rest
    filled = clamped.withColumn("level", level)
    free = filled.withColumn("free", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    shared = F.first("free", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return free.withColumn("shared", shared).select(
        "source", "source_size", F.when(F.col("shared").isNull() | (F.col("shared") * F.col("w") > F.col("cap")), F.col("cap")).otherwise(F.col("shared") * F.col("w")).alias("target"))


def seeded_order(doc_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))


@tidy
def mix_sources(docs: DataFrame, weights: list[float], budget: float = 1.5, max_epochs: float = 2.0, seed: int = 17, keys: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, source, text and ``keys``) -> doc_id, *keys, source, size, source_size, target, taken.

    taken: words of the document that the mix holds, repeats counted, at most ceil(target / source_size) times its size.
    """
    keys = keys or []
    slim = materialize(docs.select("doc_id", *keys, "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), seeded_order("doc_id", seed).alias("h")))
    sizes = materialize(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = materialize(source_targets(sizes, weights, budget, max_epochs))
    targets = targets.withColumn("goal", F.round("target").cast("long")).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("part", F.col("goal") - F.col("whole") * F.col("source_size"))
    small = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = slim.withColumn("slice", F.substring("h", 1, 3))
    sums = named.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    over_slices = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("slice").alias("c"), F.coalesce(F.sum("slice_size").over(over_slices), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("source", "slice").orderBy("h", "size", *keys).rowsBetween(W.unboundedPreceding, -1)
    rows = named.withColumn("earlier", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, rows.source.eqNullSafe(sums.s) & (rows.slice == sums.c))
    goal = targets.select(F.col("source").alias("t"), "source_size", "target", "whole", "part")
    rows = rows.join(F.broadcast(goal) if small else goal, rows.source.eqNullSafe(F.col("t")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("ahead") - F.col("earlier")))
    return rows.select("doc_id", *keys, "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def repeat_mixed(docs: DataFrame, mixed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows that a mix holds: ``docs`` once for each whole repetition and, for the rest, cut after so many words.

    ``mixed`` has ``key`` (equal only for equal rows of docs), size and taken.
    """
    take = mixed.select(F.col(key).alias("__mixed"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    take = take.where("__taken > 0")
    rows = docs.join(take, docs[key] == take["__mixed"])
    whole = F.floor(F.col("__taken") / F.col("__size")).cast("int")
    rest = (F.col("__taken") % F.col("__size")).cast("int")
    rows = rows.withColumn("__words", F.explode(F.concat(F.array_repeat(F.col("__size").cast("int"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))))
    start = r"^[\x20\x09-\x0D]*"
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1)), F.lit(1), F.col("__words")), "")
    text = F.when(F.col("__words") == F.col("__size"), F.col("text")).otherwise(F.regexp_replace(cut, start, ""))
    rows = rows.withColumn("text", text)
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*columns)
