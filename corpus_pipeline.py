"""The corpus pipeline: drop toxic texts, then near copies and benchmark passages, mix the sources, write token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs. Every stage works on all that is left; all but the last keep the columns of documents. What a stage writes on the way is
removed when it is done.

Nulls and odd rows, for all stages: null ids, texts and sources are values like any other unless a stage says more; empty and very
long texts are whole; an empty table gives an empty one; extra columns are kept by all but the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import decontam, mixing, simhash, tokens, toxicity
from statuta.llm.common import materialize, scratch_dir, tidy


def _boxed(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text and source, and the whole row as one column, so that no other column can clash."""
    return docs.select("doc_id", "text", "source", *more, F.struct(*docs.columns).alias("__row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the classifier learns from all labels of ``sf_dir``. Repeated rows share their score;
    null and empty texts have the prior's, under one half; a null id has no label."""
    weights = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(_boxed(docs), weights, ["__row"], row="__row").where("score < 0.5").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints of five-word shingles: that with the smallest id; of rows that share
    it, the one whose text has the smallest hash. Null and empty texts are one component; a null id stands behind all others; of
    repeated rows one stays."""
    marked = _boxed(docs, F.xxhash64("text").alias("__h"))
    found = simhash.near_duplicates(marked, ["doc_id", "__h"], shingle=5)
    # components of null ids alone have no smallest id and are told apart by their fingerprint
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")]
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__h").alias("h"))
    best = materialize(found.groupBy(*group).agg(F.min(rank).alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.h").alias("__hash")))
    kept = marked.join(best, marked.doc_id.eqNullSafe(best["__id"]) & (marked["__h"] == best["__hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__h"]).select("__row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have none. Repeated rows all stay or all go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_contamination(_boxed(docs), benchmark, ["__row"]).where("not contaminated").select("__row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one on a source's border is cut. Documents without words are never taken;
    equal rows take together what each of them would; a null source is one of its own."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(*docs.columns).cast("string"))
    marked = _boxed(docs, key.alias("__key"))
    mixed = mixing.mix_sources(marked, [3.0, 1.0, 2.0], keys=["__key"])
    once = mixed.groupBy("__key").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
    rows = mixing.repeat_mixed(marked.dropDuplicates(["__key"]), once, "__key", ["__row", "text"])
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, and what they hold. A null text is an empty one; null ids come first; repeated rows are
    written as often as they occur."""
    root = scratch_dir(spark)
    tokens.write_tokens(docs, root, tokens.TokenParams(public_tokenizers.path("word_bpe_49k.json")))
    return tokens.read_tokens(spark, root)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: Learning, shingle hashes and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tidy(stage)(spark, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)
