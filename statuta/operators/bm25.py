"""A stored inverted index for Okapi BM25 over tables of queries.

Documents are dealt by a hash of their id into shards of bounded text, which are inverted where they arrive. A row of the
postings is a term's list in a shard: documents, term counts and lengths side by side, with the largest count and the least
length, which bound what any document of the list can get. Rows are sorted by term, so a search reads the lists of the asked
terms alone. A table of terms holds document frequencies; the mean idf, the number of documents and of words stand beside it.
New documents are a further segment with shards of its own; the terms are then summed anew and the old version stays readable.

A shard scores all queries of a block at once, so only its first k of each are shuffled. A query's lists are added from the
highest bound down; once what is left can't lift any other document to the kth score, the rest is added to those few alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.operators.ranking import first_k
from statuta.scratch import scratch_dir

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of (query, term) that are broadcast at a time.
BLOCK_TERMS = 200_000
#: Asked terms up to this many are a filter of the scan; more are a broadcast join.
FILTER_TERMS = 5_000
#: Bytes of text in a shard, about.
SHARD_BYTES = 16 << 20
#: Scores are compared with this to spare, more than another order of adding can change.
SPARE = 1e-6


@dataclass(frozen=True)
class Bm25Index:
    """postings: segment, shard, term, most (its largest count), least (tokens of the shortest document), docs, tf, dl (arrays).
    terms: term, df. segments: (segment, shards). n documents of avgdl tokens; mean_idf over all terms."""

    postings: DataFrame
    terms: DataFrame
    segments: tuple[tuple[int, int], ...]
    n: int
    avgdl: float
    mean_idf: float


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` -> key, dl (its tokens), term, tf: a row per document and token that it holds. A document is counted where it is read,
    column-wise and some MB at a time, so nothing is shuffled. Tokens are those of ``functions.text.tokens``; nulls have none."""
    kind = T.StructType([docs.schema[key], T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _pieces(b):
                yield _counted(part, kind.names)

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, kind)


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about 4 MB of text (column 1)."""
    ends, start = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)), 0
    while start < b.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (4 << 20), side="right")))
        yield b.slice(start, stop - start)
        start = stop


def _counted(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    cut = pc.split_pattern_regex(pc.utf8_lower(batch.column(1)), r"[^\p{L}\p{N}_]+")
    coded = cut.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(cut)), np.diff(cut.offsets.to_numpy()))
    code = coded.indices.to_numpy().astype(np.int64)
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[code]
    owner, code = owner[real], code[real]
    pairs, tf = np.unique(owner * len(coded.dictionary) + code, return_counts=True)
    doc, term = np.divmod(pairs, max(1, len(coded.dictionary)))
    dl = np.bincount(owner, minlength=len(cut))[doc].astype(np.int32)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(dl), coded.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int32))], names=names)


def _inverted(t: pa.Table, names: list[str]) -> pa.Table:
    """A shard's documents (id, text, shard) as lists by term."""
    counted = pa.Table.from_batches([_counted(part, ["doc_id", "dl", "term", "tf"]) for b in t.to_batches() for part in _pieces(b)])
    coded = pc.dictionary_encode(counted["term"].combine_chunks())
    code, tf, dl = coded.indices.to_numpy(), counted["tf"].to_numpy(), counted["dl"].to_numpy()
    by = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[by], prepend=-1))
    offsets = pa.array(np.append(starts, len(by)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, counted[c].combine_chunks().take(pa.array(by))) for c in ("doc_id", "tf", "dl")]
    most, least = (np.maximum.reduceat(tf[by], starts), np.minimum.reduceat(dl[by], starts)) if len(by) else (tf, dl)
    shard = pa.array(np.full(len(starts), t["shard"][0].as_py(), np.int32))
    return pa.table([shard, coded.dictionary.take(pa.array(code[by][starts])), pa.array(most), pa.array(least), *lists], names=names)


def append_bm25(docs: DataFrame, path: str) -> Bm25Index:
    """Add ``docs`` (doc_id, text) to the index below ``path``, or begin it: a segment more, and a new version of terms and sizes."""
    spark = docs.sparkSession
    known = _latest(spark, path)
    version = 0 if known is None else known.version + 1
    text = F.coalesce(F.col("text"), F.lit(""))
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0)), F.count("*")).first()
    # at least two for each core where the text is small, none much under 1 MB
    shards = max(1, -(-size // SHARD_BYTES), min(2 * spark.sparkContext.defaultParallelism, size >> 20))
    id_type = docs.schema["doc_id"].dataType
    kind = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("most", T.IntegerType()), T.StructField("least", T.IntegerType())]
        + [T.StructField(c, T.ArrayType(x)) for c, x in (("docs", id_type), ("tf", T.IntegerType()), ("dl", T.IntegerType()))]
    )
    dealt = docs.select("doc_id", text.alias("text"), _shard("doc_id", shards).alias("shard"))
    lists = dealt.groupBy("shard").applyInArrow(lambda t: _inverted(t, kind.names), kind).sortWithinPartitions("term")
    lists.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings/segment={version}")
    own = spark.read.parquet(f"{path}/postings/segment={version}").groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words"))
    if known is not None:
        own = own.unionByName(spark.read.parquet(f"{path}/terms/version={known.version}")).groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    own.sortWithinPartitions("term").write.parquet(f"{path}/terms/version={version}")
    n = rows + (0 if known is None else known.n)
    words, mean = spark.read.parquet(f"{path}/terms/version={version}").agg(F.coalesce(F.sum("words"), F.lit(0)), F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()
    segments = [*([] if known is None else map(tuple, known.segments)), (version, shards)]
    # written last: who reads the sizes finds all of the version there
    row = (version, n, words / n if n else 0.0, mean or 0.0, segments)
    spark.createDataFrame([row], "version int, n long, avgdl double, mean_idf double, segments array<struct<segment:int,shards:int>>").coalesce(1).write.parquet(f"{path}/sizes/of={version}")
    return read_bm25(spark, path)


def build_bm25(docs: DataFrame, path: str | None = None) -> Bm25Index:
    """An index of ``docs`` (doc_id, text) alone, below a scratch folder if no path is given."""
    return append_bm25(docs, path or scratch_dir(docs.sparkSession))


def _shard(doc_id: str, shards: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def _latest(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sizes")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(f"{path}/sizes").orderBy(F.col("version").desc()).first()


def read_bm25(spark: SparkSession, path: str) -> Bm25Index:
    known = _latest(spark, path)
    postings = spark.read.parquet(f"{path}/postings").where(F.col("segment") <= known.version)
    return Bm25Index(postings, spark.read.parquet(f"{path}/terms/version={known.version}"), tuple(map(tuple, known.segments)), known.n, known.avgdl, known.mean_idf)


class _Lists:
    """A shard's lists of the asked terms, with what each document gets from a term, its weight aside."""

    def __init__(self, t: pa.Table, avgdl: float, allowed: pa.Table | None):
        lengths = pc.list_value_length(t["docs"]).to_numpy()
        ids = pc.list_flatten(t["docs"])
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        coded = ids.dictionary_encode(null_encoding="encode")
        tf, dl = (pc.list_flatten(t[c]).to_numpy().astype(float) for c in ("tf", "dl"))
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        most, least = t["most"].to_numpy().astype(float), t["least"].to_numpy().astype(float)
        bound = most * (K1 + 1) / (most + K1 * (1 - B + B * least / avgdl))
        self.ids, doc, ends = coded.dictionary, coded.indices.to_numpy(), np.cumsum(lengths)
        self.open = np.ones(len(self.ids), bool) if allowed is None else pc.is_in(self.ids, value_set=allowed["doc_id"].combine_chunks()).to_numpy(zero_copy_only=False)
        self.of = {term: (doc[e - n : e], part[e - n : e], b) for term, e, n, b in zip(t["term"].to_pylist(), ends, lengths, bound)}

    def first(self, terms: list[tuple[str, float]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """``terms`` with their weights -> documents that may be among the first k, their scores, and postings that were added."""
        lists = sorted(((*self.of[t], w) for t, w in terms if t in self.of and w), key=lambda x: (x[3] > 0, -x[2] * x[3]))
        score, added = np.zeros(len(self.ids)), 0
        met = np.zeros(len(self.ids), bool)
        left = np.cumsum([max(0.0, b * w) for *_, b, w in lists][::-1])[::-1].tolist() + [0.0]
        few = None
        for i, (doc, part, _, w) in enumerate(lists):
            if few is None and i and w > 0 and left[i] < 0.5 * left[0]:
                among = score[met & self.open]
                kth = np.partition(among, len(among) - k)[len(among) - k] if len(among) >= k else -np.inf
                if left[i] < kth - SPARE:  # no document that isn't met yet comes among the first k
                    few = met & self.open & (score + left[i] >= kth - SPARE)
            if few is not None:
                at = few[doc]
                doc, part = doc[at], part[at]
            else:
                met[doc] = True
            added += len(doc)
            score += np.bincount(doc, weights=part * w, minlength=len(score))
        rows = np.flatnonzero((met if few is None else few) & self.open & (score > 0))
        if len(rows) > k:
            rows = rows[score[rows] >= np.partition(score[rows], len(rows) - k)[len(rows) - k] - SPARE]
        return rows, score[rows], added


def _asked(index: Bm25Index, asked: DataFrame) -> list[pa.Table]:
    """``asked`` (query_id, term, qf) with the terms' weights, about BLOCK_TERMS rows at a time."""
    blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    for i in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        terms = index.terms.join(F.broadcast(own.select("term").distinct()), "term", "left_semi")
        idf = F.log(index.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        weights = terms.select("term", F.when(idf < 0, EPSILON * index.mean_idf).otherwise(idf).alias("idf"))
        yield own.join(F.broadcast(weights), "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("weight")).toArrow()


def search_bm25(index: Bm25Index, queries: DataFrame, k: int, where: DataFrame | None = None) -> DataFrame:
    """``queries`` (query_id, text) -> query_id, doc_id, score, rank: Okapi BM25, repeats of a query term count.

    Terms in over half of the documents, whose idf is negative, get EPSILON times the mean idf of the vocabulary. ``where``
    (doc_id) limits the documents before the first k are taken; statistics stay those of the index. Only scores over zero
    count. Rows of equal doc_id are one document; queries of a null id are one.
    """
    spark = queries.sparkSession
    id_type = index.postings.schema["docs"].dataType.elementType
    kind = T.StructType([queries.schema["query_id"], T.StructField("doc_id", id_type), T.StructField("score", T.DoubleType())])
    per_segment = F.element_at(F.create_map(*[F.lit(x) for s in index.segments for x in s]), F.col("segment"))
    allowed = None
    if where is not None:
        segments = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.lit(n).alias("shards")) for s, n in index.segments]))
        allowed = where.select("doc_id").distinct().select("doc_id", segments.alias("s")).select("doc_id", "s.segment", F.pmod(F.xxhash64("doc_id"), "s.shards").cast("int").alias("shard"))
    parts = []
    asked = term_counts(queries, "query_id").groupBy("query_id", "term").agg(F.sum("tf").alias("qf"))
    for block in _asked(index, asked):
        terms = pc.unique(block["term"]).to_pylist()
        lists = index.postings.where(per_segment.isNotNull())
        if len(terms) <= FILTER_TERMS:  # words of letters, digits and underscores
            lists = lists.where(f"term IN ({', '.join(repr(t) for t in terms)})") if terms else lists.limit(0)
        else:
            lists = lists.join(F.broadcast(spark.createDataFrame(pa.table({"term": terms}))), "term", "left_semi")
        parts.append(_scored(index, lists, block, k, allowed, kind))
    total = reduce(DataFrame.unionByName, parts)
    return first_k(total, "query_id", [F.round("score", 9).desc(), F.col("doc_id")], k)


def _scored(index: Bm25Index, lists: DataFrame, block: pa.Table, k: int, allowed: DataFrame | None, kind: T.StructType) -> DataFrame:
    sent, avgdl = lists.sparkSession.sparkContext.broadcast(block), index.avgdl

    def score(t: pa.Table, only: pa.Table | None) -> pa.Table:
        block, own = sent.value.combine_chunks(), None
        own = _Lists(t, avgdl, only)
        code = pc.dictionary_encode(block["query_id"].combine_chunks(), null_encoding="encode")
        by, who, what, scores = {}, [], [], []
        for q, term, weight in zip(code.indices.to_pylist(), block["term"].to_pylist(), block["weight"].to_pylist()):
            by.setdefault(q, []).append((term, weight))
        for q, terms in by.items():
            rows, found, _ = own.first(terms, k)
            who.append(np.full(len(rows), q))
            what.append(rows)
            scores.append(found)
        take = lambda values, at: values.take(pa.array(np.concatenate([*at, np.zeros(0)]).astype(np.int64)))
        return pa.table([take(code.dictionary, who), take(own.ids, what), pa.array(np.concatenate([*scores, np.zeros(0)]))], names=kind.names)

    if allowed is None:
        return lists.groupBy("segment", "shard").applyInArrow(lambda t: score(t, None), kind)
    empty = pa.table([pa.array([], pa.null())] * len(kind.names), names=kind.names)

    def both(t: pa.Table, only: pa.Table) -> pa.Table:
        return score(t, only) if t.num_rows else empty

    return lists.groupBy("segment", "shard").cogroup(allowed.groupBy("segment", "shard")).applyInArrow(both, kind)


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Index ``docs`` and search it once."""
    return search_bm25(build_bm25(docs), queries, k)
