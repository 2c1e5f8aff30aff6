"""Overlapping chunks of long texts: by sliding windows over plain text, or by structural blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import ids

from .dedup import keep_first

CHARS_PER_TOKEN = 3.8


def sizes(tokens: int = 512, overlap: int = 51) -> tuple[int, int]:
    """Characters in a chunk and in its overlap with the next."""
    size, shared = int(tokens * CHARS_PER_TOKEN), int(overlap * CHARS_PER_TOKEN)
    if shared * 3 >= size:
        raise ValueError("the overlap must be under a third of a chunk")
    return size, shared


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each window: cut at the last blank line, else after the last sentence, past the middle of the step."""
    at, middle = 0, (size - overlap) // 2
    while at < len(text):
        stop = at + size
        if stop < len(text):
            blank, sentence = text.rfind("\n\n", at, stop), text.rfind(". ", at, stop)
            stop = next((x for x, cut in ((blank, blank), (sentence + 1, sentence)) if cut > at + middle), stop)
        yield at, stop
        at = stop - overlap


def chunk_text(docs: DataFrame, key: str, text: str, tokens: int = 512, overlap: int = 51) -> DataFrame:
    """``docs`` with a row per chunk: chunk_index, total_chunks, chunk_text, token_estimate, chunk_id; blank texts give none."""
    size, shared = sizes(tokens, overlap)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [c for a, b in windows(t, size, shared) if (c := t[a:b].strip())] if t else [])

    rows = docs.withColumn("__chunks", cut(F.col(text)))
    rows = rows.select("*", F.size("__chunks").alias("total_chunks"), F.posexplode("__chunks").alias("chunk_index", "chunk_text")).drop("__chunks")
    return _finish(rows, key)


@F.udtf(returnType="chunk_index int, total_chunks int, chunk_text string, token_estimate int")
class Chunks:
    """The chunks of one text, for SQL: ``FROM docs d, LATERAL chunk(d.text, 512, 51)``; a null or blank text gives none."""

    def eval(self, text: str | None, tokens: int = 512, overlap: int = 51) -> Iterator[tuple[int, int, str, int]]:
        size, shared = sizes(tokens, overlap)
        found = [c for a, b in windows(text, size, shared) if (c := text[a:b].strip())] if text else []
        for i, c in enumerate(found):
            yield i, len(found), c, max(1, len(c) // int(CHARS_PER_TOKEN))


def register_chunks(spark: SparkSession, name: str = "chunk") -> None:
    """The table function ``chunk(text, tokens, overlap)`` of this session."""
    spark.udtf.register(name, Chunks)


def chunk_documents(docs: DataFrame, key: str, text: str, blocks: DataFrame | None = None, order: list | None = None, tokens: int = 512, overlap: int = 51) -> DataFrame:
    """Chunks of every document: by its structural blocks where ``blocks`` has any for its key, else by windows over its text.

    Columns: those of ``docs`` but for the text, chunk_index, total_chunks, chunk_text, token_estimate, chunk_id and, of
    blocks, page_number, block_type and references. Of several documents of a key with blocks the first by ``order`` counts.
    """
    if blocks is None:
        return chunk_text(docs, key, text, tokens, overlap).drop(text)
    known = blocks.where(F.trim("text") != "").select(key).distinct()
    by_block = chunk_blocks(blocks.join(docs.select(key).distinct(), key, "left_semi"), key, tokens, overlap)
    about = keep_first(docs.drop(text), key, order or [c for c in docs.columns if c not in (key, text)] or [key])
    rest = docs.join(known, key, "left_anti")
    return by_block.join(about, key).unionByName(chunk_text(rest, key, text, tokens, overlap).drop(text), allowMissingColumns=True)


def _finish(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumns({"token_estimate": F.greatest(F.lit(1), F.floor(F.length("chunk_text") / int(CHARS_PER_TOKEN))).cast("int"), "chunk_id": ids.chunk_id(key, "chunk_index", "chunk_text")})


def chunk_blocks(blocks: DataFrame, key: str, tokens: int = 512, overlap: int = 51) -> DataFrame:
    """``blocks`` (key, block_idx, text, page_number, block_type, article_ref, section_ref, chapter_ref) -> a row per chunk.

    Blocks are joined until an article or chapter begins or the next one would pass the size; a chunk begins with the tail of the
    one before and takes its references from its last block.
    """
    size, shared = sizes(tokens, overlap)
    refs = [c for c in blocks.columns if c in ("page_number", "article_ref", "section_ref", "chapter_ref", "block_type")]
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    # the blocks of one text are one row: a text is bounded, and rows travel to Python in batches
    rows = blocks.withColumn("text", body).where("text != ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_idx", "text", *refs))).alias("__blocks"))

    @F.pandas_udf("array<struct<last:int,text:string>>")
    def fold(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([_fold(list(t), list(k), size, shared) for t, k in zip(texts, kinds)])

    rows = rows.withColumn("__chunks", fold(F.transform("__blocks", lambda b: b["text"]), F.transform("__blocks", lambda b: b["block_type"])))
    rows = rows.select(key, F.size("__chunks").alias("total_chunks"), "__blocks", F.posexplode("__chunks").alias("chunk_index", "c"))
    last = F.element_at("__blocks", F.col("c.last") + 1)
    return _finish(rows.select(key, "chunk_index", "total_chunks", F.col("c.text").alias("chunk_text"), *[last[r].alias(r) for r in refs]), key)


def _fold(texts: list[str], kinds: list[str], size: int, shared: int) -> list[dict]:
    """Chunks of one text's blocks, each with the place of its last block."""
    cuts, held = [], 0
    for i, (text, kind) in enumerate(zip(texts, kinds)):
        if held and (kind in ("article", "chapter") or held + len(text) > size):
            cuts.append(i)
            held = 0
        held += len(text)
    bodies = [(j - 1, " ".join(texts[i:j])) for i, j in zip([0, *cuts], [*cuts, len(texts)])]
    tails = ["", *[b[-shared:] if shared else "" for _, b in bodies]]
    return [{"last": at, "text": tail + body} for (at, body), tail in zip(bodies, tails)]
