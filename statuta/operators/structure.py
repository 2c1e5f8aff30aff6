"""Structure of paged legal texts: paragraphs, their kind and reference, and the chapter, article and section they stand in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.carried import Running, carried, in_window

# Headings, tried in this order on a paragraph's first line.
HEADINGS = (
    ("chapter", r"^(?:Chapter|CHAPTER)\s+([IVXLCDM]+|\d+)", "chapter_"),
    ("article", r"^(?:Article|ARTICLE|Art\.)\s*(\d+[a-z]?)", "article_"),
    ("section", r"^(?:Section|SECTION|§)\s*(\d+(?:\.\d+)*)", "section_"),
    ("recital", r"^\((\d+)\)\s", "recital_"),
)


def paragraphs(pages: DataFrame, key: str) -> DataFrame:
    """``pages`` (key, page_number, text) -> key, page_number, para, text: parts between blank lines, stripped, without empty ones."""
    parts = F.transform(F.split("text", "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return pages.select(key, "page_number", F.posexplode(parts).alias("para", "text")).where("text != ''")


def classify(paras: DataFrame) -> DataFrame:
    """Adds block_type and ref (null for body text) by the first line."""
    line = F.substring_index("text", "\n", 1)
    kind = F.coalesce(*[F.when(line.rlike(p), name) for name, p, _ in HEADINGS], F.lit("body"))
    ref = F.coalesce(*[F.when(line.rlike(p), F.concat(F.lit(prefix), F.regexp_replace(F.regexp_extract(line, p, 1), r"\.", "_"))) for _, p, prefix in HEADINGS])
    return paras.withColumns({"block_type": kind, "ref": ref})


def with_context(paras: DataFrame, key: str, hot: bool = False) -> DataFrame:
    """Adds block_idx, block_id, chapter_ref, article_ref and section_ref; a chapter ends article and section, an article its section.

    A heading's place is carried with it: an article counts if it stands behind the last chapter, a section if it stands behind
    the last chapter and the last article. ``hot``: one document may hold a large part of the paragraphs.
    """
    kinds = ("chapter", "article", "section")
    at = lambda kind, x: F.when(F.col("block_type") == kind, x)
    order = ["page_number", "para"]
    place = F.struct("page_number", "para")
    rows = paras.withColumns({f"__{k}": at(k, F.struct(place.alias("at"), "ref")) for k in kinds})
    values = {"__n": Running("count")} | {f"__last_{k}": Running("last", f"__{k}") for k in kinds}
    rows = carried(rows, [key], order, values) if hot else rows.withColumns({n: in_window(r, [key], order) for n, r in values.items()})
    last = {k: F.col(f"__last_{k}") for k in kinds}

    def within(kind: str, *outer: str) -> Column:
        own = last[kind]
        return reduce(lambda ref, o: F.when(last[o].isNull() | (own["at"] > last[o]["at"]), ref), outer, own["ref"])

    rows = rows.withColumns({"block_idx": (F.col("__n") - 1).cast("int"), "chapter_ref": last["chapter"]["ref"], "article_ref": within("article", "chapter"), "section_ref": within("section", "chapter", "article")})
    rows = rows.withColumn("block_id", F.coalesce("ref", F.concat_ws("_", "block_type", F.col("block_idx").cast("string"))))
    return rows.drop(*[f"__{k}" for k in kinds], *values)
