"""Prompts, citations and answer sections for a table of questions with their ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_prompts(hits: DataFrame, group: str, order: str, parts: list[str], text: str, body: int = 800, excerpt: int = 150) -> DataFrame:
    """One row per group: its hits in order as "[i] part | part" headers over texts of ``body`` characters, and their excerpts."""
    some = [F.when(F.col(p).isNotNull() & (F.col(p).cast("string") != ""), F.col(p).cast("string")) for p in parts]
    item = F.struct(F.col(order).alias("i"), F.concat_ws(" | ", *some).alias("head"), F.substring(text, 1, body).alias("body"), F.substring(text, 1, excerpt).alias("excerpt"))
    rows = hits.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    shown = F.transform("items", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["head"], F.lit("\n"), x["body"]))
    return rows.select(group, F.array_join(shown, "\n---\n").alias("context"), F.transform("items", lambda x: x["excerpt"]).alias("excerpts"))


def parse_answer(answers: DataFrame, text: str, sections: tuple[str, ...]) -> DataFrame:
    """Sections of answers written as ``**Name:** body`` in this order; a text without the first is all of the first."""
    out = {}
    for i, name in enumerate(sections):
        end = rf"(?=\*\*(?:{'|'.join(sections[i + 1 :])}):\*\*|\z)" if i + 1 < len(sections) else r"\z"
        out[f"section_{i + 1}"] = F.trim(F.regexp_extract(text, rf"(?is)\*\*{name}:\*\*\s*(.*?)\s*{end}", 1))
    rows = answers.withColumns(out)
    return rows.withColumn("section_1", F.when(F.col("section_1") == "", F.col(text)).otherwise(F.col("section_1")))


def format_citations(cited: DataFrame, group: str, order: str) -> DataFrame:
    """One row per group: "[i] title — article | jurisdiction (date) | address", a line per citation in order; article and date only where there are any.

    ``cited``: group, order, title, article_ref, jurisdiction, effective_date, source_url. The citations of an answer are few.
    """
    given = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    article = F.when(given("article_ref"), F.concat(F.lit(" — "), text("article_ref"))).otherwise("")
    date = F.when(given("effective_date"), F.concat(F.lit(" ("), text("effective_date"), F.lit(")"))).otherwise("")
    line = F.concat(text("title"), article, F.lit(" | "), text("jurisdiction"), date, F.lit(" | "), text("source_url"))
    rows = cited.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), line.alias("line")))).alias("c"))
    return rows.select(group, F.array_join(F.transform("c", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["line"])), "\n").alias("references"))
