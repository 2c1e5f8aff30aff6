"""Text functions over columns: tokens, HTML, labels by keyword, dates, amounts, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    # splitting at the rest costs less than extracting
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


def strip_html(html: Column, limit: int | None = None) -> Column:
    plain = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")
    return F.trim(plain) if limit is None else F.substring(F.trim(plain), 1, limit)


def first_label(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first keyword, in the order of the rules, that the lower-cased text holds."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in rules], F.lit(default))


def first_pattern(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(v)) for v, p in rules], F.lit(default))


def feed_date(text: Column) -> Column:
    """ISO date of an RFC 2822 time, by its own calendar day; else the first ten characters."""
    day = F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1)
    parsed = F.date_format(F.try_to_timestamp(day, F.lit("d MMM yyyy")), "yyyy-MM-dd")
    return F.when(text.isNotNull() & (text != ""), F.coalesce(parsed, F.substring(text, 1, 10)))


def _magnitude(word: Column) -> Column:
    low = F.lower(word)
    return F.when(low.isin("million", "m"), 1e6).when(low.isin("billion", "bn"), 1e9).otherwise(1.0)


def amounts(text: Column) -> Column:
    """All money amounts as doubles, magnitudes (million, m, billion, bn) applied."""
    # Currencies and magnitudes.
    pattern = r"(?i)(?:£|€|\$|USD|EUR|GBP)\s*([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s*(million|billion|bn|m)(?![\p{L}\p{N}_]))?"
    number = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    word = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(number, word, lambda n, w: F.regexp_replace(n, ",", "").try_cast("double") * _magnitude(w))


def first_pounds(text: Column) -> Column:
    """The first amount in pounds; a million if that word follows within ten characters."""
    # The amount, and how far "million" is looked for.
    pattern = r"(?is)£([\d,]+(?:\.\d+)?)(\s*(?:million|m)?.{0,10})"
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    return number * F.when(F.lower(F.regexp_extract(text, pattern, 2)).contains("million"), 1e6).otherwise(1.0)


def dates(text: Column) -> Column:
    """Distinct dates in ISO form: ISO dates first, then day month year, month day year, and numeric ones as they are."""
    edge = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

    def found(body: str) -> Column:
        return F.regexp_extract_all(text, F.lit(f"(?i){edge[0]}({body}){edge[1]}"), F.lit(1))

    def parsed(body: str, form: str) -> Column:
        def iso(x: Column) -> Column:
            clean = F.regexp_replace(F.regexp_replace(x, ",", ""), r"\s+", " ")
            return F.coalesce(F.date_format(F.try_to_timestamp(clean, F.lit(form)), "yyyy-MM-dd"), x)

        return F.transform(found(body), iso)

    return F.array_distinct(F.concat(
        parsed(r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
        parsed(rf"\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}", "d MMMM yyyy"),
        parsed(rf"(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}", "MMMM d yyyy"),
        found(r"\d{2}/\d{2}/\d{4}"),
    ))


def citations(text: Column) -> Column:
    """Distinct article citations, with a paragraph and an act if they follow."""
    # Acts.
    acts = r"GDPR|UK\s+GDPR|DSA|DMA|AI\s+Act"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?i)(Article\s+\d+[a-z]?(?:\(\d+\))?(?:\s+(?:of\s+)?(?:the\s+)?(?:{acts}))?)"), F.lit(1)))
