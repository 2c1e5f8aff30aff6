"""Query analysis over a table of questions: jurisdiction, legal terms, type, time, expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words whose presence decides, first jurisdiction first.
SIGNALS = {
    "EU": ("eu", "european", "gdpr", "dsa", "dma", "ai act", "celex", "eur-lex", "regulation (eu)", "directive"),
    "UK": ("uk", "united kingdom", "ico", "uk gdpr", "data protection act", "fca", "ofcom", "cma"),
    "US": ("us", "united states", "ftc", "fcc", "cfpb", "sec", "doj", "ntia", "congress", "federal register", "c.f.r.", "u.s.c.", "regulations.gov"),
    "DE": ("germany", "german", "bfdi", "bundestag"),
    "FR": ("france", "french", "cnil"),
}
TYPES = {
    "Enforcement Action": ("enforcement", "fine", "penalty", "violation", "complaint"),
    "Proposed Rule": ("proposed", "rulemaking", "comment period", "nprm"),
    "Regulation": ("directive", "regulation (eu)", "gdpr", "dsa", "dma"),
}
RECENT = ("recent", "latest", "new", "current", "2024", "2025")
# letters of every script, where Java's \w has ASCII ones only
TERMS = (r"\bArticle\s+\d+[a-z]?\b", r"\bSection\s+\d+\b", r"\bGDPR\b", r"\bDSA\b", r"\bDMA\b", r"\bAI Act\b", r"\bCCPA\b", r"\bPIPEDA\b", r"\bCELEX\s*[\p{L}\p{N}_]+")


def holds_any(low: Column, words: tuple[str, ...]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(low, F.lit(w))
    return cond


def _first(low: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(holds_any(low, words), F.lit(name)) for name, words in groups.items()])


def rewrite(queries: DataFrame, text: str) -> DataFrame:
    """``queries`` with jurisdiction (or UNKNOWN), regulation_type, temporal, legal_terms, expansions and all_queries."""
    q = F.col(text)
    low = F.lower(q)
    terms = F.array_distinct(F.concat(*[F.regexp_extract_all(q, F.lit(f"(?i)({p})"), F.lit(1)) for p in TERMS]))
    year = F.regexp_extract(low, r"\b(20\d{2})\b", 1)
    rows = queries.withColumns({
        "jurisdiction": F.coalesce(_first(low, SIGNALS), F.lit("UNKNOWN")), "regulation_type": _first(low, TYPES),
        "temporal": F.when(holds_any(low, RECENT), "recent").when(year != "", year), "legal_terms": terms,
    })
    by_place = F.when(F.col("jurisdiction") != "UNKNOWN", F.concat(F.col("jurisdiction"), F.lit(" regulation: "), q))
    by_terms = F.when(F.size("legal_terms") > 0, F.concat(F.array_join(F.slice("legal_terms", 1, 3), " "), F.lit(" "), q))
    return rows.withColumn("expansions", F.array_compact(F.array(by_place, by_terms))).withColumn("all_queries", F.concat(F.array(q), F.col("expansions")))
