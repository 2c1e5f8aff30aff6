"""Metadata tags of a legal text: jurisdiction, type, dates, citations, amounts."""

from __future__ import annotations

import re
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import matcher
from .text import MONTHS as _MONTHS

# Patterns that speak for a jurisdiction.
JURISDICTION_PATTERNS: dict[str, list[str]] = {
    "EU": [r"\bEU\b", r"\bEuropean Union\b", r"\bEuropean Parliament\b", r"\bEUR-Lex\b", r"\bCELEX\b", r"\bGDPR\b", r"\bDSA\b", r"\bDMA\b", r"\bAI Act\b", r"Regulation \(EU\)", r"Directive \d{4}/\d+/EU"],
    "UK": [r"\bUK\b", r"\bUnited Kingdom\b", r"\bICO\b", r"\bUK GDPR\b", r"\bData Protection Act\b", r"\bFCA\b", r"\bOfcom\b", r"\bCMA\b"],
    "US": [r"\bUSA?\b", r"\bUnited States\b", r"\bFTC\b", r"\bFCC\b", r"\bCFPB\b", r"\bSEC\b", r"\bDOJ\b", r"\bNTIA\b", r"\bCongress\b", r"\bFederal Register\b", r"\bC\.F\.R\.\b", r"\bU\.S\.C\.\b", r"regulations\.gov"],
    "DE": [r"\bGermany\b", r"\bBundestag\b", r"\bBundesrat\b", r"\bBfDI\b"],
    "FR": [r"\bFrance\b", r"\bCNIL\b", r"\bConseil d'État\b"],
    "CA": [r"\bCanada\b", r"\bPIPEDA\b", r"\bOPC\b", r"\bPrivacy Commissioner\b"],
    "AU": [r"\bAustralia\b", r"\bOAIC\b", r"\bAPP\b", r"\bACCC\b"],
}
# The first type with a match is taken.
TYPE_PATTERNS: list[tuple[str, list[str]]] = [
    ("Regulation", [r"\bRegulation \(EU\)", r"\bFinal Rule\b", r"\bfederal regulation\b"]),
    ("Directive", [r"\bDirective \d{4}/\d+", r"\bEU Directive\b"]),
    ("Enforcement Action", [r"\bcomplaint\b", r"\bsettlement\b", r"\bconsent order\b", r"\bcivil penalty\b", r"\benforcement action\b"]),
    ("Monetary Penalty", [r"\bmonetary penalty\b", r"\bfine of\b", r"£[\d,]+", r"\$[\d,]+ million"]),
    ("Proposed Rule", [r"\bProposed Rule\b", r"\bNPRM\b", r"\bNotice of Proposed Rulemaking\b"]),
    ("Guidance", [r"\bguidance\b", r"\bguidelines?\b", r"\bframework\b"]),
    ("Decision", [r"\bdecision\b", r"\bruling\b", r"\badjudication\b"]),
    ("Notice", [r"\bFederal Notice\b", r"\bfederal register notice\b"]),
]
# Kinds of named entities, and the characters of a text that are looked at.
ENTITY_LABELS = ("ORG", "GPE", "LAW", "DATE", "PERSON", "NORP")
ENTITY_TEXT = 50_000


# Forms of dates, currencies with magnitudes, acts.
_DATES = [
    (r"\b(\d{4}-\d{2}-\d{2})\b", "%Y-%m-%d"), (rf"\b(\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})\b", "%d %B %Y"),
    (rf"\b((?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\b", "%B %d %Y"), (r"\b(\d{2}/\d{2}/\d{4})\b", None),
]
_MONEY = r"(?:£|€|\$|USD|EUR|GBP)\s*([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s*(million|billion|bn|m)\b)?"
_ARTICLE = r"(Article\s+\d+[a-z]?(?:\(\d+\))?(?:\s+(?:of\s+)?(?:the\s+)?(?:GDPR|UK\s+GDPR|DSA|DMA|AI\s+Act))?)"
_SIZES = {"million": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9}
#: What a text must hold to have a date, an amount or a citation.
_GATES = {
    "dates": [rf"\b{m}\b" for m in _MONTHS.split("|")], "money": ["£", "€", r"\$", "USD", "EUR", "GBP"], "articles": ["Article"],
}

_DATE, _AMOUNT, _CITED = [(re.compile(p, re.IGNORECASE), form) for p, form in _DATES], re.compile(_MONEY, re.IGNORECASE), re.compile(_ARTICLE, re.IGNORECASE)


def named_entities(text: Column, model=None) -> Column:
    """Entities (text, label, start, end) that ``model`` finds in the first ENTITY_TEXT characters, of the kinds above; none without one.

    ``model``: a pandas UDF text -> array<struct<text:string,label:string,start:int,end:int>>.
    """
    if model is None:
        return F.array().cast("array<struct<text:string,label:string,start:int,end:int>>")
    return F.filter(model(F.substring(text, 1, ENTITY_TEXT)), lambda e: e["label"].isin(*ENTITY_LABELS))


def pattern_counts(text: Column, patterns: dict[str, list[str]]) -> Column:
    """A struct of each label's number of matches of its patterns, in any case; a null text has none. Texts are read once."""
    flat, owner = tuple(p for ps in patterns.values() for p in ps), [i for i, ps in enumerate(patterns.values()) for _ in ps]
    names = list(patterns)

    @F.arrow_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in names]))
    def count(texts: pa.Array) -> pa.Array:
        sums = [[0] * len(names) for _ in range(len(texts))]
        for row, t in zip(sums, texts.to_pylist()):
            for i, n in matcher(flat).counts(t or "").items():
                row[owner[i]] += n
        return pa.StructArray.from_arrays([pa.array([r[i] for r in sums], pa.int32()) for i in range(len(names))], names=names)

    return count(text)


def most(counts: Column, names: list[str]) -> tuple[Column, Column]:
    """The label with most matches, the first on a tie, and its share of all; UNKNOWN and 0 without any."""
    each = {name: counts[name] for name in names}
    best, total = F.greatest(*each.values(), F.lit(0)), sum(each.values(), F.lit(0))
    first = F.coalesce(*[F.when((n == best) & (n > 0), F.lit(name)) for name, n in each.items()], F.lit("UNKNOWN"))
    return first, F.when(total > 0, F.round(best / total, 3)).otherwise(0.0)


def with_label(df: DataFrame, text: Column, patterns: dict[str, list[str]], label: str, confidence: str) -> DataFrame:
    """Adds the label with most matches and its share of all."""
    rows = df.withColumn("__n", pattern_counts(text, patterns))
    first, share = most(F.col("__n"), list(patterns))
    return rows.withColumns({label: first, confidence: share}).drop("__n")


def _first_date(text: str, months: bool) -> str | None:
    """The first of the first kind of date that the text holds: ISO, with a month after or before the day, numbers as they are."""
    for i, (pattern, form) in enumerate(_DATE):
        if (months or i in (0, 3)) and (m := pattern.search(text)):
            if form is None:
                return m[1]
            try:
                return datetime.strptime(" ".join(m[1].replace(",", "").split()), form).date().isoformat()
            except ValueError:
                return m[1]
    return None


def _amounts(text: str) -> list[float]:
    return [float(n.replace(",", "")) * _SIZES.get(size.lower(), 1.0) for n, size in _AMOUNT.findall(text)]


def tags(text: Column) -> Column:
    """All tags of a text in one reading: places (matches of each jurisdiction), type, date, money, articles."""
    places, types = tuple(p for ps in JURISDICTION_PATTERNS.values() for p in ps), tuple(p for _, ps in TYPE_PATTERNS for p in ps)
    place_of = [n for n, ps in JURISDICTION_PATTERNS.items() for _ in ps]
    type_of = [i for i, (_, ps) in enumerate(TYPE_PATTERNS) for _ in ps]
    gates = tuple(p for ps in _GATES.values() for p in ps)
    gate_of = [n for n, ps in _GATES.items() for _ in ps]
    type_names = [n for n, _ in TYPE_PATTERNS]
    names = list(JURISDICTION_PATTERNS)
    digit = re.compile(r"\d")

    def one(t: str) -> tuple:
        machine = matcher(places + types + gates)
        met, maybe = machine.met(t)
        counts, kinds, open_ = dict.fromkeys(names, 0), [], set()
        for i in sorted({*met, *maybe}):
            if i < len(places):
                counts[place_of[i]] += met.get(i) or sum(1 for _ in machine.expressions[i].finditer(t))
            elif i < len(places) + len(types):
                kind = type_of[i - len(places)]
                if not kinds or kind < min(kinds):
                    kinds += [kind] if i in met or machine.expressions[i].search(t) else []
            else:
                open_.add(gate_of[i - len(places) - len(types)])
        kind = type_names[min(kinds)] if kinds else None
        if not digit.search(t):
            return counts, kind, None, [], []
        articles = list(dict.fromkeys(_CITED.findall(t))) if "articles" in open_ else []
        return counts, kind, _first_date(t, "dates" in open_), _amounts(t) if "money" in open_ else [], articles

    place = T.StructType([T.StructField(n, T.IntegerType()) for n in names])
    kind = T.StructType([T.StructField("places", place), T.StructField("type", T.StringType()), T.StructField("date", T.StringType()), T.StructField("money", T.ArrayType(T.DoubleType())), T.StructField("articles", T.ArrayType(T.StringType()))])

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        found = [one(t or "") for t in texts.to_pylist()]
        counts = pa.StructArray.from_arrays([pa.array([f[0][n] for f in found], pa.int32()) for n in names], names=names)
        rest = [pa.array([f[i] for f in found], x) for i, x in ((1, pa.string()), (2, pa.string()), (3, pa.list_(pa.float64())), (4, pa.list_(pa.string())))]
        return pa.StructArray.from_arrays([counts, *rest], names=kind.names)

    return run(text)


def tag_regulations(df: DataFrame, entities: Column | None = None) -> DataFrame:
    """``df`` (raw_text and the metadata columns): present metadata wins over inferred, citations and amounts are added.

    ``entities``: an array column from an entity model, counted; without one there are none.
    """
    own = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))
    rows = df.withColumn("__tags", tags(F.col("raw_text")))
    found = F.col("__tags")
    place, share = most(found["places"], list(JURISDICTION_PATTERNS))
    return rows.withColumns({
        "jurisdiction": F.coalesce(own("jurisdiction"), place), "regulation_type": F.coalesce(own("regulation_type"), found["type"], F.lit("Legal Document")),
        "effective_date": F.coalesce(own("effective_date").try_cast("date"), found["date"].try_cast("date")),
        "article_citations": F.array_join(found["articles"], "|"),
        "fine_amounts": F.concat(F.lit("["), F.array_join(F.transform(found["money"], lambda x: x.cast("string")), ", "), F.lit("]")),
        "named_entities_count": F.size(entities) if entities is not None else F.lit(0), "jurisdiction_confidence": share.cast("float"),
    }).drop("__tags")
