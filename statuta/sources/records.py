"""Payloads of the public sources as records: each function takes a DataFrame with a ``payload`` string and gives landed columns.

Fetching is apart (``readers``): what comes back is landed as it is, and parsing is a declared plan over it.
"""

from __future__ import annotations

import json
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import ids, text
from statuta.operators.dedup import keep_first
from statuta.schema import LANDED

# First keyword found decides.
EURLEX_TYPES = [("regulation", "Regulation"), ("directive", "Directive"), ("decision", "Decision"), ("recommendation", "Recommendation")]
FTC_TOPICS = [
    ("privacy", "Privacy Enforcement"), ("data", "Data Protection"), ("merger", "Merger Review"), ("antitrust", "Antitrust Action"),
    ("consumer", "Consumer Protection"), ("advertising", "Advertising Enforcement"), ("competition", "Competition Enforcement"),
]
FTC_KEYWORDS = ("enforcement", "complaint", "settlement", "consent order", "civil penalty", "injunction", "violation", "charges", "data breach", "privacy", "deceptive", "unfair")
ICO_TYPES = [
    ("monetary penalty", "Monetary Penalty Notice"), ("enforcement notice", "Enforcement Notice"), ("undertaking", "Undertaking"),
    ("reprimand", "Reprimand"), ("warning", "Warning"), ("prosecution", "Criminal Prosecution"),
]
BILL_TYPES = {
    "hr": "House Bill", "s": "Senate Bill", "hjres": "House Joint Resolution", "sjres": "Senate Joint Resolution", "hconres": "House Concurrent Resolution",
    "sconres": "Senate Concurrent Resolution", "hres": "House Simple Resolution", "sres": "Senate Simple Resolution",
}
DOCUMENT_TYPES = {
    "Proposed Rule": "Proposed Rulemaking", "Rule": "Final Rule", "Notice": "Federal Notice", "Supporting & Related Material": "Supporting Material",
    "Public Submission": "Public Comment", "Other": "Other Federal Document",
}
#: Fixed value: an article, with a paragraph and the act if they follow.
ARTICLE = r"(?i)(Article\s+\d+[a-z]?(?:\(\d+\))?(?:\s+(?:UK\s+)?GDPR)?)"
#: Agencies that are asked.
AGENCIES = ("FCC", "FTC", "NTIA", "DOJ", "SEC", "CFPB", "DHS", "CISA")


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def landed(rows: DataFrame, source: str, ingested_at: Column) -> DataFrame:
    """Adds ids, version and time, and puts the required columns first."""
    full = rows.withColumns({
        "regulation_id": ids.regulation_id("source_url"), "source_hash": ids.source_hash("raw_text"), "version_id": F.lit(1), "ingested_at": ingested_at, "source_name": F.lit(source),
    })
    return full.select(*LANDED, *[c for c in full.columns if c not in LANDED])


def eurlex(payloads: DataFrame, ingested_at: Column) -> DataFrame:
    """SPARQL JSON results."""
    cell = "struct<value:string>"
    j = F.from_json("payload", f"struct<results:struct<bindings:array<struct<celex:{cell},title:{cell},date:{cell},type:{cell}>>>>")
    rows = payloads.select(F.explode(j["results"]["bindings"]).alias("b")).select(*[F.col(f"b.{c}.value").alias(c) for c in ("celex", "title", "date", "type")])
    title = F.coalesce("title", F.concat(F.lit("EUR-Lex "), F.col("celex")))
    kind = text.first_label(F.coalesce("type", F.lit("")), EURLEX_TYPES, "Legal Act")
    return landed(rows.select(
        title.alias("title"), F.lit("EU").alias("jurisdiction"), kind.alias("regulation_type"), F.substring("date", 1, 10).alias("effective_date"),
        F.concat(F.lit("https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"), F.col("celex")).alias("source_url"), F.concat_ws(" ", title, "celex", "type").alias("raw_text"),
    ), "eurlex", ingested_at)


def congress(payloads: DataFrame, ingested_at: Column) -> DataFrame:
    """Bill lists."""
    j = F.from_json("payload", "struct<bills:array<struct<type:string,number:string,congress:int,title:string,policyArea:struct<name:string>,latestAction:struct<actionDate:string>>>>")
    rows = payloads.select(F.explode(j["bills"]).alias("b")).select("b.*")
    kind = _lookup(F.lower("type"), BILL_TYPES, F.lit("Legislation"))
    area = F.coalesce("policyArea.name", F.lit(""))
    return landed(rows.select(
        F.coalesce("title", F.lit("")).alias("title"), F.lit("US").alias("jurisdiction"), kind.alias("regulation_type"), F.col("latestAction.actionDate").alias("effective_date"),
        F.concat(F.lit("https://www.congress.gov/bill/"), F.col("congress").cast("string"), F.lit("th-congress/"), F.col("number")).alias("source_url"),
        F.concat_ws(" ", F.coalesce("title", F.lit("")), area, kind, F.lit("Congress"), F.col("congress").cast("string")).alias("raw_text"),
    ), "congress", ingested_at)


def regulations_gov(payloads: DataFrame, ingested_at: Column) -> DataFrame:
    """Document lists."""
    j = F.from_json("payload", "struct<data:array<struct<id:string,attributes:struct<title:string,documentType:string,postedDate:string,docketId:string,agencyId:string>>>>")
    rows = payloads.select(F.explode(j["data"]).alias("d")).select("d.id", "d.attributes.*")
    kind = _lookup(F.col("documentType"), DOCUMENT_TYPES, F.col("documentType"))
    return landed(rows.select(
        F.coalesce("title", F.lit("")).alias("title"), F.lit("US").alias("jurisdiction"), kind.alias("regulation_type"), F.substring("postedDate", 1, 10).alias("effective_date"),
        F.concat(F.lit("https://www.regulations.gov/document/"), F.col("id")).alias("source_url"),
        F.concat_ws(" ", F.coalesce("title", F.lit("")), kind, "agencyId", F.concat(F.lit("docket "), F.col("docketId"))).alias("raw_text"), F.col("agencyId").alias("agency_id"), F.col("docketId").alias("docket_id"),
    ), "regulations_gov", ingested_at)


def _items(payloads: DataFrame, *more: str) -> DataFrame:
    item = "struct<title:string,link:string,pubDate:string,description:string>"
    j = F.from_xml("payload", f"struct<channel:struct<item:array<{item}>>>")
    return payloads.select(*more, F.posexplode(j["channel"]["item"]).alias("__at", "i")).select(*more, "__at", "i.*")


def ftc(payloads: DataFrame, ingested_at: Column, limit: int | None = None, feed: str | None = None) -> DataFrame:
    """RSS items on enforcement, the first of each address (a missing one is an address like any other), then the first ``limit``.

    ``feed``: a column by which the feeds are ordered; without one they go by their content.
    """
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    order = [F.col("__feed") if feed else F.xxhash64("title", "link", "pubDate", "description"), F.col("__at")]
    rows = _items(payloads.withColumn("__feed", F.col(feed)) if feed else payloads, *(["__feed"] if feed else []))
    rows = rows.withColumn("raw_text", body).where(F.lower("raw_text").rlike("|".join(FTC_KEYWORDS)))
    rows = keep_first(rows.withColumn("__url", F.coalesce("link", F.lit(""))), "__url", order)
    rows = rows if limit is None else rows.orderBy(*order).limit(limit)
    return landed(rows.select(
        F.coalesce("title", F.lit("")).alias("title"), F.lit("US").alias("jurisdiction"), text.first_label(F.col("raw_text"), FTC_TOPICS, "Enforcement Action").alias("regulation_type"),
        text.feed_date(F.col("pubDate")).alias("effective_date"), F.col("link").alias("source_url"), "raw_text",
    ), "ftc", ingested_at)


def _ico(rows: DataFrame, ingested_at: Column) -> DataFrame:
    body = F.col("raw_text")
    articles = F.array_distinct(F.regexp_extract_all(body, F.lit(ARTICLE), F.lit(1)))
    return landed(rows.select(
        "title", F.lit("UK").alias("jurisdiction"), text.first_label(body, ICO_TYPES, "GDPR Enforcement Decision").alias("regulation_type"), "effective_date", "source_url", "raw_text",
        text.first_pounds(body).alias("fine_amount_gbp"), F.array_join(articles, "|").alias("gdpr_articles"),
    ), "ico", ingested_at)


def ico(payloads: DataFrame, ingested_at: Column) -> DataFrame:
    """RSS items."""
    rows = _items(payloads)
    return _ico(rows.select(F.coalesce("title", F.lit("")).alias("title"), text.feed_date(F.col("pubDate")).alias("effective_date"), F.col("link").alias("source_url"), F.concat_ws(" ", "title", "description").alias("raw_text")), ingested_at)


def links(pages: DataFrame, html: str, base: str, under: str, limit: int | None = None) -> DataFrame:
    """``pages`` with a row per anchor below a path: link_index, source_url, title (white space collapsed, five characters or more)."""
    pattern = rf'(?is)<a\b[^>]*\bhref="({under}[^"]*)"[^>]*>(.*?)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"))
    pairs = F.slice(pairs, 1, limit) if limit else pairs
    rows = pages.select("*", F.posexplode(pairs).alias("link_index", "__l"))
    label = F.trim(F.regexp_replace(F.regexp_replace(F.col("__l.label"), "<[^>]+>", " "), r"\s+", " "))
    url = F.when(F.col("__l.href").rlike("^https?://"), F.col("__l.href")).otherwise(F.concat(F.lit(base), F.col("__l.href")))
    return rows.withColumns({"source_url": url, "title": label}).drop("__l").where(F.length("title") >= 5)


def ico_html(pages: DataFrame, ingested_at: Column, limit: int) -> DataFrame:
    """The HTML list, for when the feed is empty: ``payload`` holds the page."""
    rows = links(pages, "payload", "https://ico.org.uk", "/action-weve-taken/enforcement/", limit)
    return _ico(rows.select("title", F.lit(None).cast("string").alias("effective_date"), "source_url", F.concat(F.col("title"), F.lit(" GDPR enforcement ICO UK")).alias("raw_text")), ingested_at)


def ico_with_fallback(feed: DataFrame, pages: DataFrame, ingested_at: Column, limit: int) -> DataFrame:
    """The feed's first ``limit`` items or, if it has none, those of the HTML list."""
    rows = ico(feed, ingested_at)
    return (ico_html(pages, ingested_at, limit) if rows.isEmpty() else rows).limit(limit)


#: Messages of a run's requests that its health row keeps, at most.
MESSAGES = 100
# What is asked of the public SPARQL service: works in force from a date on, titles and kinds in English, newest first.
SPARQL = """
PREFIX cdm: <http://publications.europa.eu/ontology/cdm#>
PREFIX skos: <http://www.w3.org/2004/02/skos/core#>
PREFIX dc: <http://purl.org/dc/elements/1.1/>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
SELECT DISTINCT ?work ?title ?date ?type ?celex WHERE {
  ?work cdm:work_date_document ?date ; cdm:resource_legal_id_celex ?celex .
  OPTIONAL { ?work dc:title ?title . FILTER(lang(?title) = "en") }
  OPTIONAL { ?work cdm:work_has_resource-type ?kind . ?kind skos:prefLabel ?type . FILTER(lang(?type) = "en") }
  FILTER(?date >= "%s"^^xsd:date && STRSTARTS(STR(?celex), "3"))
} ORDER BY DESC(?date) LIMIT %d
"""


def sparql_request(spark: SparkSession, endpoint: str, since: str, limit: int) -> DataFrame:
    """The one request (url) that ``eurlex`` parses the answer of."""
    query = urlencode({"query": SPARQL % (since, limit), "format": "application/sparql-results+json"})
    return spark.createDataFrame([(f"{endpoint}?{query}",)], "url string")


def run_metrics(rows: DataFrame, source: str, started: float, ended: float, drift: bool = False, errors: list[str] = [], sla: float = 300.0, fetched: DataFrame | None = None) -> DataFrame:
    """A health row of a source's run: rows, duplicates, null rate, and whether it took under ``sla`` seconds.

    ``fetched``: what the source's requests gave, whose column ``error`` tells why some gave nothing. Its distinct messages follow
    ``errors``, in order, the first MESSAGES of them.
    """
    row = health_row(rows, source)
    found = F.array(*map(F.lit, errors)).cast("array<string>")
    if fetched is not None:
        said = fetched.where("error IS NOT NULL").select("error").distinct().orderBy("error").limit(MESSAGES)
        row = row.crossJoin(F.broadcast(said.agg(F.sort_array(F.collect_list("error")).alias("__said"))))
        found = F.concat(found, F.col("__said"))
    return _run(row.withColumn("__errors", F.to_json(found)), source, started, ended, drift, F.lit(ended - started < sla)).drop("__said")


def _run(row: DataFrame, source: str, started: float, ended: float, drift: bool, in_time: Column) -> DataFrame:
    return row.withColumns({
        "run_id": ids.run_id(F.lit(source), F.lit(str(started))), "run_at": F.timestamp_seconds(F.lit(started)), "elapsed_seconds": F.lit(ended - started), "sla_met": in_time,
        "schema_drift": F.lit(drift), "errors": F.col("__errors"),
    }).drop("__errors")


def failed_runs(spark: SparkSession, lost: dict[str, str], started: float, ended: float) -> list[DataFrame]:
    """Health rows of sources that gave nothing: no rows, not in time, and why."""
    rows = []
    for source, why in sorted(lost.items()):
        row = spark.range(1).select(F.lit(source).alias("source"), F.lit(0).cast("long").alias("rows_ingested"), F.lit(0).cast("long").alias("duplicate_count"), F.lit(0.0).alias("null_rate"), F.lit(json.dumps([why])).alias("__errors"))
        rows.append(_run(row, source, started, ended, False, F.lit(False)))
    return rows


def health_row(rows: DataFrame, source: str, columns: list[str] = ["title", "jurisdiction", "regulation_type", "effective_date", "raw_text"]) -> DataFrame:
    """Rows, duplicate hashes and the mean null rate of a landed batch."""
    rate = sum((F.avg(F.col(c).isNull().cast("double")) for c in columns[1:]), F.avg(F.col(columns[0]).isNull().cast("double"))) / len(columns)
    return rows.agg(F.lit(source).alias("source"), F.count("*").alias("rows_ingested"), (F.count("*") - F.count_distinct("source_hash")).alias("duplicate_count"), F.coalesce(rate, F.lit(0.0)).alias("null_rate"))
