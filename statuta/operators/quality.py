"""Quality suite: every check of a batch from one aggregate, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The share of nulls that each column may have.
NULL_LIMITS = {
    "regulation_id": 0.0, "source_hash": 0.0, "title": 0.05, "jurisdiction": 0.0, "regulation_type": 0.10, "effective_date": 0.30,
    "source_url": 0.0, "raw_text": 0.05, "version_id": 0.0, "ingested_at": 0.0,
}
# Least rows of a source.
MINIMUM_ROWS = {"eurlex": 5, "congress": 5, "ftc": 3, "regulations_gov": 5, "ico": 3}
# Allowed jurisdictions and types.
VALID_JURISDICTIONS = ("EU", "US", "UK", "DE", "FR", "CA", "AU", "UNKNOWN")
VALID_TYPES = (
    "Regulation", "Directive", "Decision", "Enforcement Action", "Monetary Penalty", "Proposed Rule", "Final Rule", "Notice", "Guidance",
    "Undertaking", "Reprimand", "Warning", "House Bill", "Senate Bill", "House Joint Resolution", "Senate Joint Resolution", "Legislation",
    "Legal Act", "Legal Document", "GDPR Enforcement Decision", "Privacy Enforcement", "Data Protection", "Consumer Protection",
    "Antitrust Action", "Competition Enforcement", "Advertising Enforcement", "Merger Review", "Federal Notice", "Supporting Material",
    "Public Comment", "Other Federal Document", "Criminal Prosecution",
)
URL = r"^https?://\S+$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
HEX_HASH = r"^[a-f0-9]{24,64}$"
SHORTEST_TEXT = 20


class QualityError(ValueError):
    """A critical check failed."""


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row per column: its share of nulls, 0 in an empty frame."""
    rates = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(c) for c in columns])
    return rates.unpivot([], columns, "column_name", "null_rate")


def run_checks(df: DataFrame, source: str = "default", minimum: dict[str, int] = MINIMUM_ROWS) -> DataFrame:
    """check_name, severity, passed, failing (long), in the suite's order (position)."""
    have = set(df.columns)
    text = lambda c: F.col(c).cast("string")
    bad = lambda c, ok: F.count_if(F.col(c).isNotNull() & ~ok)
    aggregates: list[Column] = [F.count("*").alias("n")]
    checks: list[tuple[str, str, Column, Column]] = []  # name, severity, failing, passed

    def add(name: str, severity: str, column: str, failing: Column, missing: str | None = None, limit: Column | None = None) -> None:
        if column not in have:
            if missing:
                checks.append((missing, severity if missing != "duplicate_source_hash" else "info", F.lit(0), F.lit(missing == "duplicate_source_hash")))
            return
        aggregates.append(failing.alias(f"f{len(checks)}"))
        count = F.col(f"f{len(checks)}")
        checks.append((name, severity, count, count <= limit if limit is not None else count == 0))

    checks.append(("not_empty", "critical", F.when(F.col("n") == 0, 1).otherwise(0), F.col("n") > 0))
    lost = [c for c in NULL_LIMITS if c not in have]
    checks.append(("schema_completeness", "critical", F.lit(len(lost)), F.lit(not lost)))
    for c, limit in NULL_LIMITS.items():
        add(f"null_rate_{c}", "critical" if limit == 0 else "warning", c, F.count_if(F.col(c).isNull()), limit=F.lit(limit) * F.col("n"))
    add("duplicate_source_hash", "warning", "source_hash", F.count("*") - F.count_distinct(F.coalesce(text("source_hash") if "source_hash" in have else F.lit(""), F.lit("\0"))), "duplicate_source_hash")
    add("valid_jurisdictions", "warning", "jurisdiction", bad("jurisdiction", F.col("jurisdiction").isin(*VALID_JURISDICTIONS)))
    add("valid_regulation_types", "info", "regulation_type", bad("regulation_type", F.col("regulation_type").isin(*VALID_TYPES)))
    add("url_format", "warning", "source_url", bad("source_url", text("source_url").rlike(URL)))
    add("effective_date_format", "warning", "effective_date", bad("effective_date", text("effective_date").rlike(ISO_DATE)), "date_format")
    add("source_hash_format", "critical", "source_hash", bad("source_hash", text("source_hash").rlike(HEX_HASH)), "hash_format")
    least = minimum.get(source, 1)
    checks.append(("minimum_row_count", "warning", F.greatest(F.lit(least) - F.col("n"), F.lit(0)), F.col("n") >= least))
    add("raw_text_min_length", "warning", "raw_text", F.count_if(F.length("raw_text") < SHORTEST_TEXT), "raw_text_length")
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("check_name"), F.lit(s).alias("severity"), p.alias("passed"), f.cast("long").alias("failing")) for i, (n, s, f, p) in enumerate(checks)])
    return df.agg(*aggregates).select(F.explode(rows).alias("c")).select("c.*")


def bad_values(df: DataFrame) -> DataFrame:
    """check_name, place, value: the smallest distinct values that fail a check: 10 jurisdictions, 5 types, 3 dates, as a report shows them."""
    text = lambda c: F.col(c).cast("string")
    shown = (
        ("valid_jurisdictions", "jurisdiction", ~F.col("jurisdiction").isin(*VALID_JURISDICTIONS), 10), ("valid_regulation_types", "regulation_type", ~F.col("regulation_type").isin(*VALID_TYPES), 5),
        ("effective_date_format", "effective_date", ~text("effective_date").rlike(ISO_DATE), 3),
    )
    parts = []
    for name, column, bad, n in shown:
        if column in df.columns:
            first = df.where(bad).select(text(column).alias("value")).distinct().orderBy("value").limit(n)
            parts.append(first.select(F.lit(name).alias("check_name"), F.row_number().over(W.orderBy("value")).alias("place"), "value"))
    return reduce(DataFrame.unionByName, parts)


def summarize(checks: DataFrame) -> DataFrame:
    """One row: passed (no critical failure), total, critical_failures, warnings."""
    failed = ~F.col("passed")
    return checks.agg(
        (F.count_if(failed & (F.col("severity") == "critical")) == 0).alias("passed"), F.count("*").alias("total"),
        F.count_if(failed & (F.col("severity") == "critical")).alias("critical_failures"), F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"),
    )


def gate(df: DataFrame, source: str = "default") -> DataFrame:
    """``df`` itself; QualityError if a critical check fails."""
    failed = run_checks(df, source).where("not passed and severity = 'critical'").select("check_name").collect()
    if failed:
        raise QualityError(", ".join(r.check_name for r in failed))
    return df
