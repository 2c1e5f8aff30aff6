"""Conflicts between jurisdictions: rules whose two sides both have a matching latest regulation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import ids


@dataclass(frozen=True)
class Rule:
    """a_any, b_any: LIKE patterns, one of which a text of the jurisdiction must match."""

    topic: str
    jurisdiction_a: str
    a_any: tuple[str, ...]
    jurisdiction_b: str
    b_any: tuple[str, ...]
    severity: str
    summary: str


# Topics, their two sides and severity.
RULES = (
    Rule("Data Cross-Border Transfers", "EU", ("%cross-border%transfer%",), "US", ("%CLOUD Act%", "%subpoena%data%"), "high", "Transfer limits against compelled disclosure"),
    Rule("AI System Regulation", "EU", ("%AI Act%",), "US", ("%artificial intelligence%",), "medium", "Binding risk classes against sector rules"),
    Rule("Right to Erasure", "EU", ("%right to erasure%",), "US", ("%legal hold%",), "medium", "Erasure on request against duties to keep"),
    Rule("Cookie and Tracking Consent", "EU", ("%consent%cookie%",), "US", ("%tracking%",), "low", "Consent in advance against opting out"),
)


def _side(rule: Rule, side: str) -> Column:
    place, patterns = (rule.jurisdiction_a, rule.a_any) if side == "a" else (rule.jurisdiction_b, rule.b_any)
    cond = F.lit(False)
    for p in patterns:
        cond = cond | F.col("raw_text").ilike(p)
    return (F.col("jurisdiction") == place) & cond


def detect_conflicts(latest: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per rule with both sides: signal_id, topic, both jurisdictions and their first regulation ids, severity, summary.

    All rules are tested in one scan by conditional minima, whatever their number.
    """
    found = latest.agg(*[F.min(F.when(_side(r, s), F.col("regulation_id"))).alias(f"{s}{i}") for i, r in enumerate(rules) for s in "ab"])
    rows = F.array(*[F.struct(F.lit(r.topic).alias("topic"), F.lit(r.jurisdiction_a).alias("jurisdiction_a"), F.lit(r.jurisdiction_b).alias("jurisdiction_b"), F.col(f"a{i}").alias("regulation_id_a"), F.col(f"b{i}").alias("regulation_id_b"), F.lit(r.severity).alias("severity"), F.lit(r.summary).alias("conflict_summary")) for i, r in enumerate(rules)])
    signals = found.select(F.explode(rows).alias("s")).select("s.*").where("regulation_id_a is not null and regulation_id_b is not null")
    return signals.withColumn("signal_id", ids.signal_id("topic", "jurisdiction_a", "jurisdiction_b"))


def merge_signals(frames: list[DataFrame]) -> DataFrame:
    """Signals of several detectors, the first of each topic and pair."""
    from .dedup import keep_first

    rows = None
    for i, f in enumerate(frames):
        part = f.withColumn("__list", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return keep_first(rows, ["topic", "jurisdiction_a", "jurisdiction_b"], ["__list", "signal_id"]).drop("__list")


# Topics on which every two jurisdictions are compared.
TOPICS = (
    "biometric data collection and processing",
    "algorithmic decision making and automated profiling",
    "government access to private data",
    "data breach notification requirements",
)


def compare_topics(hits: DataFrame, judge, texts: int = 2) -> DataFrame:
    """``hits`` (topic, jurisdiction, rank, regulation_id, text), ranked per topic and jurisdiction -> conflicts that ``judge`` finds.

    Every two jurisdictions of a topic are compared by the first texts of each. ``judge``: a pandas UDF (topic, text_a,
    text_b) -> severity, null where there is no conflict. Rows are as many as topics and pairs of jurisdictions.
    """
    first = F.struct("rank", F.substring("text", 1, 1500).alias("text"), "regulation_id")
    sides = hits.where(F.col("rank") <= texts).groupBy("topic", "jurisdiction").agg(F.array_sort(F.collect_list(first)).alias("s"))
    sides = sides.select("topic", "jurisdiction", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text"), F.element_at("s", 1)["regulation_id"].alias("id"))
    a, b = (sides.select("topic", *[F.col(c).alias(f"{c}_{t}") for c in ("jurisdiction", "text", "id")]) for t in "ab")
    pairs = a.join(b, "topic").where("jurisdiction_a < jurisdiction_b").withColumn("severity", judge("topic", "text_a", "text_b"))
    found = pairs.where("severity is not null").select("topic", "jurisdiction_a", "jurisdiction_b", F.col("id_a").alias("regulation_id_a"), F.col("id_b").alias("regulation_id_b"), "severity")
    return found.withColumn("signal_id", ids.signal_id("topic", "jurisdiction_a", "jurisdiction_b"))


def topic_hits(search, jurisdictions: list[str], topics: DataFrame, k: int = 3) -> DataFrame:
    """For ``compare_topics``: each topic (topic, and what the search needs) asked in each jurisdiction.

    ``search(topics, jurisdiction, k)`` -> topic, rank, regulation_id, text: a retrieval with a filter on the jurisdiction.
    """
    return reduce(DataFrame.unionByName, [search(topics, j, k).select("topic", F.lit(j).alias("jurisdiction"), "rank", "regulation_id", "text") for j in jurisdictions])


def detect_all(latest: DataFrame, hits: DataFrame | None = None, judge=None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rules and, with ``hits`` and a ``judge``, compared topics: the first signal of each topic and pair."""
    found = [detect_conflicts(latest, rules)]
    if hits is not None and judge is not None:
        found.append(compare_topics(hits, judge))
    return merge_signals(found)


def new_signals(stored: DataFrame, signals: DataFrame, detected_at: Column) -> DataFrame:
    """The signals that ``stored`` lacks, as rows of its table: what an append has to add."""
    from statuta import schema

    from .store import unknown

    rows, _ = schema.conform(signals.withColumn("detected_at", detected_at), schema.CONFLICT_SIGNALS)
    return unknown(stored, rows, "signal_id")
