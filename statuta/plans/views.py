"""The warehouse's views and the dashboards' reads, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.operators.carried import Running, carried


def regulations_latest(regs: DataFrame) -> DataFrame:
    """Rows of each regulation's highest version, all of them on a tie; others are dropped before the shuffle."""
    top = F.rank().over(W.partitionBy("regulation_id").orderBy(F.col("version_id").desc()))
    return regs.withColumn("__top", top).where("__top = 1").drop("__top")


def jurisdiction_stats(regs: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """Over all versions: regulations, types, first and last date, amendments by jurisdiction. The dimension joins the few sums."""
    sums = regs.groupBy("jurisdiction").agg(
        F.count_distinct("regulation_id").alias("regulation_count"), F.count_distinct("regulation_type").alias("type_diversity"), F.min("effective_date").alias("earliest_date"),
        F.max("effective_date").alias("latest_date"), F.sum((F.col("version_id") > 1).cast("long")).alias("amendment_count"),
    )
    names = jurisdictions.select(F.col("jurisdiction_code").alias("jurisdiction"), "jurisdiction_name")
    return sums.join(F.broadcast(names), "jurisdiction", "left").orderBy(F.col("regulation_count").desc(), "jurisdiction")


def pipeline_health_recent(health: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    recent = health.where(F.col("run_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy("source").agg(
        F.count("*").alias("total_runs"), F.sum("rows_ingested").alias("total_rows"), F.round(F.avg("null_rate") * 100, 2).alias("avg_null_rate_pct"),
        F.count_if(~F.col("sla_met")).alias("sla_breaches"), F.count_if("schema_drift").alias("drift_events"), F.max("run_at").alias("last_run_at"),
    ).orderBy(F.col("last_run_at").desc())


def amendment_history(regs: DataFrame, hot: bool = False) -> DataFrame:
    """Versions of regulations that have several, each with the hash before it; one shuffle serves count and lag.

    ``hot``: one regulation may hold a large part of the rows; they are then cut into ranges instead of one task's window.
    """
    if hot:
        rows = carried(regs, ["regulation_id"], ["version_id"], {"prev_hash": Running("prior", "source_hash")})
        several = regs.groupBy("regulation_id").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
        rows = rows.join(several, "regulation_id", "left_semi")
    else:
        by = W.partitionBy("regulation_id")
        rows = regs.withColumns({"__n": F.count("*").over(by), "prev_hash": F.lag("source_hash").over(by.orderBy("version_id"))}).where("__n > 1")
    return rows.select("regulation_id", "title", "jurisdiction", "version_id", "effective_date", "prev_hash", F.col("source_hash").alias("current_hash"))


def total_counts(regs: DataFrame, chunks: DataFrame, conflicts: DataFrame, health: DataFrame) -> DataFrame:
    one = regs.agg(F.count_distinct("regulation_id").alias("regulations"), F.count_distinct("jurisdiction").alias("jurisdictions"))
    for df, name in ((chunks, "chunks"), (conflicts, "conflicts"), (health, "runs")):
        one = one.crossJoin(df.agg(F.count("*").alias(name)))
    return one


def browse(regs: DataFrame, jurisdiction: str | list[str] | None = None, regulation_type: str | list[str] | None = None, limit: int = 100, latest_only: bool = True) -> DataFrame:
    """Newest first; filters, a value or a list of them, reach the scan."""
    rows = regs
    for column, value in (("jurisdiction", jurisdiction), ("regulation_type", regulation_type)):
        if value is not None:
            rows = rows.where(F.col(column).isin(value))
    return (regulations_latest(rows) if latest_only else rows).orderBy(F.col("effective_date").desc_nulls_last(), "regulation_id", "version_id").limit(limit)


def top_values(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(k)


def sizes(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows by key, rows with a null key left out."""
    rows = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return rows.na.drop(subset=[c for c in rows.columns if c != "n"])


def newest(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order).desc_nulls_last(), tie).limit(n)


def health_log(health: DataFrame, newest_runs: int = 200) -> DataFrame:
    """The newest runs as the health page shows them."""
    label = lambda c: F.when(F.col(c), "yes").otherwise("no")
    return newest(health, "run_at", "run_id", newest_runs).select("run_id", "source", "run_at", label("sla_met").alias("sla"), label("schema_drift").alias("drift"), F.format_string("%.1f%%", F.col("null_rate") * 100).alias("null_rate"))


def oldest_of_newest(health: DataFrame, newest_runs: int = 200, n: int = 100) -> DataFrame:
    """The oldest n of the newest runs, as the chart of past runs shows them."""
    return newest(health, "run_at", "run_id", newest_runs).orderBy(F.col("run_at").asc_nulls_first(), F.col("run_id").desc()).limit(n)


def by_severity(signals: DataFrame, n: int = 50, ranked: bool = False) -> DataFrame:
    """The first n conflict signals: by the severity's name, descending (medium, low, high), or ``ranked`` from high to low."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    return signals.orderBy(rank if ranked else F.col("severity").desc_nulls_last(), "signal_id").limit(n)


def scorecard(health: DataFrame, newest_runs: int = 200) -> DataFrame:
    """Totals over the newest runs."""
    return newest(health, "run_at", "run_id", newest_runs).agg(F.count("*").alias("runs"), F.coalesce(F.sum("rows_ingested"), F.lit(0)).alias("total_rows"), F.count_if("sla_met").alias("sla_met"), F.count_if("schema_drift").alias("drifted"))


def last_turns(turns: DataFrame, group: str, order: str, n: int = 5) -> DataFrame:
    """The last n rows of each group, newest first (place 1)."""
    rows = turns.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.col(order).desc())))
    return rows.where(F.col("place") <= n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: a map of the column's values, nulls left out, to their numbers of rows. For columns of few values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("counts"))
