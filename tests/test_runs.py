import json
from pathlib import Path

from pyspark.sql import functions as F

from statuta.operators import dedup, store
from statuta.sources import readers, records
from statuta.streaming import landing

AT = "2024-06-01 00:00:00"


def at():
    return F.lit(AT).cast("timestamp")


def feed(*items):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title>{f'<link>{u}</link>' if u else ''}<description>{d}</description></item>" for t, u, d in items) + "</channel></rss>"


def test_feed_addresses_count_once(spark):
    """Feeds in their order; an address that comes again goes, also one that is missing; the limit is taken after that."""
    first = feed(("Annual report", "https://f/0", "x"), ("Settlement one", "https://f/1", "a"), ("Settlement two", "https://f/1", "b"), ("Complaint", None, "c"))
    second = feed(("Settlement one again", "https://f/1", "z"), ("Injunction", "https://f/2", ""), ("Charges", None, "late"), ("Violation", "https://f/3", ""))
    payloads = spark.createDataFrame([(1, first), (2, second)], "n int, payload string")
    titles = lambda **more: [r.title for r in records.ftc(payloads, at(), feed="n", **more).collect()]
    assert sorted(titles()) == ["Complaint", "Injunction", "Settlement one", "Violation"]
    assert sorted(titles(limit=2)) == ["Complaint", "Settlement one"] and titles(limit=0) == []


def test_errors_reach_the_health_row(spark):
    asked = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string")

    def get(url):
        if url != "u1":
            raise OSError("refused" if url == "u2" else "away")
        return "x"

    fetched = readers.fetch(asked, get)
    rows = spark.createDataFrame([("t", "US", "x", None, "body", "h")], "title string, jurisdiction string, regulation_type string, effective_date string, raw_text string, source_hash string")
    row = records.run_metrics(rows, "s", 0.0, 10.0, errors=["parse"], fetched=fetched).first()
    assert json.loads(row.errors) == ["parse", "away", "refused"] and row.sla_met and row.rows_ingested == 1 and abs(row.null_rate - 0.2) < 1e-9
    _, lost = readers.ingest({"good": lambda n: rows, "bad": lambda n: 1 / 0}, 5, ["good", "bad", "none"])
    failed = [r.first() for r in records.failed_runs(spark, lost, 0.0, 1.0)]
    assert [(r.source, r.sla_met, r.rows_ingested) for r in failed] == [("bad", False, 0), ("none", False, 0)]
    assert json.loads(failed[0].errors) == ["division by zero"] and json.loads(failed[1].errors) == ["unknown source"]


def test_report_comes_from_the_writes(spark):
    schema = "regulation_id string, version_id int, source_hash string, title string, source_name string, seq int"
    old = spark.createDataFrame([("a", 1, "h0", "the first of all titles", "s1", 0)], schema)
    new = spark.createDataFrame([("a", 1, "h1", "one", "s1", 1), ("b", 1, "h0", "two", "s1", 2), ("c", 1, "h2", "the first of all title", "s2", 3), ("d", 1, "h3", "four", "s1", 4), ("d", 1, "h3", "four", "s1", 5)], schema)
    rows, report = dedup.deduplicate_written(new, old, "seq")
    lazy, row = dedup.deduplicate(new, old, "seq")
    assert report == row.first().asDict() == {"input_rows": 5, "exact_dropped": 2, "amendments": 1, "similar_dropped": 1, "output_rows": 2}
    assert sorted(map(str, rows.collect())) == sorted(map(str, lazy.collect()))


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_untouched_buckets_stay(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "id int, v string, bucket int"
    store.append_buckets(spark.createDataFrame([(i, "old") for i in range(200)], "id int, v string"), path, "id", 16)
    before = files(path)
    new = spark.createDataFrame([(7, "new"), (7, "newer"), (900, "added")], "id int, v string")
    touched = store.merge_buckets(spark.read.schema(kind).parquet(path), new, path, "id", lambda o, n: store.upsert(o, n, ["id"], ["v"], ["v"]), 16)
    after = files(path)
    of = {r.bucket for r in store.with_bucket(new, "id", 16).collect()}
    same = {p for p in before if after.get(p) == before[p]}
    assert touched == len(of) and {p for p in before if int(p.parts[0].split("=")[1]) not in of} == same
    rows = {r.id: r.v for r in spark.read.schema(kind).parquet(path).collect()}
    assert len(rows) == 201 and rows[7] == "newer" and rows[900] == "added" and rows[8] == "old"
    assert store.merge_buckets(spark.read.schema(kind).parquet(path), new.limit(0), path, "id", lambda o, n: o, 16) == 0 and files(path) == after


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "source string, run_at timestamp, rows_ingested long, sla_met boolean"
    states = []

    def step(*rows):
        spark.createDataFrame([(s, t, n, True) for s, t, n in rows], "source string, t string, rows_ingested long, sla_met boolean").select("source", F.col("t").cast("timestamp").alias("run_at"), "rows_ingested", "sla_met").write.mode("append").parquet(source)
        q = landing.start(landing.health_windows(landing.landed_stream(spark, source, spark.createDataFrame([], kind).schema)), lambda b, _: b.write.mode("append").parquet(f"{out}/rows"), f"{out}/state")
        q.awaitTermination()
        states.append(q.lastProgress.stateOperators[0].numRowsTotal)

    step(("s", "2024-01-01 00:05:00", 1), ("s", "2024-01-01 00:50:00", 2), ("s", "2024-01-01 01:01:00", 4))
    step(("s", "2024-01-01 03:00:00", 8))
    step(("s", "2024-01-01 00:10:00", 100), ("s", "2024-01-01 05:00:00", 16))
    step(("s", "2024-01-01 09:00:00", 32))
    got = sorted((str(r.window.start)[11:16], r.runs, r.total_rows) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [("00:00", 2, 3), ("01:00", 1, 4), ("03:00", 1, 8), ("05:00", 1, 16)] and max(states) <= 2


def test_versions_of_a_stream(spark, tmp_path):
    """Batches in turn and a restart between them: numbers go on, equal neighbours make no version."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "regulation_id string, seq long, source_hash string"
    for batch in ([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y"), (None, 1, "z")], [("a", 4, "x"), ("a", 3, "w"), ("c", 1, None)], [("b", 2, "y"), ("b", 3, "q"), ("c", 2, "k")]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        rows = landing.Versions(landing.landed_stream(spark, source, spark.createDataFrame([], kind).schema)).rows()
        landing.start(rows, lambda b, _: b.write.mode("append").parquet(f"{out}/rows"), f"{out}/state").awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(f"{out}/rows").collect()), key=str)
    assert got == sorted([("a", 1, "x", 1, None), ("b", 1, "y", 1, None), ("a", 3, "w", 2, "x"), ("a", 4, "x", 3, "w"), ("c", 1, None, 1, None), ("b", 3, "q", 2, "y"), ("c", 2, "k", 2, None)], key=str)
