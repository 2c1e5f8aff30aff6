import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta import schema
from statuta.functions import tagging, text
from statuta.operators import answers, chunking, conflicts, dedup, retrieval, store
from statuta.plans import pipeline
from statuta.scratch import materialize, scratch_dir, tidy
from statuta.sources import pdf, readers, records


def one(spark, t, column):
    return spark.createDataFrame([(t,)], "t string").select(column(F.col("t")).alias("x")).first().x


# ranking


def test_near_ties_are_ranked_before_rounding(spark):
    v = spark.createDataFrame([(1, [1.0, 0.009]), (2, [1.0, 0.0001]), (3, [0.0, 0.0]), (4, None)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    got = retrieval.dense(v, q, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(2, 1.0), (1, 1.0), (3, 0.0)]


def test_fusion_far_down_the_lists(spark):
    """Ranks 900 and 901 differ in the seventh digit."""
    a = spark.createDataFrame([(1, "z", 900), (1, "a", 901)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "z", 901), (1, "a", 900)], "query_id int, chunk_id string, rank int")
    got = retrieval.fuse([("dense", 0.6, a), ("sparse", 0.4, b)], 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["z", "a"] and got[0].score == got[1].score


def test_retrieve_filters_both_legs(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"data rule w{i} {'privacy ' * (i % 4 == 3)}") for i in range(40)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)], "EU" if i % 2 else "US") for i in range(40)], "chunk_id long, embedding array<double>, jurisdiction string")
    asked = spark.createDataFrame([(1, "privacy", [1.0, 3.0]), (2, "absent", [1.0, 0.0]), (3, "privacy", None)], "query_id long, text string, vector array<double>")
    index = retrieval.build_bm25(docs, str(tmp_path / "index"))
    assert (index.n, round(index.avgdl, 6)) == (40, 3.25) and retrieval.read_bm25(spark, str(tmp_path / "index")).n == 40
    got = retrieval.retrieve(index, vectors, asked, 4, F.col("jurisdiction") == "EU").collect()
    assert {r.query_id for r in got} == {1, 2, 3} and all(r.chunk_id % 2 for r in got) and max(r["rank"] for r in got) == 4
    # statistics stay those of the whole index
    allowed = retrieval.search_bm25(index, asked, 40, vectors.where("jurisdiction = 'EU'").select(F.col("chunk_id").alias("doc_id"))).collect()
    whole = {(r.query_id, r.doc_id): r.score for r in retrieval.search_bm25(index, asked, 40).collect()}
    assert allowed and all(abs(whole[r.query_id, r.doc_id] - r.score) < 1e-12 for r in allowed)

    @F.pandas_udf(T.DoubleType())
    def model(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([float(len(x)) if "privacy" in x else None for x in t])

    ranked = retrieval.retrieve(index, vectors, asked, 3, None, docs.withColumnRenamed("doc_id", "chunk_id"), model).where("query_id = 1").orderBy("rank").collect()
    assert [r.chunk_id % 4 for r in ranked] == [3, 3, 3]


# writes


def test_keys_stay_unique(spark, tmp_path):
    old = spark.createDataFrame([(1, "a")], "id int, title string")
    new = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d"), (2, "e"), (None, "f")], "id int, title string")
    assert sorted(map(tuple, store.upsert(old, new, ["id"], ["title"]).collect())) == [(1, "c"), (2, "e")]
    assert sorted(map(tuple, store.insert_ignore(old, new, "id").collect())) == [(1, "a"), (2, "d")]
    assert store.delete_counted(old.union(new), {"id": 1})[1] == 3


def test_versions_of_an_unknown_regulation(spark):
    new = spark.createDataFrame([("a", 1, f"h{i}", f"title {i} {'xyz' * i}", "s", i) for i in range(3)], "regulation_id string, version_id int, source_hash string, title string, source_name string, seq int")
    got, report = dedup.deduplicate(new.union(new), new.limit(0), "seq")
    assert sorted(r.version_id for r in got.collect()) == [1, 2, 3]
    assert report.first().asDict() == {"input_rows": 6, "exact_dropped": 3, "amendments": 0, "similar_dropped": 0, "output_rows": 3}


def test_pipeline_with_blocks_vectors_and_health(spark, tmp_path):
    rows = [(f"r{i}", 1, f"{i:032x}", f"A title that is number {i} {'q' * i}", "EU", "Regulation", "2024-01-01", f"https://e.org/{i}", f"Text of the rule number {i}.", "2024-01-01T00:00:00", "s1", i) for i in range(5)]
    kinds = "regulation_id string, version_id int, source_hash string, title string, jurisdiction string, regulation_type string, effective_date string, source_url string, raw_text string, ingested_at string, source_name string, doc_id long"
    landed = spark.createDataFrame(rows, kinds)
    blocks = spark.createDataFrame([("r1", 0, "Intro", 1, "body", None, None, None), ("r1", 1, "Article 1 text", 1, "article", "article_1", None, None)], "regulation_id string, block_idx int, text string, page_number int, block_type string, article_ref string, section_ref string, chapter_ref string")
    at = str(tmp_path / "w")

    def model(texts):
        if any("number 3" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t))] for t in texts]

    got = pipeline.run(spark, [landed], at, blocks=blocks, model=lambda ts: model(ts))
    assert (got["new"], got["chunks"], got["output_rows"]) == (5, 6, 5)
    chunks = {(r.regulation_id, r.chunk_index): r for r in spark.read.parquet(f"{at}/chunks").collect()}
    assert chunks["r1", 1].article_ref == "article_1" and chunks["r1", 1].jurisdiction == "EU" and chunks["r0", 0].block_type == "body"
    assert spark.read.parquet(f"{at}/pipeline_health").count() == 1
    # a near-equal title of another source, and an amendment
    more = [("n1", 1, "e" * 32, "a title that is NUMBER 2 qq".replace("a t", "A t").replace("NUMBER", "number"), *rows[0][4:10], "s2", 9), ("r0", 1, "f" * 32, "another thing", *rows[0][4:8], "Amended text of the rule.", *rows[0][9:11], 10)]
    again = pipeline.run(spark, [spark.createDataFrame(more, kinds)], at)
    assert (again["similar_dropped"], again["amendments"], again["regulations"]) == (1, 1, 6)
    stored = spark.read.parquet(f"{at}/regulations")
    assert stored.groupBy("regulation_id", "version_id").count().where("count > 1").count() == 0 and stored.where("regulation_id = 'r0'").agg(F.max("version_id")).first()[0] == 2


def test_tidy_removes_what_is_not_needed(spark, tmp_path):
    made = []

    @tidy
    def build(df):
        a = materialize(df)
        made.append(a.inputFiles()[0])
        return a.withColumn("y", F.lit(1))

    got = build(spark.range(5))
    import os

    assert got.count() == 5 and not os.path.exists(made[0].removeprefix("file:"))
    assert scratch_dir(spark) != scratch_dir(spark)


# texts


def test_types_and_amounts(spark):
    of = lambda t: one(spark, t, tagging.tags)["type"] or "Legal Document"
    assert [of(t) for t in ("Overruling was noted.", "$1,200 million", "£1,2 due", "A RULING", "éruling", "Directive 2016/6", "Regulation (EU) x")] == ["Legal Document", "Monetary Penalty", "Monetary Penalty", "Decision", "Legal Document", "Directive", "Regulation"]
    assert [one(spark, t, text.first_pounds) for t in ("£1.5 million", "£2 a million", "£2 or rather one million", "£, none", "£7m", "x")] == [1.5e6, 2e6, 2.0, None, 7.0, None]
    assert one(spark, "Article 5a UK GDPR, article 5(1)  GDPR and Article 9 of the GDPR", lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(records.ARTICLE), F.lit(1)))) == ["Article 5a UK GDPR", "article 5(1)  GDPR", "Article 9"]


def test_named_entities(spark):
    @F.pandas_udf("array<struct<text:string,label:string,start:int,end:int>>")
    def model(t: pd.Series) -> pd.Series:
        return pd.Series([[{"text": x[:3], "label": "ORG", "start": 0, "end": 3}, {"text": "5", "label": "CARDINAL", "start": len(x), "end": len(x)}] for x in t])

    assert [r.label for r in one(spark, "abc", lambda c: tagging.named_entities(c, model))] == ["ORG"]
    assert one(spark, "abc", tagging.named_entities) == []


def test_citations(spark):
    df = spark.createDataFrame([(1, 2, "T", "Article 5", "EU", "2024-01-01", "u"), (1, 1, "S", None, "US", None, "v")], "answer int, i int, title string, article_ref string, jurisdiction string, effective_date string, source_url string")
    assert answers.format_citations(df, "answer", "i").first()["references"] == "[1] S | US | v\n[2] T — Article 5 | EU (2024-01-01) | u"


# sources


def test_pages_stop_at_the_first_empty_one(spark):
    pages = readers.page_requests(spark, "https://x/?offset={offset}&limit={size}", 100, 20)

    def get(url):
        if "offset=60" in url:
            raise OSError("gone")
        return '{"bills": []}' if "offset=40" in url else '{"bills": [1]}'

    got = readers.fetch_pages(pages, get, lambda p: bool(json.loads(p)["bills"])).orderBy("offset").collect()
    assert [r.offset for r in got] == [0, 20, 40]
    failed = readers.fetch(pages, get).where("error is not null").collect()
    assert [(r.offset, r.payload, r.error) for r in failed] == [(60, None, "gone")]


def test_agencies_and_sources(spark):
    urls = [r.url for r in readers.agency_requests(spark, "https://x/{agency}?size={size}", 100, records.AGENCIES).collect()]
    assert len(urls) == 8 and all("size=12" in u for u in urls)

    def broken(limit):
        raise OSError("down")

    frames, lost = readers.ingest({"a": lambda n: spark.range(n), "b": broken}, 3, ["a", "b", "c"])
    assert [f.count() for f in frames] == [3] and lost == {"b": "down", "c": "unknown source"}
    with pytest.raises(ValueError):
        readers.ingest({"b": broken}, 3)


def test_enrich_and_fallback(spark):
    rows = spark.createDataFrame([("https://a", "old", "h1"), ("https://b", "old", "h2"), (None, "old", "h3")], "source_url string, raw_text string, source_hash string")

    def get(url):
        if url.endswith("b"):
            raise OSError("no")
        return "<p>" + "new  text " * 3000

    got = readers.enrich(rows, get).orderBy("source_hash").collect()
    assert {len(r.raw_text) for r in got} == {10_000, 3} and sorted(r.source_hash for r in got)[1:] == ["h2", "h3"]
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([("<rss><channel></channel></rss>",)], "payload string")
    page = spark.createDataFrame([('<a href="/action-weve-taken/enforcement/x">Big case</a><a href="/action-weve-taken/enforcement/y">Next case</a>',)], "payload string")
    assert [r.title for r in records.ico_with_fallback(empty, page, at, 1).collect()] == ["Big case"]
    assert "LIMIT+7" in records.sparql_request(spark, "https://s", "2024-01-01", 7).first().url
    health = records.run_metrics(rows.withColumns({c: F.lit("x") for c in ("title", "jurisdiction", "regulation_type", "effective_date")}), "s", 100.0, 500.0, errors=["e"]).first()
    assert (health.sla_met, health.elapsed_seconds, health.errors, health.rows_ingested) == (False, 400.0, '["e"]', 3)


def test_pdf_by_url(spark):
    asked = spark.createDataFrame([("u1",), ("u2",)], "url string")

    def get(url):
        if url == "u2":
            raise OSError("gone")
        return b"one\fTwo"

    got = pdf.read_urls(asked, get, [("plain", lambda d: bytes(d).decode().split("\f"))]).orderBy("path", "page_number").collect()
    assert [(r.path, r.method, r.text) for r in got] == [("u1", "plain", "one"), ("u1", "plain", "Two"), ("u2", "none", None)]


def test_health_and_signals_are_inserted_once(spark):
    stored, _ = schema.conform(spark.createDataFrame([("1", "a")], "run_id string, source string"), schema.PIPELINE_HEALTH)
    got = readers.new_health(stored, spark.createDataFrame([("1", "x"), ("2", "b"), ("2", "b")], "run_id string, source string")).collect()
    assert [(r.run_id, r.rows_ingested, r.sla_met, r.errors) for r in got] == [("2", 0, True, "[]")] and got[0].run_at is not None
    latest = spark.createDataFrame([("r1", "EU", "AI Act"), ("r3", "US", "Artificial Intelligence")], "regulation_id string, jurisdiction string, raw_text string")
    found = conflicts.detect_all(latest)
    none, _ = schema.conform(found.limit(0), schema.CONFLICT_SIGNALS)
    first = conflicts.new_signals(none, found, F.current_timestamp())
    assert first.count() == 1 and conflicts.new_signals(first, found, F.current_timestamp()).count() == 0


def test_chunks_by_blocks_or_windows(spark):
    docs = spark.createDataFrame([("a", "x" * 10, 1), ("b", "y" * 3000, 2), ("b", "z" * 10, 3)], "id string, t string, v int")
    blocks = spark.createDataFrame([("a", 0, "One", 1, "body", None, None, None), ("b", 0, " ", 1, "body", None, None, None), ("c", 0, "Else", 1, "body", None, None, None)], "id string, block_idx int, text string, page_number int, block_type string, article_ref string, section_ref string, chapter_ref string")
    got = chunking.chunk_documents(docs, "id", "t", blocks).collect()
    assert sorted((r.id, r.v, r.chunk_index, r.total_chunks, r.block_type) for r in got) == [("a", 1, 0, 1, "body"), ("b", 2, 0, 2, None), ("b", 2, 1, 2, None), ("b", 3, 0, 1, None)]
