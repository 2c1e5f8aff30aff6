import datetime
import json

import pytest
from oracle import differences
from pyspark.sql import functions as F

from statuta import schema
from statuta.functions import ids, tagging, text
from statuta.operators import answers, chunking, conflicts, dedup, quality, retrieval, rewrite, store, structure
from statuta.plans import corpus, pipeline, queries, views
from statuta.sources import readers, records
from statuta.streaming import landing

def at():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_against_sql(spark, data, name):
    df, sql = queries.queries()[name](spark, data), queries.oracle_sql().get(name)
    assert (differences(df, sql, data) if sql else "") == "" and df.count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# chunks


@pytest.mark.parametrize("size,count", [(0, 0), (1, 1), (1752, 1), (1753, 2), (1945, 2), (1946, 2), (5000, 3)])
def test_chunk_counts_without_breaks(spark, size, count):
    rows = chunking.chunk_text(spark.createDataFrame([("r", "x" * size)], "id string, t string"), "id", "t").collect()
    assert len(rows) == count and all(r.total_chunks == count for r in rows)


def test_chunks_prefer_breaks_and_overlap(spark):
    one = "a" * 1000 + "\n\n" + "b" * 2000
    two = "c" * 1200 + ". " + "d" * 2000
    early = "e" * 800 + "\n\n" + "f" * 3000
    got = chunking.chunk_text(spark.createDataFrame([("1", one), ("2", two), ("3", early), ("4", "  \n "), ("5", None)], "id string, t string"), "id", "t").orderBy("id", "chunk_index").collect()
    first = {r.id: r.chunk_text for r in got if r.chunk_index == 0}
    assert first["1"] == "a" * 1000 and first["2"] == "c" * 1200 + "." and len(first["3"]) == 1945 and "4" not in first and "5" not in first
    assert len({r.chunk_id for r in got}) == len(got)
    words = chunking.chunk_text(spark.createDataFrame([("w", " ".join(f"token{i}" for i in range(200)))], "id string, t string"), "id", "t", 20, 5).orderBy("chunk_index").collect()
    assert all(set(a.chunk_text.split()) & set(b.chunk_text.split()) for a, b in zip(words, words[1:]))
    with pytest.raises(ValueError):
        chunking.sizes(30, 15)


def test_block_chunks(spark):
    rows = [("d", 0, "Intro", 1, "body", None), ("d", 1, "Article 1 " + "x" * 50, 1, "article", "article_1"), ("d", 2, " ", 1, "body", "article_1"), ("d", 3, "y" * 60, 2, "body", "article_1"), ("d", 4, "Article 2", 2, "article", "article_2")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "id string, block_idx int, text string, page_number int, block_type string, article_ref string, section_ref string, chapter_ref string")
    got = chunking.chunk_blocks(df, "id", 30, 3).orderBy("chunk_index").collect()
    assert [r.chunk_text for r in got] == ["Intro", "Intro" + "Article 1 " + "x" * 50, "x" * 11 + "y" * 60, "y" * 11 + "Article 2"]
    assert [(r.article_ref, r.page_number) for r in got] == [(None, 1), ("article_1", 1), ("article_1", 2), ("article_2", 2)]


def test_structure(spark):
    pages = spark.createDataFrame([("d", 1, "Chapter IV\nScope\n\nArticle 5a\nText\n\n  \n\nSection 3.2\nmore"), ("d", 2, "plain\n\nArticle 6 next\n\n(7) recital\n\nCHAPTER 2")], "id string, page_number int, text string")
    got = structure.with_context(structure.classify(structure.paragraphs(pages, "id")), "id").orderBy("block_idx").collect()
    assert [(r.block_type, r.block_id) for r in got] == [("chapter", "chapter_IV"), ("article", "article_5a"), ("section", "section_3_2"), ("body", "body_3"), ("article", "article_6"), ("recital", "recital_7"), ("chapter", "chapter_2")]
    assert [(r.chapter_ref, r.article_ref, r.section_ref) for r in got][3:] == [("chapter_IV", "article_5a", "section_3_2"), ("chapter_IV", "article_6", None), ("chapter_IV", "article_6", None), ("chapter_2", None, None)]


# texts


def test_extractors(spark):
    def one(t, column):
        return spark.createDataFrame([(t,)], "t string").select(column(F.col("t")).alias("x")).first().x

    assert one("Fined £200,000 may, $1.5 million or EUR 2bn and £, x", text.amounts) == [200000.0, 1.5e6, 2e9]
    assert one("on 15 March 2024, March 5, 2023 and 2024-01-02; 03/15/2024 99 March 2024 2024-01-02", text.dates) == ["2024-01-02", "2024-03-15", "99 March 2024", "2023-03-05", "03/15/2024"]
    assert one("Article 5 GDPR and Article 25(1) of the UK GDPR, Article 5 GDPR", text.citations) == ["Article 5 GDPR", "Article 25(1) of the UK GDPR"]
    assert one("Café été x_1!", text.tokens) == ["café", "été", "x_1"]
    assert one("Tue, 15 Mar 2024 10:00:00 GMT", text.feed_date) == "2024-03-15" and one("2024-05-06T1", text.feed_date) == "2024-05-06" and one("", text.feed_date) is None
    assert one("£1.5 million fine", text.first_pounds) == 1.5e6 and one("none", text.first_pounds) is None
    assert one("<p>a <b>b</b>\n c</p>", text.strip_html) == "a b c"


def test_tags(spark):
    rows = [("The EU and GDPR, FTC", None, None, None), ("no words here", "DE", "Notice", "2020-02-02"), ("UK ICO complaint of 1 May 2021", "", "", "")]
    got = tagging.tag_regulations(spark.createDataFrame(rows, "raw_text string, jurisdiction string, regulation_type string, effective_date string")).collect()
    assert [(r.jurisdiction, r.regulation_type, str(r.effective_date)) for r in got] == [("EU", "Legal Document", "None"), ("DE", "Notice", "2020-02-02"), ("UK", "Enforcement Action", "2021-05-01")]


# sources


def test_parsers(spark):
    sparql = json.dumps({"results": {"bindings": [{"celex": {"value": "32024R0001"}, "title": {"value": "A Regulation"}, "date": {"value": "2024-03-15T00"}, "type": {"value": "Regulation"}}, {"celex": {"value": "32024X"}}]}})
    bills = json.dumps({"bills": [{"type": "hr", "number": "4521", "congress": 118, "title": "Act", "policyArea": {"name": "Privacy"}, "latestAction": {"actionDate": "2023-07-26"}}]})
    rules = json.dumps({"data": [{"id": "FCC-2024-001", "attributes": {"title": "T", "documentType": "Proposed Rule", "postedDate": "2024-02-01T00:00:00Z", "docketId": "D", "agencyId": "FCC"}}]})
    rss = "<rss><channel><item><title>FTC settlement on merger antitrust</title><link>https://f/1</link><pubDate>Fri, 15 Mar 2024 10:00:00 GMT</pubDate><description>d</description></item><item><title>Annual report</title><link>https://f/2</link></item></channel></rss>"
    of = lambda p: spark.createDataFrame([(p,)], "payload string")
    e = records.eurlex(of(sparql), at()).orderBy("title").collect()
    assert [(r.title, r.regulation_type, r.effective_date) for r in e] == [("A Regulation", "Regulation", "2024-03-15"), ("EUR-Lex 32024X", "Legal Act", None)]
    c = records.congress(of(bills), at()).first()
    assert (c.regulation_type, c.effective_date, c.jurisdiction) == ("House Bill", "2023-07-26", "US") and len(c.regulation_id) == 32
    r = records.regulations_gov(of(rules), at()).first()
    assert (r.regulation_type, r.effective_date, r.agency_id) == ("Proposed Rulemaking", "2024-02-01", "FCC")
    f = records.ftc(of(rss), at()).collect()
    assert [(x.regulation_type, x.effective_date) for x in f] == [("Merger Review", "2024-03-15")]
    i = records.ico(of(rss.replace("FTC settlement", "Monetary penalty £200,000 Article 5")), at()).orderBy("source_url").first()
    assert (i.regulation_type, i.fine_amount_gbp, i.gdpr_articles) == ("Monetary Penalty Notice", 200000.0, "Article 5")
    page = '<a href="/action-weve-taken/enforcement/x">Big   <b>case</b></a><a href="/other">Other link</a><a class="c" href="/action-weve-taken/enforcement/y">ab</a>'
    assert [x.title for x in records.ico_html(of(page), at(), 5).collect()] == ["Big case"]
    assert records.health_row(records.ftc(of(rss), at()), "ftc").first().rows_ingested == 1


def test_fetch_and_health_log(spark, tmp_path):
    pages = readers.page_requests(spark, "https://x/?offset={offset}&limit={size}", 45, 20)
    got = readers.fetch(pages, lambda u: None if "=40" in u else u.upper()).orderBy("offset").collect()
    assert [r.payload for r in got] == ["HTTPS://X/?OFFSET=0&LIMIT=20", "HTTPS://X/?OFFSET=20&LIMIT=20", None]
    path = tmp_path / "health"
    path.mkdir()
    (path / "a.json").write_text('{"run_id": "1", "source": "a", "run_at": "2024-01-01T00:00:00Z"}\nbroken\n{"run_id": "2", "source": "a", "run_at": "2024-01-02T00:00:00Z"}\n')
    assert [r.run_id for r in readers.last_runs(readers.read_health(spark, str(path))).collect()] == ["2"]
    assert readers.query(spark, "SELECT :x + 1 AS y", {"x": 2}).first().y == 3


# quality


def regs(spark, n=6, **change):
    rows = [{"regulation_id": f"reg_{i:031d}", "version_id": 1, "source_hash": f"{i:032x}", "title": f"T {i}", "jurisdiction": "EU", "regulation_type": "Regulation", "effective_date": "2024-01-01", "source_url": f"https://e.org/{i}", "raw_text": "long enough text " * 3, "ingested_at": "2024-01-01T00:00:00", "source_name": "s"} | {k: v for k, v in change.items()} for i in range(n)]
    kinds = ", ".join(f"{k} {'int' if k == 'version_id' else 'string'}" for k in (rows[0] if rows else ["regulation_id"]))
    return spark.createDataFrame([tuple(r.values()) for r in rows], kinds)


def test_quality(spark):
    failed = lambda df, source="eurlex": {r.check_name: r.severity for r in quality.run_checks(df, source).where("not passed").collect()}
    assert failed(regs(spark)) == {}
    assert failed(regs(spark).limit(0)) == {"not_empty": "critical", "minimum_row_count": "warning"}
    assert failed(regs(spark).drop("source_hash")) == {"schema_completeness": "critical", "hash_format": "critical"}
    assert failed(regs(spark, regulation_id=None)) == {"null_rate_regulation_id": "critical"}
    bad = regs(spark, 2, source_hash="a" * 32, jurisdiction="XX", source_url="ftp:/x", effective_date="March 15", raw_text="short", regulation_type="?")
    assert failed(bad) == {"duplicate_source_hash": "warning", "valid_jurisdictions": "warning", "valid_regulation_types": "info", "url_format": "warning", "effective_date_format": "warning", "minimum_row_count": "warning", "raw_text_min_length": "warning"}
    assert quality.summarize(quality.run_checks(bad)).first().passed and not quality.summarize(quality.run_checks(regs(spark, source_hash="zz"))).first().passed
    with pytest.raises(quality.QualityError):
        quality.gate(regs(spark, regulation_id=None))


def test_conform(spark):
    df, drift = schema.conform(spark.createDataFrame([("r", "x", "2024-13-01")], "regulation_id string, version_id string, effective_date string"), schema.REGULATIONS)
    row = df.first()
    assert drift and df.schema == schema.REGULATIONS and row.version_id is None and row.effective_date is None


# versions and writes


def test_amendments_and_first(spark):
    new = spark.createDataFrame([("a", None, "h1", 1), ("a", None, "h2", 2), ("a", None, "h3", 3), ("b", None, "x", 4)], "regulation_id string, version_id int, source_hash string, seq int")
    old = spark.createDataFrame([("a", 1, "h0"), ("a", 2, "h1")], "regulation_id string, version_id int, source_hash string")
    got = {(r.regulation_id, r.source_hash): (r.status, r.version_id, r.old_hash) for r in dedup.amendments(new, old, "seq").collect()}
    assert got == {("a", "h2"): ("amended", 3, "h1"), ("a", "h3"): ("amended", 4, "h1"), ("b", "x"): ("new", 1, None)}
    nulls = spark.createDataFrame([(None, 2), (None, 1), ("k", 3)], "k string, seq int")
    assert sorted(r.seq for r in dedup.keep_first(nulls, "k", "seq").collect()) == [1, 3]


def test_similar_titles(spark):
    import random

    rng = random.Random(2)
    base = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    near = []
    for t in base:
        s = list(t)
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice("abcdef ")
        near.append("".join(s))
    of = lambda xs: spark.createDataFrame([(x,) for x in xs], "s string")

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above, row = row, [0]
            for j, y in enumerate(b):
                row.append(above[j] + 1 if x == y else max(row[-1], above[j + 1]))
        return row[-1]

    want = {(a, b) for a in near for b in base if (a or b) and 2 * lcs(a, b) / (len(a) + len(b)) >= 0.92}
    got = {(r.a, r.b) for r in dedup.similar_strings(of(near), of(base)).collect()}
    assert got == want and len(want) > 10
    new = spark.createDataFrame([(1, "s1", "r1", "data act of the union"), (2, "s1", "r9", "data act of the union"), (3, "s2", "r1", "something else here")], "id int, source_name string, regulation_id string, title string")
    old = spark.createDataFrame([("s2", "r9", "union the of act data")], "source_name string, regulation_id string, title string")
    assert sorted(r.id for r in dedup.drop_similar(new, old).collect()) == [2, 3]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a", "k"), (2, 1, "b", "k")], "id int, v int, title string, keep string")
    new = spark.createDataFrame([(1, 1, None, "n"), (3, 1, "c", "n")], "id int, v int, title string, keep string")
    got = store.upsert(old, new, ["id", "v"], ["title"])
    assert sorted(map(tuple, got.collect())) == [(1, 1, None, "k"), (2, 1, "b", "k"), (3, 1, "c", "n")]
    assert sorted(map(tuple, store.upsert(got, new, ["id", "v"], ["title"]).collect())) == sorted(map(tuple, got.collect()))
    assert store.insert_ignore(old, new, "id").count() == 3
    assert [r.keep for r in store.mark(old, "id", new, {"keep": "z"}).orderBy("id").collect()] == ["z", "k"]
    assert store.delete_where(old, {"title": "a", "v": 1}).count() == 1
    path = str(tmp_path / "t")
    store.replace(spark, old, path)
    store.replace(spark, spark.read.parquet(path).where("id = 2"), path)
    assert spark.read.parquet(path).count() == 1


# retrieval


def test_bm25_floor_and_fusion(spark):
    docs = spark.createDataFrame([(i, f"data protection rule {'extra ' * (i % 3)}") for i in range(10)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "extra data"), (2, "absent")], "query_id int, text string")
    got = retrieval.bm25(docs, q, 4).collect()
    assert all(r.query_id == 1 for r in got)
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    assert [(r.chunk_id, r.score) for r in retrieval.fuse([("dense", 0.6, a), ("sparse", 0.4, b)], 5).orderBy("rank").collect()] == [("b", round(0.6 / 62 + 0.4 / 61, 6)), ("a", round(0.6 / 61, 6)), ("c", round(0.4 / 62, 6))]
    assert [r.chunk_id for r in retrieval.merge_ranked([a, b], "chunk_id", 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_rewrite(spark):
    rows = [("What does GDPR say?",), ("FTC fine of 2023",), ("ICO rules 2023",), ("latest AI Act Article 5",), ("nothing",)]
    got = rewrite.rewrite(spark.createDataFrame(rows, "q string"), "q").collect()
    assert [r.jurisdiction for r in got] == ["EU", "US", "UK", "EU", "UNKNOWN"] and [r.temporal for r in got] == [None, "2023", "2023", "recent", None]
    assert got[3].legal_terms == ["Article 5", "AI Act"] and all(r.all_queries[0] == r.q for r in got) and len(got[3].all_queries) == 3


def test_conflicts(spark):
    latest = spark.createDataFrame([("r2", "EU", "the AI ACT\nand consent to a cookie"), ("r1", "EU", "AI Act"), ("r3", "US", "Artificial Intelligence"), ("r4", "EU", "tracking")], "regulation_id string, jurisdiction string, raw_text string")
    got = conflicts.detect_conflicts(latest).collect()
    assert [(r.topic, r.regulation_id_a, r.regulation_id_b, r.severity) for r in got] == [("AI System Regulation", "r1", "r3", "medium")]
    twice = conflicts.merge_signals([conflicts.detect_conflicts(latest), conflicts.detect_conflicts(latest)])
    assert twice.count() == 1


def test_answers(spark):
    df = spark.createDataFrame([("**Answer:** yes\n**Sources:** [1]\n**Notes:** n",), ("plain",)], "t string")
    got = answers.parse_answer(df, "t", ("Answer", "Sources", "Notes")).collect()
    assert tuple(got[0])[1:] == ("yes", "[1]", "n") and got[1].section_1 == "plain"


def test_keys(spark):
    import hashlib

    row = spark.createDataFrame([("r", 3, None)], "a string, i int, t string").select(ids.chunk_id("a", "i", "t"), ids.source_hash("t")).first()
    assert row[0] == hashlib.sha256(b"r::3::").hexdigest()[:24] and row[1] == hashlib.sha256(b"").hexdigest()[:32]


# pipeline and stream


def test_pipeline(spark, data, tmp_path):
    landed = pipeline.as_landed(corpus.regulations(spark, data))
    first = pipeline.run(spark, [landed.where("doc_id % 2 = 0")], str(tmp_path / "w"))
    again = pipeline.run(spark, [landed.where("doc_id % 2 = 0")], str(tmp_path / "w"))
    assert first["regulations"] > 0 and again["regulations"] == first["regulations"] and again["new"] == 0
    more = pipeline.run(spark, [landed], str(tmp_path / "w"))
    assert more["regulations"] > first["regulations"] and more["chunks"] > first["chunks"]
    assert views.regulations_latest(spark.read.parquet(str(tmp_path / "w/regulations"))).count() > 0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1)), ("a", datetime.datetime(2024, 1, 1)), ("b", datetime.datetime(2024, 1, 1))], "source_hash string, ingested_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    s = landing.first_of_key(landing.landed_stream(spark, str(tmp_path / "in"), rows.schema), "source_hash", "ingested_at", "1 day")
    seen = []
    landing.start(s, lambda df, _: seen.extend(r.source_hash for r in df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(seen) == ["a", "b"]
    health = spark.createDataFrame([("x", datetime.datetime(2024, 1, 1), 3, True), ("x", datetime.datetime(2024, 1, 1, 0, 30), 4, False)], "source string, run_at timestamp, rows_ingested int, sla_met boolean")
    health.write.parquet(str(tmp_path / "h"))
    w = landing.health_windows(landing.landed_stream(spark, str(tmp_path / "h"), health.schema))
    q = w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.runs, r.total_rows, r.sla_breaches) for r in spark.table("w").collect()] == [(2, 7, 1)]


# injected models


def test_pdf_cascade(spark):
    from statuta.sources import pdf

    def broken(data):
        raise ValueError("bad")

    files = spark.createDataFrame([("a", bytearray(b"one\fTwo")), ("b", bytearray(b" "))], "path string, content binary")
    got = pdf.extract(files, [("first", broken), ("second", lambda d: bytes(d).decode().split("\f"))]).orderBy("path", "page_number").collect()
    assert [(r.path, r.method, r.page_number, r.text) for r in got] == [("a", "second", 1, "one"), ("a", "second", 2, "Two"), ("b", "none", None, None)]
    assert got[2].errors == ["first: bad", "second: no text"]


def test_embedding(spark):
    from statuta.operators import embedding

    chunks = spark.createDataFrame([("c1", "data protection", "t" * 300, 1), ("c2", "", None, None), ("c3", "bad", "t", 2)], "chunk_id string, text string, title string, page int")

    def model(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in texts]

    done = embedding.embed(chunks, "text", model, 1)
    assert {r.chunk_id: r.embedding for r in done.collect()} == {"c1": [15.0, 1.0], "c2": [0.0, 1.0], "c3": None}
    table = spark.createDataFrame([("c2", [9.0])], "chunk_id string, embedding array<float>")
    assert {r.chunk_id: r.embedding for r in embedding.upsert_vectors(table, done).collect()} == {"c1": [15.0, 1.0], "c2": [0.0, 1.0]}
    v = chunks.select("chunk_id", embedding.hash_embedding(F.col("text")).alias("v")).orderBy("chunk_id").collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-9 and not any(v[1].v)
    m = {r.chunk_id: r.metadata for r in embedding.metadata(chunks).collect()}
    assert len(m["c1"].title) == 200 and m["c2"].title == "" and m["c2"].page == 0


def test_compare_topics(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def judge(topic: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["high" if "ban" in x + y else None for x, y in zip(a, b)])

    hits = spark.createDataFrame([("t", "EU", 1, "e1", "ban"), ("t", "US", 1, "u1", "free"), ("t", "UK", 1, "k1", "free"), ("t", "US", 3, "u9", "ban")], "topic string, jurisdiction string, rank int, regulation_id string, text string")
    got = conflicts.compare_topics(hits, judge).collect()
    assert sorted((r.jurisdiction_a, r.jurisdiction_b, r.regulation_id_a) for r in got) == [("EU", "UK", "e1"), ("EU", "US", "e1")]


def test_rerank(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def length(q: pd.Series, t: pd.Series) -> pd.Series:
        return t.str.len().astype(float)

    hits = spark.createDataFrame([(1, "q", "a", "x"), (1, "q", "b", "xxx"), (1, "q", "c", "xx")], "query_id int, query string, chunk_id string, text string")
    assert [r.chunk_id for r in retrieval.rerank(hits, length, 2).orderBy("rank").collect()] == ["b", "c"]


def test_dense_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)], i % 2) for i in range(40)], "chunk_id long, embedding array<float>, label int")
    asked = rows.where("chunk_id < 9").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted(map(tuple, retrieval.dense(rows, asked, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieval.dense(rows, asked, 4).collect())) == want and len(want) == 36
    assert retrieval.dense(rows, asked.limit(0), 4).count() == 0


def test_severity_order(spark):
    signals = spark.createDataFrame([("a", "low"), ("b", "high"), ("c", "medium"), ("d", None)], "signal_id string, severity string")
    assert [r.signal_id for r in views.by_severity(signals).collect()] == ["c", "a", "b", "d"]
    assert [r.signal_id for r in views.by_severity(signals, 3, ranked=True).collect()] == ["b", "c", "a"]
