import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from statuta.operators import dedup
from statuta.operators.dedup import drop_similar, similar_strings


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(row[-1], above[j + 1]))
    return row[-1]


def alike(a, b, t):
    return not (a or b) or 2 * lcs(a, b) / (len(a) + len(b)) >= t - 1e-12


def edited(rng, s, most):
    s = list(s)
    for _ in range(rng.randint(0, most)):
        at = rng.randint(0, len(s))
        what = rng.random()
        if what < 0.4:
            s.insert(at, rng.choice("abcé "))
        elif what < 0.8 and s:
            del s[min(at, len(s) - 1)]
        elif s:
            s[min(at, len(s) - 1)] = rng.choice("abcé ")
    return "".join(s)


@pytest.mark.parametrize("t", [0.7, 0.8, 0.92, 1.0])
def test_no_pair_is_missed(spark, t):
    """Letters of few kinds, all lengths from nothing on, edits at every place."""
    rng = random.Random(int(t * 100))
    old = [""] + ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 45))) for _ in range(70)]
    new = [edited(rng, s, max(1, int(len(s) * (1 - t) * 1.5))) for s in old]
    of = lambda xs: spark.createDataFrame([(x,) for x in xs], "s string")
    got = {(r.a, r.b): r.similarity for r in similar_strings(of(new), of(old), t).collect()}
    assert set(got) == {(a, b) for a in new for b in old if alike(a, b, t)} and len(got) >= 10
    assert all(abs(s - (2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1)) < 1e-9 for (a, b), s in got.items())
    with pytest.raises(ValueError):
        similar_strings(of(new), of(old), 0.5)


@pytest.mark.parametrize("known", [1, 3, 6, 60])
def test_rows_against_all_pairs(spark, known):
    """A title that a third of the rows share, null titles, sources and regulations."""
    rng = random.Random(known)
    titles = ["notice on the transfer of data", "transfer of data on the notice", "notice on the transfers of data", None, "", "short", "a wholly different title"]
    row = lambda i: (i, rng.choice(["s1", "s2", "s3", None]), rng.choice(["r1", "r2", "r3", f"r{i}", None]), titles[0] if i % 3 == 0 else rng.choice(titles))
    new, old = [row(i) for i in range(120)], [row(i) for i in range(known)]
    schema = "id int, source_name string, regulation_id string, title string"
    got = sorted(r.id for r in drop_similar(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect())
    key = lambda t: " ".join(sorted((t or "").split()))
    near = {(a, b): alike(key(a), key(b), 0.92) for a in titles for b in titles}
    want = [i for i, s, r, t in new if not any(near[t, u] and s != x and r != y for _, x, y, u in old)]
    assert got == want and (len(want) > 0 or known == 60)
    few = [(1, "s9", "r9", titles[0]), (2, "s9", "r9", "nothing alike")]
    lone = [(1, "s1", "r9", titles[0]), (2, "s9", "r2", titles[1])]
    assert [r.id for r in drop_similar(spark.createDataFrame(few, schema), spark.createDataFrame(lone, schema)).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in drop_similar(spark.createDataFrame(few, schema), spark.createDataFrame([*lone, (3, "s1", "r1", titles[2])], schema)).collect()] == [2]


def test_signatures_do_not_follow_the_square(spark):
    """A title of many rows is one string, however many rows of either side have it."""
    many = spark.range(20_000).selectExpr("cast(id as int) AS id", "concat('s', id % 50) AS source_name", "concat('r', id) AS regulation_id", "'the same title for everything' AS title")
    assert similar_strings(many.selectExpr("title AS s"), many.selectExpr("title AS s")).count() == 1
    assert drop_similar(many, many).count() == 0


@pytest.fixture
def compared(spark, monkeypatch):
    """Pairs whose common subsequence is looked for."""
    seen, plain = spark.sparkContext.accumulator(0), dedup.indel_similarity.func

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return plain(a, b)

    monkeypatch.setattr(dedup, "indel_similarity", counted)
    return seen


def test_titles_with_one_beginning_are_not_all_compared(spark, compared):
    """Short titles of one length that begin or end alike, as 'Doc' and a number in hexadecimal: only equal ones can be similar."""
    docs = spark.range(800).selectExpr("concat('Doc ', substring(md5(cast(id AS string)), 1, 8)) AS t").select(dedup.sorted_tokens(F.col("t")).alias("s"))
    assert similar_strings(docs, docs.limit(600)).count() == 600
    assert compared.value <= 5_000


def test_versions_do_not_compare_all_titles(spark, compared):
    """The query on 1,000 documents, whose titles are as short as that."""
    from __spark_entry__ import queries

    rows = queries()["dedup_versions"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 326 and compared.value <= 1_000


def test_titles_of_few_words_are_not_all_compared(spark, compared):
    """Titles of five words out of few, so that each shares a segment with most others; few have nearly the same letters."""
    words = ["red blue old new hot cold small large".split(), "bolt gear nut plate ring anvil widget gizmo".split(), ["ECONOMY", "MEDIUM"], ["Brand#1", "Brand#12"]]
    titles = [" ".join(sorted((a, b, c, d))) for a in words[0] for b in words[1] for c in words[2] for d in words[3]]
    df = spark.createDataFrame([(x,) for x in titles], "s string")
    got = {(r.a, r.b) for r in similar_strings(df, df).collect()}
    assert got == {(a, b) for a in titles for b in titles if alike(a, b, 0.92)} and compared.value <= len(titles) ** 2 / 10


def rows_made(df):
    """The most rows that a step of a collected frame's plan made."""

    def most(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return most(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return most(p.plan())
        own, below = p.metrics().get("numOutputRows"), p.children()
        return max([own.get().value() if own.isDefined() else 0, *[most(below.apply(i)) for i in range(below.size())]])

    return most(df._jdf.queryExecution().executedPlan())


def test_rows_do_not_meet_all_similar_rows(spark):
    """Forty similar titles, each of many rows: a row of them doesn't meet forty others."""
    title = "concat('guidance on the retention of all records, part ', chr(65 + id % 40))"
    rows = spark.range(8_000).selectExpr("cast(id as int) AS id", "concat('s', id % 40) AS source_name", "concat('r', id) AS regulation_id", f"{title} AS title")
    left = drop_similar(rows, rows)
    assert left.collect() == [] and rows_made(left) <= 20_000


@pytest.mark.parametrize("seed", range(3))
def test_witnesses_decide_as_all_rows(spark, seed):
    """For every source and regulation, met or not; nulls are values."""
    rng = random.Random(seed)
    some = lambda k: rng.choice([None, *range(k)])
    rows = [(k, some(2 + k % 4), some(2 + k // 4 % 4)) for k in range(60) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "k int, s int, r int").select("k", F.struct(F.col("s").alias("x")).alias("src"), F.struct(F.col("r").alias("x")).alias("reg"))
    got = [(r.k, r.src.x, r.reg.x) for r in dedup._witnesses(df, "k").collect()]
    assert set(got) <= set(rows) and max(sum(k == x[0] for x in got) for k in range(60)) <= 5
    other = lambda xs, k, s, r: any(k == x and s != y and r != z for x, y, z in xs)
    given = [None, *range(7)]
    assert all(other(rows, k, s, r) == other(got, k, s, r) for k in range(60) for s in given for r in given)
