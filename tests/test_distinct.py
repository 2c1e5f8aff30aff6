import random

from pyspark.sql import functions as F

from statuta.operators import distinct


def test_parts_add_up(spark):
    """Days kept apart and joined later give the counts of all rows; new days bring new values, numbers stay."""
    rng = random.Random(1)
    rows = [(d, rng.choice("abc"), rng.choice([None, *(f"v{x}" for x in range(50 * (d + 1)))])) for d in range(4) for _ in range(300)]
    df = spark.createDataFrame(rows, "day int, k string, v string")
    words, parts = None, None
    for day in range(4):
        own = df.where(F.col("day") == day)
        grown = distinct.grow_dictionary(own, "v", words).cache()
        if words is not None:
            assert words.join(grown, ["value", "n"], "left_anti").count() == 0
        words = grown
        bits = distinct.bitmaps(own, ["day", "k"], "v", words).cache()
        parts = bits if parts is None else parts.unionByName(bits)
    assert sorted(r.n for r in words.collect()) == list(range(1, words.count() + 1))
    of = lambda by: {tuple(r)[:-1]: r.n for r in distinct.counts(parts, by, "n").collect()}
    assert of(["day", "k"]) == {k: len({v for d, j, v in rows if (d, j) == k and v}) for k in {(d, j) for d, j, _ in rows}}
    assert of(["k"]) == {(k,): len({v for _, j, v in rows if j == k and v}) for k in "abc"}
    assert distinct.counts(parts.limit(0), ["k"], "n").count() == 0


def test_numbers_beyond_a_piece(spark):
    df = spark.range(70_000).select(F.lit("x").alias("k"), F.format_string("%06d", "id").alias("v"))
    words = distinct.grow_dictionary(df, "v")
    bits = distinct.bitmaps(df, ["k"], "v", words)
    assert bits.count() == 3 and distinct.counts(bits, ["k"], "n").first().n == 70_000
