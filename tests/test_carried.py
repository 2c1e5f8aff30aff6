import random
import threading

import pytest
from pyspark.sql import functions as F

from statuta.operators.carried import Running, carried
from statuta.scratch import materialize, tidy

VALUES = {
    "place": Running("count"), "total": Running("sum", "v"), "bits": Running("xor", "v"), "low": Running("min", "v"), "high": Running("max", "v"),
    "head": Running("last", "w"), "before": Running("prior", "w"),
}


def plain(rows):
    """The rows with their running values, by a loop."""
    out, state = [], {}
    for k, o, v, w in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), r[1])):
        s = state.setdefault(k, {"place": 0, "total": None, "bits": None, "low": None, "high": None, "head": None, "before": None, "w": None})
        s["before"], s["w"] = s["w"], w
        s["place"] += 1
        if v is not None:
            s |= {"total": (s["total"] or 0) + v, "bits": (s["bits"] or 0) ^ v, "low": v if s["low"] is None else min(s["low"], v), "high": v if s["high"] is None else max(s["high"], v)}
        s["head"] = s["head"] if w is None else w
        out.append((k, o, *[s[c] for c in VALUES]))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_values_with_a_hot_key(spark, ranges):
    rng = random.Random(ranges)
    keys = ["hot"] * 400 + [None] * 60 + [f"k{i % 90}" for i in range(300)]
    rows = [(k, i, rng.choice([None, rng.randint(-50, 50)]), rng.choice([None, f"w{i}"])) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, v long, w string")
    found = carried(df, ["k"], ["o"], VALUES, ranges)
    assert found.columns == ["k", "o", "v", "w", *VALUES]
    got = sorted(((r.k, r.o, *[r[c] for c in VALUES]) for r in found.collect()), key=lambda r: ((r[0] is not None, r[0] or ""), r[1]))
    assert got == plain(rows)


def test_a_hot_key_is_no_single_task(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    found = carried(df, ["k"], ["id"], {"place": Running("count")}, 16)
    assert found.where("k = 'hot'").agg(F.max("place")).first()[0] == 6667
    cut = df.withColumn("__key", F.struct("k")).repartitionByRange(16, "__key", "id").groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in cut.collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]


def test_no_rows(spark):
    assert carried(spark.createDataFrame([], "k string, o long, v long, w string"), ["k"], ["o"], VALUES).count() == 0


def test_scratch_of_two_threads_stays_apart(spark):
    both = threading.Barrier(2)
    found, failed = {}, []

    @tidy
    def build(n):
        own = materialize(spark.range(n))
        both.wait(60)  # both have made a table before either is done
        return own.where("id >= 0")

    def run(n):
        try:
            found[n] = build(n).count()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(n,)) for n in (10, 20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and found == {10: 10, 20: 20}
