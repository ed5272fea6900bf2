import random
import statistics

from pyspark.sql import functions as F

from habitatrix.operators import ordering


def test_running_sum_in_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else rng.choice("abc"), rng.randrange(50), i, rng.randrange(9)) for i in range(3000)]
    rows += [(None, 1, -1, 4), ("hot", None, -2, 1)]
    df = spark.createDataFrame(rows, "g string, a int, b int, v bigint").repartition(7)
    got = {
        (r.g, r.b): r.s for r in ordering.running_sum(df, ["g"], ["a", "b"], "v", "s").collect()
    }
    want = {}
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2])):
            total += r[3]
            want[(g, r[2])] = total
    assert got == want


def test_ordinal_spreads_one_group(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    out = ordering.ordinal(df, [], ["k"], "pos")
    ks = [r.k for r in out.orderBy("pos").collect()]
    assert ks == sorted(ks)
    assert [r.pos for r in out.orderBy("pos").collect()] == list(range(1, 1001))


def test_ordinal_does_not_depend_on_partitions(spark):
    base = spark.range(500).select((F.col("id") % 5).alias("g"), (F.col("id") * 31 % 501).alias("k"))
    runs = [
        sorted(map(tuple, ordering.ordinal(base.repartition(n), ["g"], ["k"], "p").collect()))
        for n in (1, 9)
    ]
    assert runs[0] == runs[1]


def test_weighted_median(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), float(rng.randrange(20)), rng.randrange(1, 4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, w bigint")
    got = {r.g: r.m for r in ordering.grouped_median(df, ["g"], "v", "w", "m").collect()}
    for g in "xyz":
        flat = [v for a, v, w in rows if a == g for _ in range(w)]
        assert got[g] == statistics.median(flat)
