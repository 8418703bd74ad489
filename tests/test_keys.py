import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.operators.keys import keep_first, surrogate_key


def test_surrogate_key_equals_row_number(spark):
    rnd = random.Random(3)
    rows = [("k%05d" % rnd.randint(0, 99999), i) for i in range(3000)]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "bk string, v int").repartition(7)
    got = surrogate_key(df, "bk", "sk", num_partitions=5)
    want = df.withColumn("sk", F.row_number().over(Window.orderBy("bk")))
    a = sorted((r["bk"], r["sk"]) for r in got.collect())
    b = sorted((r["bk"], r["sk"]) for r in want.collect())
    assert a == b
    sks = sorted(x[1] for x in a)
    assert sks == list(range(1, len(a) + 1))


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o int, v string")
    got = sorted(tuple(r) for r in keep_first(df, ["k"], [F.col("o")]).collect())
    assert got == [("a", 1, "y"), ("b", 2, "z")]


def test_surrogate_key_default_partitioning(spark):
    rows = [("b%04d" % ((i * 7919) % 5000), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "bk string, v int").repartition(11)
    got = sorted((r["bk"], r["sk"]) for r in surrogate_key(df, "bk", "sk").collect())
    assert [sk for _, sk in got] == list(range(1, 5001))
    assert [bk for bk, _ in got] == sorted(bk for bk, _ in rows)
