"""Numbers as text, and clusters of many members."""

import random
import time

from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.sources import writers


def test_numbers_are_rounded_as_in_c(spark):
    r = random.Random(2)
    x = [0.0625, 0.1875, 0.0615234375, 1.0005, 1.005, 0.0125, 2.5, 0.0, -0.0, -0.0625, -0.0001, 999.9995, 123456.0005, 4503.0625, 1e15 + 0.5, 5e-324, 0.9999999, float("nan")]
    x += [r.choice([r.random(), r.randrange(1 << 20) / (1 << 20), r.randrange(10**6) / 10**4 + 0.00005, r.gauss(0, 1e4)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    for digits in (2, 3, 6):
        got = [r["s"] for r in df.orderBy("i").select(X.fixed_point(F.col("x"), digits).alias("s")).collect()]
        assert [(a, g) for a, g in zip(x, got) if g.lower() != f"{a:.{digits}f}"] == []


def test_scores_of_disambiguated_members(spark, tmp_path):
    """65536 / 2**20 lies between two numbers of three digits."""
    rows = spark.createDataFrame([("a", 1, "x#1", 65536 / 1048576), ("a", 1, "y#2", 196608 / 1048576)], "word string, cid int, sense string, score double")
    writers.disambiguated(rows, f"{tmp_path}/d")
    assert "a\t1\ty#2:0.188, x#1:0.062\t" in [r["value"] for r in spark.read.text(f"{tmp_path}/d").collect()]


def test_large_cluster_is_read_in_its_length(spark):
    """A list of all members was made for each of them."""
    n = 6000
    line = ", ".join(f"m{i % (n - 10)}:{i / n:.6f}" for i in range(n))
    df = spark.createDataFrame([(line,)], "s string").repartition(1)
    t = time.time()
    got = df.select(X.parse_cluster(F.col("s")).alias("c")).first()["c"]
    assert time.time() - t < 20
    assert [r["word"] for r in got] == [f"m{i}" for i in range(n - 10)] and [r["pos"] for r in got] == list(range(1, n - 9))
    assert got[3]["sim"] == round((n - 10 + 3) / n, 6) and got[20]["sim"] == round(20 / n, 6)
