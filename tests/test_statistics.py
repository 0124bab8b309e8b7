"""Quantiles, ranks, tails and places against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import polysema.__main__ as cli
from polysema.functions.special import binomial_share, binomial_tail, ln_gamma
from polysema.operators import evaluate
from polysema.sources import readers


def values(kind):
    r = random.Random(kind)
    return {
        "skewed": [math.exp(r.gauss(0, 12)) for _ in range(3000)], "ties": [7.0] * 900 + [r.choice([1.0, 7.0, 1e9]) for _ in range(100)], "one": [3.5], "two": [1.0, 2.0],
        "far": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-320, 1e-320], "near": [1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 5, "even": [float(k) for k in range(10_000)],
    }[kind]


@pytest.mark.parametrize("kind", ["skewed", "ties", "one", "two", "far", "near", "even"])
def test_quantiles_are_exact(spark, kind):
    x = values(kind)
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "v double")
    s = sorted(x)
    for share in (0.0, 0.5, 0.93, 1.0) if kind != "even" else (0.5,):
        at = share * (len(s) - 1)
        low, high = s[math.floor(at)], s[math.ceil(at)]
        want = low if low == high else low + (at - math.floor(at)) * (high - low)
        assert evaluate.quantile(df, "v", share) == want


def test_quantile_of_nothing(spark):
    assert evaluate.quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None


def test_ranks_of_skewed_values(spark):
    x = values("skewed")[:800] + [1.0] * 200
    y = [math.log(v) + random.Random(i).gauss(0, 3) for i, v in enumerate(x)]
    rank = lambda v: np.array([sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v])
    want = np.corrcoef(rank(x), rank(y))[0, 1]
    got = evaluate.spearman(spark.createDataFrame(list(zip(x, y)), "a double, b double"), "a", "b").first()
    assert got["n"] == 1000 and got["rho"] == pytest.approx(want, abs=1e-6)


def test_tails_of_coins(spark):
    pairs = [(n, m) for n in (1, 2, 3, 10, 57, 400) for m in sorted({0, n // 3, n // 2})]
    df = spark.createDataFrame(pairs, "n bigint, m bigint")
    got = df.select("n", "m", binomial_tail(F.col("n"), F.col("m")).alias("tail"), binomial_share(F.col("n"), F.col("m")).alias("share"), ln_gamma(F.col("n") / 2 + 0.01).alias("g")).collect()
    for r in got:
        assert r["tail"] == pytest.approx(sum(math.comb(r["n"], k) for k in range(r["m"] + 1)) / 2 ** r["n"], rel=1e-9)
        assert r["share"] == pytest.approx(math.comb(r["n"], r["m"]) / 2 ** r["n"], rel=1e-9)
        assert r["g"] == pytest.approx(math.lgamma(r["n"] / 2 + 0.01), abs=1e-9)


def test_tail_of_ten_million_coins(spark):
    n, m = 10_000_000, 4_998_000
    r = spark.createDataFrame([(n, m)], "n bigint, m bigint").select(binomial_tail(F.col("n"), F.col("m")).alias("t")).first()
    k = np.arange(4_900_000, m + 1)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(v + 1) + math.lgamma(n - v + 1) for v in k.tolist()]) - n * math.log(2)
    assert r["t"] == pytest.approx(float(np.exp(logs).sum()), abs=1e-6) and 0.05 < r["t"] < 0.2


def test_places_of_lines_over_splits(spark, tmp_path):
    for name, lines in (("b.txt", 700), ("a.txt", 900)):
        (tmp_path / name).write_text("".join(f"{name}{k}\n" for k in range(lines)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        rows = spark.read.text(str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = {r["place"]: r["value"] for r in evaluate.placed(rows).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate([f"a.txt{k}" for k in range(900)] + [f"b.txt{k}" for k in range(700)]))


def test_commands_of_baselines_and_significance(spark, tmp_path, capsys):
    head = "context_id\ttarget\ttarget_pos\ttarget_position\tgold_sense_ids\tpredict_sense_ids\tgolden_related\tpredict_related\tcontext"
    row = lambda i, gold: f"{i}\tbank\tn\t0,4\t{gold}\t\t\t\tbank of x"
    (tmp_path / "t.tsv").write_text("\n".join([head, row(1, 1), row(2, 2), row(3, 1)]) + "\n")
    (tmp_path / "c.tsv").write_text("word\tcid\tcluster\tisas\nbank\t1\triver:1.0, shore:0.5\t\nbank\t2\tmoney:1.0\t\n")
    for command in ("most-frequent", "random"):
        cli.main([command, "--clusters", f"{tmp_path}/c.tsv", "--test", f"{tmp_path}/t.tsv", "--out", f"{tmp_path}/{command}"])
    got = {r["context_id"]: r["predict_sense_ids"] for r in readers.wsd_set(spark, f"{tmp_path}/most-frequent").collect()}
    assert got == {"1": "1", "2": "1", "3": "1"}
    assert {r["predict_sense_ids"] for r in readers.wsd_set(spark, f"{tmp_path}/random").collect()} <= {"1", "2"}
    for name, right in (("l", "true false true true"), ("r", "true true false false")):
        (tmp_path / f"{name}.tsv").write_text("\n".join([head + "\tcorrect", *(f"{row(i, 1)}\t{c}" for i, c in enumerate(right.split()))]) + "\n")
    cli.main(["significance", "--left", f"{tmp_path}/l.tsv", "--right", f"{tmp_path}/r.tsv"])
    assert "|2  |1  |1.0" in capsys.readouterr().out
    (tmp_path / "p.txt").write_text("It's 3:00 p.m.\nI can't.\n")
    cli.main(["preprocess", "--corpus", f"{tmp_path}/p.txt", "--out", f"{tmp_path}/words"])
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/words").collect()] == ["It 's 3:00 p.m .", "I ca n't ."]
