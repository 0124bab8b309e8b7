"""Baselines, correlation and significance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polysema.functions.special import binomial_share, binomial_tail
from polysema.tables import Scratch


def most_frequent_sense(senses: DataFrame) -> DataFrame:
    """senses: word, cid, size. The sense of the largest cluster (ties: smaller id)."""
    best = F.min(F.struct((-F.col("size")).alias("s"), F.col("cid")))
    return senses.groupBy("word").agg(best.alias("b")).select("word", F.col("b.cid").alias("cid"))


def with_most_frequent(instances: DataFrame, senses: DataFrame) -> DataFrame:
    """instances: ctx_id, target. predicted is null where the target is not covered."""
    mfs = most_frequent_sense(senses).withColumnsRenamed({"word": "target", "cid": "predicted"})
    return instances.join(mfs, "target", "left")


def random_sense(instances: DataFrame, senses: DataFrame, seed: int = 7) -> DataFrame:
    """instances: ctx_id bigint, target. One of the target's senses by a linear step of ctx_id, the same on every run."""
    n = senses.groupBy("word").agg(F.countDistinct("cid").alias("n")).withColumnRenamed("word", "target")
    draw = F.pmod(F.pmod(F.col("ctx_id"), F.lit(65521)) * 16807 + seed, F.lit(2147483647))
    return instances.join(n, "target").select("ctx_id", "target", (F.pmod(draw, F.col("n")) + 1).cast("int").alias("predicted"))


def _ranked(pairs: DataFrame, column: str, name: str) -> DataFrame:
    """value, average rank (the mean of a tie's places), without a window over all rows: distinct values are counted and sorted
    into ranges that a sample balances, however they are spread, and the counts of the ranges below are added."""
    scratch = Scratch(pairs.sparkSession, "ranks")
    counts = pairs.groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ranged = scratch.keep(counts.repartitionByRange("x").withColumn("p", F.spark_partition_id()), "ranges")
    below = ranged.groupBy("p").agg(F.sum("n").alias("pn"))
    offsets = below.select("p", F.coalesce(F.sum("pn").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    own = Window.partitionBy("p").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("before") + F.coalesce(F.sum("n").over(own), F.lit(0)) + (F.col("n") + 1) / 2
    return ranged.join(F.broadcast(offsets), "p").select(F.col("x").alias(column), rank.alias(name))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, rho over the rows where both are known."""
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b))
    ranked = known.join(_ranked(known, a, "ra"), a).join(_ranked(known, b, "rb"), b)
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """b, c, p, midp, chi2 of two systems' correctness (booleans) over the same rows; null without a difference."""
    x, y = F.col(a), F.col(b)
    t = rows.agg(F.count(F.when(x & ~y, 1)).alias("b"), F.count(F.when(~x & y, 1)).alias("c"))
    n, m = F.col("b") + F.col("c"), F.least("b", "c")
    t = t.withColumn("n", n).withColumn("m", m)
    p, last = 2 * binomial_tail(F.col("n"), F.col("m")), binomial_share(F.col("n"), F.col("m"))
    some = F.col("n") > 0
    return t.select(
        "b", "c", F.when(some, F.round(p, 6)).alias("p"), F.when(some, F.round(p - last, 6)).alias("midp"), F.when(some, F.round((F.col("b") - F.col("c")) * (F.col("b") - F.col("c")) / F.col("n"), 6)).alias("chi2")
    )


def joined_by_id(left: DataFrame, right: DataFrame, key: str = "context_id") -> DataFrame:
    """Paired correctness of two systems by the instance's id."""
    return left.select(key, F.col("correct").alias("a")).join(right.select(key, F.col("correct").alias("b")), key)


def placed(rows: DataFrame) -> DataFrame:
    """rows: as a reader of text files gives them. The same with ``place``, the number of the row from 0 in the order of the files'
    names and of the lines in each.

    Splits are counted where they are read; a split's offset is the sum of those before it (a row a split), so no task holds more than a split."""
    scratch = Scratch(rows.sparkSession, "placed")
    known = rows.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("at_"), F.monotonically_increasing_id().alias("id_"))
    known = scratch.keep(known, "rows")
    splits = known.groupBy("file_", "at_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("file_", "at_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file_", "at_", before.alias("before_"))
    inside = F.row_number().over(Window.partitionBy("file_", "at_").orderBy("id_"))
    numbered = known.withColumn("inside_", inside).join(offsets, ["file_", "at_"])
    return numbered.select(*rows.columns, (F.col("before_") + F.col("inside_") - 1).alias("place"))


def joined_by_place(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paired correctness of two systems by the place of the lines in their files; both as read, with ``correct``."""
    return placed(left).select("place", F.col("correct").alias("a")).join(placed(right).select("place", F.col("correct").alias("b")), "place")


#: Bins of a round, and distinct values at which they are read instead.
BINS = 4096


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile with linear interpolation between neighbours; null and NaN don't count.

    Rounds of histograms: the bin that holds the wanted place is cut into BINS again, until it holds one value or BINS distinct
    ones. A round is one aggregate of BINS rows; nothing grows with the number of values."""
    x = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n, low, high = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    at = share * (n - 1)
    first, second = math.floor(at), math.ceil(at)
    a = _value_at(x, first, low, high)
    return a if first == second else a + (at - first) * (_value_at(x, second, low, high) - a)


def _value_at(x: DataFrame, place: int, low: float, high: float) -> float:
    """The value at a place (from 0) in order; all values from low to high have the places from 0 on."""
    while low < high:
        inside = x.where((F.col("x") >= low) & (F.col("x") <= high))
        half = 0.5 if max(abs(low), abs(high)) > 1e300 else 1.0  # the difference may be beyond the largest number
        share = F.col("x") * half - low * half
        bin_ = F.least(F.floor(share / (high * half - low * half) * BINS), F.lit(BINS - 1)).cast("int")
        rows = inside.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("b").collect()  # BINS rows at most
        for r in rows:
            if place < r["n"]:
                if len(rows) == 1 and (r["low"], r["high"]) == (low, high):  # no narrower: neighbours of the number line
                    values = inside.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").collect()
                    return next(v["x"] for k, v in enumerate(values) if place < sum(u["n"] for u in values[: k + 1]))
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    median = quantile(df, column, 0.5)
    return df.agg(F.sum(c).alias("sum"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.lit(median).cast("double").alias("median"), F.min(c).alias("min"), F.max(c).alias("max"))
