"""Corpus statistics, phrases and word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.tables import Scratch


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(X.tokenize(F.col(text))).alias("word"))


def term_frequencies(words: DataFrame, least: int = 20) -> DataFrame:
    """word, freq of the words that occur often enough; the partial count keeps hot words from one task."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)


def adjacent(docs: DataFrame, text: str = "text") -> DataFrame:
    """a, b: each token and the next one of the same text."""
    t = X.tokenize(F.col(text))
    pairs = F.expr("transform(slice(t, 1, greatest(size(t) - 1, 0)), (x, i) -> struct(x as a, t[i + 1] as b))")
    return docs.select(t.alias("t")).select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def bigram_scores(docs: DataFrame, least: int = 5, threshold: float = 10.0, text: str = "text") -> DataFrame:
    """a, b, n, score: adjacent pairs with (n - least) * vocabulary / (freq a * freq b) above the threshold.

    Pairs are counted by the 64-bit hashes of their words, which are narrow keys; the pairs that occur often enough get
    their words and counts from the vocabulary, one row a word."""
    scratch = Scratch(docs.sparkSession, "bigrams")
    t = X.tokenize(F.col(text))
    freq = scratch.keep(docs.select(F.explode(t).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq")), "words")
    ids = docs.select(F.transform(t, lambda x: F.xxhash64(x)).alias("t"))
    next_to = ids.select(F.explode(F.expr("transform(slice(t, 1, greatest(size(t) - 1, 0)), (x, i) -> struct(x as ha, t[i + 1] as hb))")).alias("p"))
    pairs = next_to.groupBy("p.ha", "p.hb").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    size = freq.count()
    named = freq.select(F.xxhash64("word").alias("h"), "word", "freq")
    scored = pairs.join(named.select(F.col("h").alias("ha"), F.col("word").alias("a"), F.col("freq").alias("fa")), "ha").join(named.select(F.col("h").alias("hb"), F.col("word").alias("b"), F.col("freq").alias("fb")), "hb")
    score = F.round((F.col("n") - least) * F.lit(size) / F.col("fa") / F.col("fb"), 6)
    return scored.select("a", "b", "n", score.alias("score")).where(F.col("score") > threshold)


def lowercase_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """word, value. Lower-cased words; of words that become equal the largest value counts."""
    return vocabulary.groupBy(F.lower("word").alias("word")).agg(F.max("value").alias("value"))


def phrase_capacity(phrases: DataFrame) -> DataFrame:
    return phrases.agg(F.max(F.size(F.split("phrase", "_"))).alias("capacity"))


def phrase_hits(merged_docs: DataFrame) -> DataFrame:
    words = merged_docs.select(F.explode("tokens").alias("phrase")).where(F.col("phrase").contains("_"))
    return words.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
