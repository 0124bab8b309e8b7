"""Vectors of words from character n-grams, for words that a model doesn't know.

The model is a table of rows by number: the words' own rows, then BUCKETS rows that n-grams share by a hash. A word is
read as ``<word>``; its n-grams of SHORTEST to LONGEST characters are hashed (32-bit FNV-1a, bytes
from 128 on with their sign, as the usual implementation has it), and its vector is the mean of its own row, if it
has one, and of its n-grams' rows.

All columns are built-in functions. The matrix stays where it is: the n-grams of the distinct words go to
the rows by one join, and come back by word; a frequent n-gram is a row of each word that has it, so the join can split it.

Null words have no row; a word without n-grams or row of its own (the empty one, if SHORTEST is above 2) has a vector of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysema.functions import vectors as V

SHORTEST, LONGEST, BUCKETS = 3, 6, 2_000_000
# Fixed values of the hash: its start and its factor.
_START, _FACTOR = 2166136261, 16777619


def ngrams(word: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """array<string> of the n-grams of ``<word>``, by place, then length; a border alone is none."""
    w = F.concat(F.lit("<"), word, F.lit(">"))
    n = F.length(w)

    def at(i: Column) -> Column:
        lengths = F.sequence(F.lit(shortest), F.lit(longest))
        return F.transform(F.filter(lengths, lambda k: (i + k - 1 <= n) & ~((k == 1) & ((i == 1) | (i == n)))), lambda k: F.substring(w, i, k))

    return F.flatten(F.transform(F.sequence(F.lit(1), n), at))


def hashed(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits, as a bigint."""
    code = F.hex(F.encode(text, "UTF-8"))
    size = F.octet_length(text)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    signed = F.transform(places, lambda i: F.when(byte(i) >= 128, byte(i) + 0xFFFFFF00).otherwise(byte(i)))
    return F.aggregate(signed, F.lit(_START).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * _FACTOR).bitwiseAND(0xFFFFFFFF))


def word_vectors(words: DataFrame, known: DataFrame, matrix: DataFrame, size: int, buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST, offset: int | None = None) -> DataFrame:
    """words: word. known: word, row. matrix: row (bigint), v. word, v, known of each distinct word.

    offset: number of the first shared row, by default the number of known words. Rows that the matrix hasn't count as none."""
    first = known.count() if offset is None else offset
    w = words.where("word is not null").select("word").distinct()
    rows = F.transform(ngrams(F.col("word"), shortest, longest), lambda g: F.pmod(hashed(g), F.lit(buckets)) + first)
    shared = w.select("word", F.posexplode(rows).alias("place", "row"))
    own = w.join(known.select("word", "row"), "word").select("word", F.lit(-1).alias("place"), F.col("row").cast("bigint").alias("row"))
    found = own.unionByName(shared).join(matrix.select("row", V.doubles(F.col("v")).alias("v")), "row")
    # as many rows as the word has n-grams
    sums = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", F.lit(1.0).alias("weight"), "v"))).alias("rows"), F.min("place").alias("least"))
    means = sums.select("word", V.scaled(V.weighted_sum(F.col("rows")), 1 / F.size("rows")).alias("v"), (F.col("least") < 0).alias("known"))
    return w.join(means, "word", "left").select("word", F.coalesce("v", F.array_repeat(F.lit(0.0), size)).alias("v"), F.coalesce("known", F.lit(False)).alias("known"))
