"""Vectors from character n-grams against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polysema.operators import subwords


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = ((h ^ (b | 0xFFFFFF00 if b > 127 else b)) * 16777619) & 0xFFFFFFFF
    return h


def grams(word, shortest, longest):
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w)) for n in range(shortest, longest + 1) if i + n <= len(w) and not (n == 1 and i in (0, len(w) - 1))]


@pytest.mark.parametrize("shortest,longest", [(3, 6), (1, 2), (2, 4)])
def test_known_and_unknown_words(spark, shortest, longest):
    r = np.random.default_rng(5)
    known = ["house", "größe", "a", "новый"]
    matrix = r.standard_normal((len(known) + 50, 4))
    words = [*known, "houses", "größer", "x", "", "日本語", "😀b", "house"]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    rows = [(i, v.tolist()) for i, v in enumerate(matrix) if i != 9]  # one shared row is missing
    got = {x["word"]: x for x in subwords.word_vectors(df([(w,) for w in [*words, None]], "word string"), df([(w, i) for i, w in enumerate(known)], "word string, row int"), df(rows, "row bigint, v array<double>"), 4, 50, shortest, longest).collect()}
    assert set(got) == set(words)
    for w in words:
        at = ([known.index(w)] if w in known else []) + [len(known) + fnv(g) % 50 for g in grams(w, shortest, longest)]
        vs = [matrix[i] for i in at if i != 9]
        assert np.allclose(got[w]["v"], np.mean(vs, 0) if vs else 0) and got[w]["known"] == (w in known)


def test_hash_and_ngrams(spark):
    df = spark.createDataFrame([(t,) for t in ("", "a", "foobar", "é", "日本")], "t string")
    for r in df.select("t", subwords.hashed(F.col("t")).alias("h"), subwords.ngrams(F.col("t")).alias("g")).collect():
        assert r["h"] == fnv(r["t"]) and r["g"] == grams(r["t"], 3, 6)
    assert fnv("a") == 0xE40C292C and fnv("foobar") == 0xBF9CF968  # published values
