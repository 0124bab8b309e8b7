"""Phrases of a vocabulary of any size."""

import random

import pytest
import regex

from polysema.functions.text import merged_left_to_right
from polysema.operators import phrases
from polysema.plans import catalogue


def test_all_phrases_are_merged(spark, tmp_path):
    r = random.Random(2)
    pairs = [(f"a{c}", f"b{c}") for c in "cdefghijklmnopqr"]
    texts = [" ".join(w for _ in range(6) for w in (*r.choice(pairs), "".join(r.choice("stuvwxyz") for _ in range(5)))) for _ in range(80)]
    texts += ["we saw the new york city hall twice", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("new york city hall",), ("new york",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    q = catalogue.queries()
    known = {f"{x['a']}_{x['b']}" for x in q["bigram_scores"](spark, str(tmp_path)).collect()} | {"new_york_city_hall", "new_york", "New_york", "New_york_city_hall"}
    want = {}
    for t in texts:
        for w in merged_left_to_right((t or "").split(), frozenset(known), 4):
            if "_" in w:
                want[w] = want.get(w, 0) + 1
    got = {x["phrase"]: x["n"] for x in q["phrase_merge_all"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 10 and got["new_york_city_hall"] == 1 and "new_york" not in got


def small_world(seed, n=120):
    r = random.Random(seed)
    words = ["a", "b", "c", "d", "a_b", "_", "c_", "é", "Z9x"]
    texts = [r.choice([" ", ", ", "  "]).join(r.choice(words) for _ in range(r.randint(0, 25))) for _ in range(n)] + [None, "", "...", "a"]
    vocabulary = {"_".join(r.choice("abcd") for _ in range(r.randint(2, 5))) for _ in range(40)} | {"a__b", "c__é", "é_a", "_a", "a_"}
    return texts, sorted(vocabulary)


@pytest.mark.parametrize("budget", [1 << 26, 300])
def test_merging_equals_left_to_right(spark, budget):
    """With a budget of 300 bytes the trie comes in several parts."""
    texts, vocabulary = small_world(budget)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, tokens string")
    known = spark.createDataFrame([(p,) for p in vocabulary], "phrase string")
    got = {r["doc_id"]: r["tokens"] for r in phrases.merged(docs, known, budget=budget).collect()}
    for i, t in enumerate(texts):
        tokens = None if t is None else regex.findall(r"[\p{L}\p{Nl}\p{No}_]+", t)
        assert got[i] == (None if t is None else merged_left_to_right(tokens, frozenset(vocabulary), 6)), t
    assert (len(phrases.tries(known, budget=budget)) > 1) == (budget == 300)


def test_places_of_words_and_phrases(spark):
    texts, vocabulary = small_world(4)
    vocabulary += ["a", "Z", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(map(tuple, phrases.occurrences(docs, spark.createDataFrame([(p,) for p in vocabulary], "phrase string")).collect()))
    want = []
    for i, t in enumerate(texts):
        spans = [(m.start(), m.end(), m.group()) for m in regex.finditer(r"[\p{L}\p{Nl}\p{No}_]+", t or "")]
        at = 0
        while at < len(spans):
            n = next((n for n in range(len(spans) - at, 0, -1) if "_".join(s[2] for s in spans[at : at + n]) in vocabulary), 0)
            if n:
                want.append((i, spans[at][0], spans[at + n - 1][1], "_".join(s[2] for s in spans[at : at + n])))
            at += max(n, 1)
    assert got == sorted(want) and len(want) > 100


def test_empty_vocabulary_and_texts(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "phrase string")
    assert phrases.merged(docs, none).first()["tokens"] == ["a", "b"]
    assert phrases.occurrences(docs, none).count() == 0 == phrases.merged(docs.limit(0), none).count()
