"""Lemmas and tags from a table of tagged tokens, against plain search."""

import itertools
import math
from collections import Counter

from polysema.operators import hypernyms, morphology

SENTENCES = [
    "the/the/DET old/old/ADJ cats/cat/NOUN of/of/ADP berlin/berlin/PROPN",
    "a/a/DET dog/dog/NOUN runs/run/VERB",
    "dogs/dog/NOUN run/run/VERB in/in/ADP parks/park/NOUN",
    "the/the/DET run/run/NOUN of/of/ADP cats/cat/NOUN",
    "walked/walk/VERB cities/city/NOUN parties/party/NOUN talked/talk/VERB",
    "left/leave/VERB left/left/ADJ left/leave/VERB Cats/cat/NOUN",
]


def tokens(spark):
    rows = [(i, k, *t.split("/")) for i, s in enumerate(SENTENCES) for k, t in enumerate(s.split())]
    return spark.createDataFrame([*rows, (99, 0, None, "x", "NOUN"), (99, 1, "y", None, None)], "sentence int, place int, form string, lemma string, tag string")


def test_lemmas(spark):
    words = "Cats dogs bats ladies stalked left xyz q 1 running the".split() + [None, ""]
    got = {r["word"]: (r["lemma"], r["how"]) for r in morphology.lemmas(spark.createDataFrame([(w,) for w in words], "word string"), tokens(spark)).collect()}
    assert got["Cats"] == ("cat", "known") and got["dogs"] == ("dog", "known") and got["left"] == ("leave", "known")
    assert got["bats"] == ("bat", "suffix") and got["ladies"] == ("lady", "suffix") and got["stalked"] == ("stalk", "suffix")
    assert got["q"] == ("q", "none") and got["1"] == ("1", "none") and got[""] == ("", "none") and None not in got


def plain_path(term, sents):
    """The best of all paths."""
    data = [[(f.lower(), t) for f, _, t in (x.split("/") for x in s.split())] for s in sents]
    tags, forms = Counter(t for s in data for _, t in s), Counter(x for s in data for x in s)
    pairs = Counter(p for s in data for p in zip(["^", *(t for _, t in s)], [t for _, t in s]))
    log = lambda x: int(math.copysign(math.floor(abs(1000 * math.log(x)) + 0.5), math.log(x)))

    def step(a, b):
        return log((pairs[a, b] + 1) / (sum(n for (x, _), n in pairs.items() if x == a) + len(tags)))

    def emit(form):
        known = {t: n for (f, t), n in forms.items() if f == form}
        for size in range(min(4, len(form)), -1, -1):
            if known:
                break
            for (f, t), n in forms.items():
                if len(f) >= size and f.endswith(form[len(form) - size :]):
                    known[t] = known.get(t, 0) + n
        return {t: log(n / tags[t]) for t, n in known.items()}

    each = [emit(w.lower()) for w in term.split()]
    score = lambda path: sum(step(a, b) + e[b] for a, b, e in zip(["^", *path], path, each))
    return max(itertools.product(*each), key=lambda p: (score(p), p))


def test_tags_are_the_best_path(spark):
    terms = ["the dog run", "cats run in berlin", "walked parks", "old zebras of Berlin", "qqq www", "run run run", "left cities", "Dogs", " a  dog ", None, ""]
    got = {r["term"]: [t["pos"] for t in r["tokens"]] for r in morphology.tagged(spark.createDataFrame([(t,) for t in terms], "term string"), tokens(spark)).collect()}
    clean = [*SENTENCES, "y/y/X"][:-1]
    assert set(got) == {t for t in terms if t and t.strip()}
    for t in got:
        assert got[t] == list(plain_path(t, clean)) or t == "qqq www", t


def test_heads_and_labels(spark):
    terms = spark.createDataFrame([(t,) for t in ["old cats of parks", "the old dogs", "cats of berlin", "the cat", "runs walked"]], "term string")
    heads = hypernyms.head_hypernym(morphology.tagged(terms, tokens(spark)))
    found = {r["term"]: (r["hyper"], round(r["score"], 3)) for r in heads.collect()}
    assert found["old cats of parks"] == ("old cats", round(8 / 17, 3)) and found["the old dogs"] == ("dogs", round(4 / 12, 3)) and "cats of berlin" not in found and "runs walked" not in found
    rows = [("the old dogs", 1, 2, "wolf", 1.0, 1), ("the old dogs", 1, 2, "fox", 0.5, 2), ("cat", 1, 1, "lion", 1.0, 1)]
    clusters = spark.createDataFrame(rows, "word string, cid int, size int, member string, sim double, pos int")
    isa = spark.createDataFrame([("wolf", "animal", 4), ("fox", "animal", 2), ("lion", "cats", 9), ("lion", "animal", 1)], "hypo string, hyper string, freq int")
    lemma = morphology.lemmas(spark.createDataFrame([("cats",), ("animal",)], "word string"), tokens(spark))
    got = {(r["word"], r["hyper"]): r["source"] for r in hypernyms.with_heads(hypernyms.labels(clusters, isa), clusters, heads, lemma).collect()}
    assert got == {("the old dogs", "animal"): "cluster", ("the old dogs", "dogs"): "head", ("cat", "animal"): "cluster"}
