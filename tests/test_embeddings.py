"""Word vectors: the update against plain loops, independence of cores, and what a planted corpus teaches."""

import random

import numpy as np
import pytest

from polysema.operators import embeddings
from polysema.plans.training import Settings, train


def plain_step(inner, outer, context, target, negatives, rate):
    """The update of one example, word by word."""
    mean = sum(inner[c] for c in context) / len(context)
    back = np.zeros_like(mean)
    changes = []
    for word, label in [(target, 1.0), *((n, 0.0) for n in negatives if n != target)]:
        gain = (label - 1 / (1 + np.exp(-mean @ outer[word]))) * rate
        back += gain * outer[word]
        changes.append((word, gain * mean))
    for word, x in changes:
        outer[word] += x
    for c in context:
        inner[c] += back


@pytest.mark.parametrize("cbow", [True, False])
def test_part_equals_plain_loops(monkeypatch, cbow):
    monkeypatch.setattr(embeddings, "BATCH", 1)
    monkeypatch.setattr(embeddings, "THIN", 1e9)
    draw = np.random.default_rng(3)
    sentences = [draw.integers(-1, 9, n) for n in (12, 1, 0, 7, 30)]
    inner, outer = draw.standard_normal((9, 5)), draw.standard_normal((9, 5))
    want = inner.copy(), outer.copy()
    noise, share = np.arange(9), np.full(9, 1 / 9)
    changed = embeddings.train_part(sentences, inner, outer, share, noise, 3, cbow, (0.05, 0.01), np.random.default_rng(8))

    again = np.random.default_rng(8)  # the same draws, in the same order
    flat = [(s, w) for s, ws in enumerate(sentences) for w in ws if w >= 0]
    again.random(len(flat))
    reach = again.integers(1, 4, len(flat))
    pairs = []
    for i, (s, w) in enumerate(flat):
        context = [flat[j][1] for j in range(max(0, i - reach[i]), min(len(flat), i + reach[i] + 1)) if j != i and flat[j][0] == s]
        pairs += [(w, context)] if cbow and context else [] if cbow else [(w, [c]) for c in context]
    negatives = noise[again.integers(0, 9, (len(pairs), embeddings.NEGATIVES))]
    counts = np.zeros(9, int)
    for k, (w, context) in enumerate(pairs):
        plain_step(*want, context, w, negatives[k], 0.05 - 0.04 * k / len(pairs))
        for c in context:
            counts[c] += 1
    assert np.allclose(inner, want[0]) and np.allclose(outer, want[1]) and (changed[0] == counts).all()


def planted(n, seed=5):
    """Words of two topics; inside a topic, pairs that stand in the same places."""
    draw = random.Random(seed)
    topics = [("red blue green lila gray pink".split(), "paint wall brush room".split()), ("cat dog cow pig hen fox".split(), "farm food barn milk".split())]
    rows = []
    for k in range(n):
        names, around = topics[k % 2]
        rows.append((k, " ".join(draw.choice(around if j % 2 else names) for j in range(12))))
    return rows


@pytest.mark.parametrize("cbow", [True, False])
def test_planted_topics(spark, cbow):
    docs = spark.createDataFrame(planted(3000), "doc_id bigint, text string")
    got = {r["word"]: np.array(r["v"]) for r in embeddings.word_vectors(docs, 16, 3, 6, 5, cbow, part_tokens=12_000).collect()}
    unit = {w: v / np.linalg.norm(v) for w, v in got.items()}
    near = lambda w: sorted((x for x in unit if x != w), key=lambda x: -unit[w] @ unit[x])[:5]
    for names in ("red blue green lila gray pink", "cat dog cow pig hen fox"):
        for w in names.split():
            assert set(near(w)) <= {*names.split(), *("paint wall brush room" if "red" in names else "farm food barn milk").split()}, (w, near(w))
    with_ = np.mean([unit[a] @ unit[b] for a in ("red", "cat") for b in ({"red": "blue", "cat": "dog"}[a],)])
    across = np.mean([unit["red"] @ unit["cat"], unit["blue"] @ unit["cow"]])
    assert with_ > across + 0.3


def test_vectors_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(planted(300), "doc_id bigint, text string")
    found = []
    for n, shuffles in ((1, "1"), (7, "5")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        rows = embeddings.word_vectors(docs.repartition(n), 8, 2, 2, 5, part_tokens=900).collect()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        found.append(sorted((r["word"], tuple(r["v"])) for r in rows))
    assert found[0] == found[1] and len(found[0]) == 20


def test_edges_of_the_corpus(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alone"), (4, "a b " * 9000)], "doc_id bigint, text string")
    got = {r["word"]: r["v"] for r in embeddings.word_vectors(docs, 4, 2, 1, 2).collect()}
    assert set(got) == {"a", "b"} and np.isfinite([*got.values()]).all()
    assert embeddings.word_vectors(docs.limit(0), 4, 2, 1, 2).count() == 0


@pytest.mark.parametrize("cbow", [True, False])
def test_training_takes_either_model(spark, tmp_path, cbow):
    docs = spark.createDataFrame(planted(300), "doc_id bigint, text string")
    out = train(spark, str(tmp_path), docs, settings=Settings(size=8, window=2, iterations=1, min_count=5, neighbours=5, edges=5, min_size=1, cbow=cbow))
    assert out["vectors"].count() == 20 and out["priors"].count() > 0
