"""Pairs of different senses against loops over all words, and what the search leaves in the shared folder."""

import os

import numpy as np
import pytest

from polysema.operators import apart, cluster, graph
from polysema.operators.streams import Best
from polysema.tables import shared_dir


def size_of(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs if f.endswith(".parquet"))


def test_search_keeps_no_copies_of_queries(spark, monkeypatch):
    """Each query met units that it needs as a copy of its vector: as many tables as units."""
    monkeypatch.setattr(graph, "FEW", 10)
    monkeypatch.setattr(graph, "CELL", 50)
    x = np.random.default_rng(1).standard_normal((1000, 24))
    df = spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(x)], "word string, v array<double>")
    before = size_of(shared_dir(spark))
    assert graph.nearest_words(df, 20).count() == 20_000
    assert size_of(shared_dir(spark)) - before < 4 * x.nbytes


@pytest.mark.parametrize("parts", [1, 3])
def test_pairs_equal_loops(spark, monkeypatch, parts):
    monkeypatch.setattr(apart, "FEWEST", 1 << 30 if parts == 1 else 1)
    monkeypatch.setattr(apart, "PARTS", parts)
    monkeypatch.setattr(apart, "PRODUCTS", 1000)
    r = np.random.default_rng(3)
    x = np.round(r.standard_normal((90, 4)), 1)
    x[7:12] = x[3]  # equal scores
    x[20] = 0
    names = [f"w{i}{'w' if i % 2 else 'W'}" for i in range(90)]
    forms = [n.lower() for n in names]
    length = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    near = {i: r.choice([j for j in range(90) if j != i], 30, replace=False).tolist() for i in range(90)}
    want = set()
    for e, ts in near.items():
        for t in ts:
            s = np.round(u @ (u[e] - u[t]), 6) + 0.0
            best = min((j for j in range(90) if j not in (e, t)), key=lambda j: (-s[j], names[j]))
            if forms[best] in {forms[j] for j in ts}:
                want.add((names[e], *sorted((names[t], names[best]))))
    vectors = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x)], "word string, v array<double>")
    edges = spark.createDataFrame([(names[e], names[t]) for e, ts in near.items() for t in ts] + [(names[0], "unknown"), ("nobody", names[0])], "src string, dst string")
    got = [tuple(x) for x in cluster.anti_pairs(vectors, edges).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    assert cluster.anti_pairs(vectors.limit(0), edges).count() == 0 == cluster.anti_pairs(vectors, edges.limit(0)).count()


def test_best_of_passing_blocks():
    r = np.random.default_rng(5)
    q, m = r.standard_normal((40, 6)), np.round(r.standard_normal((500, 6)))
    m[100:300] = m[5]
    s = np.round(q @ m.T, 3) + 0.0
    for scale in (1.0, 1e16):  # beyond single precision
        best = Best(q / scale, np.full(40, -np.inf), 7, 3)
        for at in range(0, 500, 90):
            best.add(m[at : at + 90] * scale)
        found = [[] for _ in q]
        for rows in best.rows(at_once=10):
            for i, j, _ in zip(*rows):
                found[i].append(j)
        assert found == [sorted(range(500), key=lambda j: (-s[i, j], j))[:7] for i in range(40)]
