"""Exact neighbours: cells and bounds against all products."""

import numpy as np
import pytest

from polysema.operators import graph


def plain(names, x, k, digits=6):
    score = np.round(x @ x.T, digits) + 0.0
    out = set()
    for i, a in enumerate(names):
        best = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-score[i, j], names[j]))[:k]
        out |= {(a, names[j], score[i, j]) for j in best}
    return out


def table(kind, n=600, dims=8):
    r = np.random.default_rng(2)
    if kind == "even":
        x = r.standard_normal((n, dims))
    else:  # a third of all vectors in one point, the rest in clumps, some without length
        centre = r.standard_normal((12, dims))
        x = centre[r.integers(0, 12, n)] + 0.05 * r.standard_normal((n, dims))
        x[: n // 3] = centre[0]
        x[-9:] = 0
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return [f"w{i}" for i in range(n)], np.divide(x, length, out=np.zeros_like(x), where=length > 0)


@pytest.mark.parametrize("kind", ["even", "clumps"])
@pytest.mark.parametrize("few,block,cell", [(8192, 8192, 2048), (10, 8192, 40), (10, 30, 50)])
def test_nearest_words_equal_all_products(spark, monkeypatch, kind, few, block, cell):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "CELL", cell)
    names, x = table(kind)
    if block < 8192:
        names, x = names[::2], x[::2]
    df = spark.createDataFrame([(a, v.tolist()) for a, v in zip(names, x)], "word string, v array<double>")
    got = {tuple(r) for r in graph.nearest_words(df, 7).collect()}
    assert got == plain(names, x, 7)


def test_products_of_vectors_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 10)
    monkeypatch.setattr(graph, "CELL", 30)
    r = np.random.default_rng(4)
    x, q = r.standard_normal((300, 5)) * r.exponential(1, (300, 1)), r.standard_normal((40, 5)) * 3
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "word bigint, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query bigint, qv array<double>")
    score = np.round(q @ x.T, 6) + 0.0
    want = {(i, j, score[i, j]) for i in range(40) for j in sorted(range(300), key=lambda j: (-score[i, j], j))[:4]}
    assert {tuple(r) for r in graph.inner_products(queries, vectors, 4).collect()} == want
    assert graph.inner_products(queries, vectors.limit(0), 4).count() == 0 == graph.inner_products(queries.limit(0), vectors, 4).count()


def test_bounds_leave_out_most_of_clumped_vectors(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 50)
    r = np.random.default_rng(6)
    x = np.repeat(r.standard_normal((20, 12)), 40, axis=0) + 0.05 * r.standard_normal((800, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "word bigint, v array<double>")
    left_out = graph.skipped(df.selectExpr("word as query", "v as qv"), df, 5, others=True)
    assert left_out["units"] > 10 and left_out["query_units"] > 0.7
