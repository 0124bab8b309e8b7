"""Packed ego networks against joins over all edges, and planted senses at the training command's sizes."""

import random

import numpy as np
import pytest

from polysema.operators import cluster, ego, graph
from polysema.plans.training import Settings, train


def drawn(seed, words=40, degree=9):
    r = random.Random(seed)
    names = [f"w{k}x" for k in range(words - 4)] + ["é", "W3x ", "new_w5x", "w5x_old"]
    return [(a, b, r.choice([-5, 0, 10, 10, 20, 3000])) for a in names for b in r.sample([x for x in names if x != a], degree)]


@pytest.mark.parametrize("n", [2, 5, 100])
def test_equal_to_joins(spark, n):
    g = spark.createDataFrame(drawn(n), "src string, dst string, wq int")
    words = g.selectExpr("src as word").unionAll(g.selectExpr("dst")).distinct()
    nodes = graph.ego_nodes(g, graph.substring_nodes(words, words)).cache()
    edges = graph.ego_edges(nodes, g, n)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ego.ego_edges(nodes, g, n)) == rows(edges) and edges.count() > 50
    assert rows(ego.label_propagation(nodes, g, n)) == rows(cluster.label_propagation(nodes, edges).select("ego", "node", "wq", "label"))
    assert ego.label_propagation(nodes.limit(0), g, n).count() == 0
    alone = ego.label_propagation(nodes, g.limit(0), n)  # no edges: every node is its own cluster
    assert alone.count() == nodes.count() and alone.groupBy("ego", "label").count().where("count > 1").isEmpty()


def test_propagation_equals_loops():
    r = random.Random(7)
    for _ in range(200):
        m = r.randint(1, 12)
        pairs = {(a, b): r.randint(1, 4) for a in range(m) for b in range(a + 1, m) if r.random() < 0.4}
        lists = [[] for _ in range(m)]
        for (a, b), w in pairs.items():
            lists[a].append((b + 1, w))
            lists[b].append((a + 1, w))
        found = ego.propagate(m, tuple(np.array(x, int) for x in ([a for a, _ in pairs], [b for _, b in pairs], list(pairs.values()))))
        assert found.tolist() == cluster.propagate(lists)


def planted(topics=4, words=60, dims=24):
    """Words of topics far apart, and words that stand between two topics each: those have two senses."""
    r = np.random.default_rng(1)
    centre = np.linalg.qr(r.standard_normal((dims, dims)))[0][:topics]
    rows = [(f"t{t}w{k}a", centre[t] + 0.05 * r.standard_normal(dims)) for t in range(topics) for k in range(words)]
    rows += [(f"both{a}and{b}z", centre[a] + centre[b] + 0.02 * r.standard_normal(dims)) for a in range(topics) for b in range(a)]
    return [(w, v.tolist()) for w, v in rows]


def test_planted_senses_at_full_sizes(spark, tmp_path):
    """200 neighbours, 200 edges, clusters of 5: with topics of 60 words a word's neighbours reach into other topics, and the
    edges inside keep the topics apart."""
    df = spark.createDataFrame(planted(), "word string, v array<double>")
    s = Settings(substrings=False)
    near = graph.nearest_words(df, s.neighbours)
    g = graph.quantised(near.where("weight > 0.3")).cache()
    found = cluster.at_least(cluster.emitted(ego.label_propagation(graph.ego_nodes(g), g, s.edges)), s.min_size).collect()
    senses = {}
    for r in found:
        senses.setdefault(r["word"], {}).setdefault(r["cid"], set()).add(r["member"][:2])
    for w, of in senses.items():
        topics = [t - {"bo"} for t in of.values()]
        if w.startswith("both"):
            assert sorted(map(sorted, topics)) == sorted([[f"t{w[4]}"], [f"t{w[8]}"]]), (w, topics)
        else:
            assert topics[0] == {w[:2]}


def test_neighbours_only_have_networks_of_multiword_nodes(spark, tmp_path):
    """'new' is nobody's source, but two multiword nodes begin with it."""
    r = np.random.default_rng(3)
    docs = [(k, " ".join(r.choice(["new_york", "new_age", "old", "red", "blue", "tea"], 12))) for k in range(200)]
    out = train(spark, str(tmp_path), spark.createDataFrame(docs, "doc_id bigint, text string"), settings=Settings(size=6, window=2, iterations=1, min_count=2, neighbours=3, edges=3, min_size=1))
    assert out["graph"].count() > 0
    g = spark.createDataFrame([("new_york", "new", 5000), ("new_age", "new", 4000), ("new_york", "new_age", 900)], "src string, dst string, wq int")
    words = g.selectExpr("src as word").unionAll(g.selectExpr("dst")).distinct()
    nodes = graph.ego_nodes(g, graph.substring_nodes(words, words))
    assert {(x["ego"], x["node"]) for x in ego.label_propagation(nodes, g, 9).where("ego = 'new'").collect()} == {("new", "new_york"), ("new", "new_age")}
