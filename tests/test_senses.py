import random

from polysema.operators import cluster, evaluate, graph, senses, wsd
from polysema.sources import readers, writers


def vectors(spark, n=30, d=5, seed=3):
    r = random.Random(seed)
    return spark.createDataFrame([(f"w{i}w", [r.gauss(0, 1) for _ in range(d)]) for i in range(n)], "word string, v array<double>")


def test_nearest_words_against_all_pairs(spark):
    v = vectors(spark)
    rows = {r["word"]: r["v"] for r in v.collect()}
    norm = lambda x: sum(a * a for a in x) ** 0.5
    want = set()
    for a, x in rows.items():
        s = sorted((-round(sum(p * q for p, q in zip(x, y)) / norm(x) / norm(y), 6), b) for b, y in rows.items() if b != a)[:4]
        want |= {(a, b, -w) for w, b in s}
    assert {tuple(r) for r in graph.nearest_words(v, 4).collect()} == want


def test_duplicate_vector_is_a_neighbour(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "word string, v array<double>")
    assert {(r["src"], r["dst"]) for r in graph.nearest_words(v, 1).collect()} == {("a", "b"), ("b", "a"), ("c", "a")}


def test_substring_nodes(spark):
    words = spark.createDataFrame([("york",), ("new",), ("new_york",), ("big_new_york",)], "word string")
    got = {tuple(r) for r in graph.substring_nodes(words, words).collect()}
    assert got == {("new", "new_york"), ("york", "new_york"), ("york", "big_new_york"), ("new_york", "big_new_york")}


def test_propagation_labels_partition_the_nodes():
    two = [[(2, 5)], [(1, 5)], [(4, 7)], [(3, 7)], []]
    label = cluster.propagate(two)
    assert label[0] == label[1] and label[2] == label[3] and label[0] != label[2] and label[4] == 5


def test_priors_sum_to_one_and_filter_is_a_subset(spark):
    v = vectors(spark)
    g = graph.quantised(graph.nearest_words(v, 6))
    nodes = graph.ego_nodes(g)
    all_ = cluster.emitted(cluster.label_propagation(nodes, graph.ego_edges(nodes, g, 6))).cache()
    kept = cluster.at_least(all_, 2)
    assert kept.exceptAll(all_).isEmpty()
    total = {r["word"]: r["t"] for r in senses.priors(all_).groupBy("word").sum("prob").withColumnRenamed("sum(prob)", "t").collect()}
    assert all(abs(t - 1) < 1e-9 for t in total.values())


def test_disambiguate_fallbacks(spark):
    i = spark.createDataFrame([(1, "bank"), (2, "bank"), (3, "nothing")], "ctx_id bigint, target string")
    inv = spark.createDataFrame([("bank", 1, 0.7, [1.0, 0.0]), ("bank", 2, 0.3, [0.0, 1.0])], "word string, cid int, prob double, v array<double>")
    vec = spark.createDataFrame([("river", [0.1, 0.9]), ("money", [0.9, 0.1])], "word string, v array<double>")
    ctx = spark.createDataFrame([(1, "river")], "ctx_id bigint, word string")
    got = {r["ctx_id"]: (r["cid"], r["how"]) for r in wsd.disambiguate(i, ctx, inv, vec).collect()}
    assert got == {1: (2, "context"), 2: (1, "prior"), 3: (0, "none")}


def test_context_window(spark):
    i = wsd.located(spark.createDataFrame([(1, "a b c bank d e f", "bank"), (2, "a b", "zzz")], "ctx_id bigint, context string, target string"))
    voc = spark.createDataFrame([(w,) for w in "abcdef"], "word string")
    stop = spark.createDataFrame([("c",)], "word string")
    got = wsd.context_words(i, voc, 2, stop).collect()
    assert {r["word"] for r in got if r["ctx_id"] == 1} == {"b", "d", "e"} and {r["word"] for r in got if r["ctx_id"] == 2} == {"a", "b"}


def test_mcnemar_without_difference(spark):
    r = evaluate.mcnemar(spark.createDataFrame([(True, True)], "a boolean, b boolean"), "a", "b").first()
    assert (r["b"], r["c"], r["p"]) == (0, 0, None)


def test_formats_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [0.0, 2.0])], "word string, v array<float>")
    writers.word2vec(v, f"{tmp_path}/v")
    assert {(r["word"], tuple(r["v"])) for r in readers.word2vec_text(spark, f"{tmp_path}/v").collect()} == {("a", (1.0, 0.5)), ("b", (0.0, 2.0))}
    assert {r["word"] for r in readers.word2vec_vocabulary(spark, f"{tmp_path}/v").collect()} == {"a", "b"}
    c = spark.createDataFrame([("x", 1, [("y", 0.5, 1), ("z", 0.25, 2)])], "word string, cid int, cluster array<struct<word:string,sim:double,pos:int>>")
    writers.clusters(c, f"{tmp_path}/c")
    r = readers.clusters(spark, f"{tmp_path}/c").first()
    assert (r["word"], r["cid"]) == ("x", "1") and [tuple(x) for x in r["cluster"]] == [("y", 0.5, 1), ("z", 0.25, 2)]
    e = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, weight double")
    writers.edges(e, f"{tmp_path}/e")
    assert [tuple(r) for r in readers.edges(spark, f"{tmp_path}/e").collect()] == [("a", "b", 0.5)]
    p = spark.createDataFrame([("c#", 1, 0.25)], "word string, cid int, prob double")
    writers.inventory(p, f"{tmp_path}/p")
    assert [tuple(r) for r in readers.inventory(spark, f"{tmp_path}/p").collect()] == [("c#", "1", 0.25)]
    missing = readers.inventory(spark, f"{tmp_path}/none", spark.createDataFrame([("a#1",), ("a##1",)], "sense string"))
    assert [tuple(r) for r in missing.collect()] == [("a", "1", 1.0)]


def test_closure(spark):
    c = spark.createDataFrame([("x", 1, [("y?", 0.5, 1), ("z", 0.25, 2)])], "word string, cid int, cluster array<struct<word:string,sim:double,pos:int>>")
    writers_in = cluster.closed(c, 1).first()
    assert writers_in["kept"] and [x["word"] for x in writers_in["cluster"]] == ["z"]


def test_compound_fallback(spark):
    """A compound's known parts have the weight over the number of all its parts; what follows # is cut off first."""
    v = spark.createDataFrame([("york", [1.0]), ("cat", [1.0])], "word string, v array<double>")
    rows = [("a", 1, "new_york_station", 1, 1.0), ("a", 1, "new_york_station#NN", 2, 1.0), ("a", 1, "cat#1", 3, 1.0), ("a", 1, "cat_york", 4, 1.0)]
    got = senses.looked_up(spark.createDataFrame(rows, "word string, cid int, member string, pos int, weight double"), v).collect()
    assert sorted((r["pos"], r["key"], round(r["weight"], 4)) for r in got) == [(1, "york", 0.3333), (2, "york", 0.3333), (3, "cat", 1.0), (4, "york", 0.5)]


def test_string_sense_ids_and_case(spark):
    i = spark.createDataFrame([(1, "bank"), (2, "zzz")], "ctx_id bigint, target string")
    inv = spark.createDataFrame([("bank", "river", 0.5, [1.0, 0.0]), ("Bank", "river", 0.5, [0.0, 1.0])], "word string, cid string, prob double, v array<double>")
    vec = spark.createDataFrame([("x", [0.1, 0.9])], "word string, v array<double>")
    got = {r["ctx_id"]: (r["cid"], r["sense"], r["how"]) for r in wsd.disambiguate(i, spark.createDataFrame([(1, "x")], "ctx_id bigint, word string"), inv, vec, ignore_case=True).collect()}
    assert got == {1: ("river", "Bank#river", "context"), 2: ("0", "zzz#0", "none")}


def test_prediction_from_a_test_set(spark):
    test = spark.createDataFrame([("1", "bank", "4,8", "1", None, "the bank x"), ("2", "bank", None, "2", None, "a bank y"), ("3", "cow", "0,3", "1", None, "cow x")], "context_id string, target string, target_position string, gold_sense_ids string, predict_sense_ids string, context string")
    inv = spark.createDataFrame([("bank", "1", 0.5, [1.0, 0.0]), ("bank", "2", 0.5, [0.0, 1.0])], "word string, cid string, prob double, v array<double>")
    vec = spark.createDataFrame([("x", [0.9, 0.1]), ("y", [0.1, 0.9])], "word string, v array<double>")
    got = wsd.predicted(test, inv, vec)
    assert got.columns == test.columns and {r["context_id"]: r["predict_sense_ids"] for r in got.collect()} == {"1": "1", "2": "2", "3": "0"}
    assert tuple(wsd.accuracy(got).first()) == (3, 2, 0.666667)


def test_vectors_of_one_dimension(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.5])], "word string, v array<float>")
    writers.word2vec(v, f"{tmp_path}/v")
    assert {(r["word"], tuple(r["v"])) for r in readers.word2vec_text(spark, f"{tmp_path}/v").collect()} == {("a", (1.0,)), ("b", (2.5,))}
    assert {r["word"] for r in readers.word2vec_vocabulary(spark, f"{tmp_path}/v").collect()} == {"a", "b"}


def test_access_to_clusters_and_sparse_senses(spark):
    from polysema.operators import senses, sparse

    members = spark.createDataFrame([("bank", 1, "river", 1.0), ("bank", 1, "12 3", 0.5), ("bank", 2, "money", 0.7)], "word string, cid int, member string, sim double")
    asked = spark.createDataFrame([("bank", "2"), ("bank", "9"), ("x", "1")], "word string, cid string")
    assert {(r["word"], r["cid"], r["member"]) for r in senses.cluster_of(asked, members).collect()} == {("bank", "2", "money"), ("bank", "9", None), ("x", "1", None)}
    folded = spark.createDataFrame([("bank", 1, [("river", 1.0), ("12 3", 0.5)]), ("bank", 2, [("money", 0.7)])], "word string, cid int, cluster array<struct<word string, sim double>>")
    prior = spark.createDataFrame([("bank", 1, 0.8), ("bank", 2, 0.2)], "word string, cid int, prob double")
    full = senses.senses_full(spark.createDataFrame([("bank",), ("none",)], "word string"), folded, prior, 0.5).collect()
    assert [(r["cid"], [m["word"] for m in r["cluster"]]) for r in full] == [(1, ["river"])]
    s = spark.createDataFrame([("a", 1, "f", 3.0), ("a", 1, "g", 4.0), ("a", 2, "f", 2.0), ("b", 1, "h", 5.0)], "word string, cid int, feature string, score double")
    pairs = spark.createDataFrame([("a", 1, "a", 2), ("a", 1, "b", 1), ("a", 1, "a", 7)], "w1 string, c1 int, w2 string, c2 int")
    assert {(r["w2"], r["c2"]): r["sim"] for r in sparse.sense_similarity(pairs, s).collect()} == {("a", 2): 0.6, ("b", 1): 0.0, ("a", 7): 0.0}
    words = spark.createDataFrame([("a", "f", 2.0)], "word string, feature string, score double")
    mixed = {(r["word"], r["cid"], r["feature"]): r["score"] for r in sparse.with_word(s, words).collect()}
    assert mixed == {("a", 1, "f"): 0.8, ("a", 1, "g"): 0.4, ("a", 2, "f"): 1.0, ("b", 1, "h"): 5.0}
