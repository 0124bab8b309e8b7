"""The chain at the training command's sizes against brute force on a small table."""

import numpy as np

from polysema.plans import catalogue

M = 260


def test_full_sizes_and_the_rank_of_edges(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((M, 6)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = catalogue.queries()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6) + 0.0
    near = {i: sorted((j for j in range(M) if j != i), key=lambda j: (-s[i, j], f"w{j}w"))[:200] for i in range(M)}
    got = {(r["src"], r["dst"]) for r in q["knn_graph_full"](spark, str(tmp_path)).collect()}
    assert got == {(f"w{i}w", f"w{j}w") for i, js in near.items() for j in js}
    wq = {(r["src"], r["dst"]): r["wq"] for r in q["quantised_graph_full"](spark, str(tmp_path)).where("wq > 0").collect()}
    nodes = {r["node"] for r in q["ego_nodes_full"](spark, str(tmp_path)).where("ego = 'w7w'").collect()}
    want, whole = set(), set()
    for a in nodes:
        inside = sorted((b for b in nodes if (a, b) in wq), key=lambda b: (wq[a, b], b), reverse=True)
        want |= {(min(a, b), max(a, b)) for b in inside[:50]}
        whole |= {(min(a, b), max(a, b)) for b in inside}
    edges = lambda name: {(r["a"], r["b"]) for r in q[name](spark, str(tmp_path)).where("ego = 'w7w'").collect()}
    assert edges("ego_edges_strongest") == want < whole == edges("ego_edges_full")
    assert catalogue._SIZES.get() == catalogue.Sizes()


def test_kept_table_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from polysema.tables import CLEANUP, Scratch

    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in found.split("\n") if "shuffle_" in x}

    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    df = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    kept = Scratch(spark, "sizes").keep(df)
    assert not shuffled() - before and spark.conf.get(CLEANUP, None) == setting
    assert kept.count() == df.count() == 7
