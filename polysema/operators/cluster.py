"""Clustering of ego networks by label propagation in a fixed order, and what is read off the clusters.

The nodes of an ego network are numbered in word order and begin with their own
numbers as labels. In each of SWEEPS rounds every node in turn takes the label
with the largest sum of edge weights among its neighbours, ties to the smallest
label. Integer weights make the sums exact, so results repeat on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polysema.tables import Scratch

SWEEPS = 20


def networks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row an ego: nodes array<struct<k, node, wq>> and adjacency array<array<struct<k, w>>>; an ego's
    network is bounded by its neighbour lists."""
    w = Window.partitionBy("ego").orderBy("node")
    numbered = nodes.withColumn("k", F.row_number().over(w))
    ends = edges.where("wq > 0").select("ego", F.col("a").alias("node"), F.col("b").alias("to"), "wq").unionAll(edges.where("wq > 0").select("ego", F.col("b").alias("node"), F.col("a").alias("to"), "wq"))
    number = numbered.select("ego", F.col("node").alias("to"), F.col("k").alias("to_k"))
    lists = ends.join(number, ["ego", "to"]).groupBy("ego", "node").agg(F.sort_array(F.collect_list(F.struct(F.col("to_k").alias("k"), F.col("wq").alias("w")))).alias("near"))
    none = F.array().cast("array<struct<k:int,w:int>>")
    rows = numbered.join(lists, ["ego", "node"], "left").withColumn("near", F.coalesce("near", none))
    packed = rows.groupBy("ego").agg(F.sort_array(F.collect_list(F.struct("k", "node", "wq", "near"))).alias("all"))
    return packed.select("ego", F.transform("all", lambda x: F.struct(x["k"].alias("k"), x["node"].alias("node"), x["wq"].alias("wq"))).alias("nodes"), F.transform("all", lambda x: x["near"]).alias("adjacency"))


def propagate(adjacency: list[list[tuple[int, int]]], sweeps: int = SWEEPS) -> list[int]:
    """Labels of the nodes 1..n; adjacency[i]: (neighbour, weight) of node i + 1."""
    label = list(range(1, len(adjacency) + 1))
    for _ in range(sweeps):
        changed = False
        for i, near in enumerate(adjacency):
            if near:
                sums: dict[int, int] = {}
                for k, w in near:
                    sums[label[k - 1]] = sums.get(label[k - 1], 0) + w
                best = min(sums, key=lambda x: (-sums[x], x))
                changed |= best != label[i]
                label[i] = best
        if not changed:  # a round without a change repeats for ever
            break
    return label


def label_propagation(nodes: DataFrame, edges: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """ego, node, wq, label of every node of every ego network; a map over networks in Arrow batches."""
    net = networks(nodes, edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = [propagate([[(e["k"], e["w"]) for e in near] for near in a], sweeps) for a in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.list_(pa.int32()))], ["ego", "nodes", "labels"])

    kind = {f.name: f.dataType.simpleString() for f in net.schema}
    labelled = net.mapInArrow(run, f"ego {kind['ego']}, nodes {kind['nodes']}, labels array<int>")
    each = labelled.select("ego", F.explode(F.arrays_zip("nodes", "labels")).alias("x"))
    return each.select("ego", "x.nodes.node", "x.nodes.wq", F.col("x.labels").alias("label"))


def emitted(labelled: DataFrame) -> DataFrame:
    """word, cid, size, member, sim, pos: clusters numbered by size (ties: smaller label), members by weight and word, both falling."""
    sizes = labelled.groupBy("ego", "label").agg(F.count(F.lit(1)).alias("size"))
    rank = sizes.withColumn("cid", F.row_number().over(Window.partitionBy("ego").orderBy(F.desc("size"), "label")))
    pos = F.row_number().over(Window.partitionBy("ego", "label").orderBy(F.desc("wq"), F.desc("node")))
    return labelled.withColumn("pos", pos).join(rank, ["ego", "label"]).select(F.col("ego").alias("word"), "cid", "size", F.col("node").alias("member"), (F.col("wq") / 10000).alias("sim"), "pos")


def folded(clusters: DataFrame) -> DataFrame:
    """word, cid, cluster array<struct<word, sim, pos>>: one row a sense, as the text format has it."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col("member").alias("word"), "sim")))
    one = clusters.groupBy("word", "cid").agg(rows.alias("c"))
    return one.select("word", "cid", F.transform("c", lambda x: F.struct(x["word"].alias("word"), x["sim"].alias("sim"), x["pos"].alias("pos"))).alias("cluster"))


def unfolded(senses: DataFrame) -> DataFrame:
    return senses.select("word", "cid", F.size("cluster").alias("size"), F.explode("cluster").alias("x")).select("word", "cid", "size", F.col("x.word").alias("member"), F.col("x.sim").alias("sim"), F.col("x.pos").alias("pos"))


def at_least(clusters: DataFrame, size: int) -> DataFrame:
    return clusters.where(F.col("size") >= size)


def sense_statistics(clusters: DataFrame, size: int) -> DataFrame:
    """One row: senses and words kept, their share, mean, standard deviation and median of senses a word."""
    from polysema.operators.evaluate import quantile

    senses = Scratch(clusters.sparkSession, "senses").keep(clusters.select("word", "cid", "size").distinct(), "senses")
    per_word = senses.where(F.col("size") >= size).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kept = per_word.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("senses_kept"), F.round(F.avg("n"), 6).alias("mean_senses"), F.round(F.stddev_pop("n"), 6).alias("std_senses"), F.lit(quantile(per_word, "n", 0.5)).cast("double").alias("median_senses"))
    return kept.crossJoin(F.broadcast(senses.agg(F.count(F.lit(1)).alias("senses")))).select("*", F.round(100 * F.col("senses_kept") / F.col("senses"), 4).alias("kept_percent"))  # one row each


def closed(senses: DataFrame, least: int = 5) -> DataFrame:
    """senses: word, cid, cluster. Without the members marked ?; kept says whether enough members are left."""
    left = F.filter("cluster", lambda x: ~x["word"].contains("?"))
    return senses.withColumn("cluster", left).withColumn("kept", F.size("cluster") >= least)


def anti_pairs(vectors: DataFrame, near: DataFrame) -> DataFrame:
    """ego, a, b (a < b) of words that stand for different senses of the ego.

    For each neighbour t of the ego the word u nearest to ego - t is sought, by
    cos(ego, u) - cos(t, u); {t, u} is a pair if u has the form of a neighbour.
    vectors: word, v. near: src, dst."""
    from polysema.operators import apart

    return apart.pairs(vectors, near)


def strongest(near: DataFrame, n: int) -> DataFrame:
    """near: src, dst, weight. Each word's n strongest edges (ties: smaller word), as the search itself would give them."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def anti_nodes(pairs: DataFrame) -> DataFrame:
    """ego, node, n: the words of an ego's pairs and in how many they are."""
    return pairs.select("ego", F.explode(F.array("a", "b")).alias("node")).groupBy("ego", "node").agg(F.count(F.lit(1)).alias("n"))


def anti_clusters(pairs: DataFrame, near: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """ego, node, n, label: clusters of the pairs' words over neighbour edges that are not pairs themselves.

    near: src, dst, wq with as many neighbours of each word as edges are to be used."""
    from polysema.operators import ego

    pairs = Scratch(pairs.sparkSession, "apart").keep(pairs, "pairs")  # nodes and what is no edge
    nodes = anti_nodes(pairs).select("ego", "node", F.col("n").cast("int").alias("wq"))
    return ego.label_propagation(nodes, near, None, sweeps, pairs).withColumnRenamed("wq", "n")


def anti_inventory(labelled: DataFrame) -> DataFrame:
    """word, cid, keyword, cluster: one row a sense; the keyword is the member of the most pairs (ties: larger word)."""
    one = labelled.groupBy("ego", "label").agg(F.max(F.struct("n", "node"))["node"].alias("keyword"), F.sort_array(F.collect_list("node")).alias("cluster"))
    return one.select(F.col("ego").alias("word"), F.col("label").alias("cid"), "keyword", "cluster")
