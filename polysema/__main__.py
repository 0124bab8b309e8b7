"""Command line: ``python -m polysema COMMAND ...`` (or spark-submit with this file). Every command reads and writes folders of files."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.functions import treebank
from polysema.operators import cluster, corpus, evaluate, graph, hypernyms, senses, wsd
from polysema.plans.training import Settings, closure, kept, train
from polysema.sources import readers, writers


def train_(spark: SparkSession, a: argparse.Namespace) -> None:
    """Vectors, graph, clusters, inventory and sense vectors of a corpus or of given vectors."""
    s = Settings(a.size, a.window, a.iterations, a.min_count, a.neighbours, a.edges, a.min_size, weight=a.weight, bigrams=a.bigrams, threshold=a.threshold, cbow=a.cbow != 0)
    docs = readers.corpus(spark, a.corpus).select(F.xxhash64("text").alias("doc_id"), "text") if a.corpus else None
    vectors = readers.word2vec_text(spark, a.vectors) if a.vectors else None
    phrases = readers.phrases(spark, a.phrases) if a.phrases else None
    isa = hypernyms.relations(readers.relations(spark, a.relations)) if a.relations else None
    out = train(spark, f"{a.out}/tables", docs, vectors, s, phrases, isa)
    writers.edges(out["near"], f"{a.out}/graph")
    writers.clusters(cluster.folded(out["clusters"]), f"{a.out}/clusters")
    writers.inventory(out["priors"], f"{a.out}/inventory")
    writers.word2vec(_by_sense(out["sense_vectors"]), f"{a.out}/sense_vectors")
    if isa is not None:
        writers.disambiguated(out["disambiguated"], f"{a.out}/disambiguated")
        writers.closure(out["closure"], f"{a.out}/closure")


def _by_sense(rows: DataFrame) -> DataFrame:
    return rows.select(X.sense_id(F.col("word"), F.col("cid")).alias("word"), "v")


def _clusters(spark: SparkSession, path: str) -> DataFrame:
    return cluster.unfolded(readers.clusters(spark, path))


def sense_vectors(spark: SparkSession, a: argparse.Namespace) -> None:
    """Priors and pooled vectors of given clusters."""
    c = _clusters(spark, a.clusters)
    writers.inventory(senses.priors(c), f"{a.out}/inventory")
    writers.word2vec(_by_sense(senses.pooled(c, readers.word2vec_text(spark, a.vectors), a.weight)), f"{a.out}/sense_vectors")


def filter_clusters(spark: SparkSession, a: argparse.Namespace) -> None:
    """Clusters of at least a size."""
    writers.clusters(cluster.folded(cluster.at_least(_clusters(spark, a.clusters), a.min_size)), a.out)


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    """A test set with its senses filled in; the accuracy is printed."""
    s = readers.word2vec_text(spark, a.sense_vectors).withColumn("s", X.parse_sense(F.col("word"))).select("s.word", "s.cid", "v")
    inv = senses.inventory(readers.inventory(spark, a.inventory), s)
    test = readers.wsd_set(spark, a.test).drop("start", "end")
    stop = None
    if a.stop_language:
        words = spark.createDataFrame([(w,) for w in X.stop_words(a.stop_language)], "word string")
        stop = words.select(F.explode(X.stop_variants(F.col("word"))).alias("word")).distinct()
    writers.predictions(wsd.predicted(test, inv, readers.word2vec_text(spark, a.vectors), a.window, stop, a.method, a.most, a.ignore_case), a.out)
    wsd.accuracy(readers.wsd_set(spark, a.out)).show(truncate=False)


def label(spark: SparkSession, a: argparse.Namespace) -> None:
    """Members by their senses, closure, and hypernym labels of given clusters."""
    c = _clusters(spark, a.clusters)
    members = kept(spark, f"{a.out}/tables/members", lambda: hypernyms.disambiguated_members(c))
    writers.disambiguated(members, f"{a.out}/disambiguated")
    writers.closure(closure(members, a.min_size), f"{a.out}/closure")
    hypernyms.labels(c, hypernyms.relations(readers.relations(spark, a.relations), a.min_freq)).write.parquet(f"{a.out}/labels")


def anti(spark: SparkSession, a: argparse.Namespace) -> None:
    """Inventories of anti-edge induction, one for each number of neighbours over one table of the largest."""
    vectors = readers.word2vec_text(spark, a.vectors)
    near = kept(spark, f"{a.out}/tables/near", lambda: graph.nearest_words(vectors, max(a.top)))
    for n in a.top:
        top = cluster.strongest(near, n)
        pairs = kept(spark, f"{a.out}/tables/pairs-{n}", lambda: cluster.anti_pairs(vectors, top))
        writers.keyword_inventory(cluster.anti_inventory(cluster.anti_clusters(pairs, graph.quantised(top))), f"{a.out}/top{n}")


def preprocess(spark: SparkSession, a: argparse.Namespace) -> None:
    """A corpus with a space between all tokens (tree-bank words), line by line."""
    writers.tokenised(readers.corpus(spark, a.corpus).select(treebank.word_tokenize(F.col("text")).alias("tokens")), a.out, gzip=False)


def frequencies(spark: SparkSession, a: argparse.Namespace) -> None:
    """Words of a corpus that occur often enough, the most frequent first."""
    writers.frequencies(corpus.term_frequencies(corpus.tokens(readers.corpus(spark, a.corpus)), a.least), a.out)


def similarity(spark: SparkSession, a: argparse.Namespace) -> None:
    """The largest similarity over the senses of each pair of the lists, and its rank correlation with their scores."""
    s = readers.word2vec_text(spark, a.sense_vectors).withColumn("s", X.parse_sense(F.col("word"))).select("s.word", "s.cid", "v")
    pairs = reduce(DataFrame.unionAll, [readers.word_pairs(spark, p) for p in a.pairs]).select(F.col("word1").alias("w1"), F.col("word2").alias("w2"), "score").dropDuplicates(["w1", "w2"])
    found = kept(spark, f"{a.out}/table", lambda: senses.max_pairwise(pairs, s))
    writers.pair_similarities(found, f"{a.out}/similarities")
    evaluate.spearman(found, "sim", "score").show(truncate=False)


def significance(spark: SparkSession, a: argparse.Namespace) -> None:
    """McNemar's test of two evaluated files (column ``correct``), paired by line or by context id."""
    left, right = (readers.evaluated(spark, p) for p in (a.left, a.right))
    evaluate.mcnemar(evaluate.joined_by_id(left, right) if a.by_id else evaluate.joined_by_place(left, right), "a", "b").show(truncate=False)


def _baseline(spark: SparkSession, a: argparse.Namespace, answers) -> None:
    """Writes a test set with the answers (ctx_id, predicted) and prints their accuracy."""
    test = readers.wsd_set(spark, a.test).drop("start", "end")
    found = answers.select(F.col("ctx_id").alias("context_id"), F.col("predicted").cast("string").alias("predict_sense_ids"))
    writers.predictions(test.drop("predict_sense_ids").join(found, "context_id", "left").select(*test.columns), a.out)
    wsd.accuracy(readers.wsd_set(spark, a.out)).show(truncate=False)


def most_frequent(spark: SparkSession, a: argparse.Namespace) -> None:
    """A test set answered by each target's largest cluster."""
    i = readers.wsd_set(spark, a.test).select(F.col("context_id").alias("ctx_id"), "target")
    _baseline(spark, a, evaluate.with_most_frequent(i, _clusters(spark, a.clusters).select("word", "cid", "size").distinct()))


def random(spark: SparkSession, a: argparse.Namespace) -> None:
    """A test set answered by one of each target's senses, drawn by the context's id."""
    i = readers.wsd_set(spark, a.test).select(F.col("context_id").cast("bigint").alias("ctx_id"), "target")
    _baseline(spark, a, evaluate.random_sense(i, _clusters(spark, a.clusters).select("word", "cid").distinct(), a.seed))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("polysema", description=__doc__)
    commands = p.add_subparsers(required=True)

    def command(name, run, *needed: str, **options):
        c = commands.add_parser(name, help=run.__doc__)
        c.set_defaults(run=run)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        for n, default in options.items():
            flag = f"--{n.replace('_', '-')}"
            if default is False:
                c.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                c.add_argument(flag, nargs="+", type=type(default[0]), default=default)
            else:
                c.add_argument(flag, type=str if default is None else type(default), default=default)

    d = Settings()
    command(
        "train", train_, "out", corpus=None, vectors=None, phrases=None, relations=None, size=d.size, window=d.window, iterations=d.iterations, min_count=d.min_count,
        neighbours=d.neighbours, edges=d.edges, min_size=d.min_size, weight=d.weight, bigrams=False, threshold=d.threshold, cbow=1,
    )
    command("sense-vectors", sense_vectors, "clusters", "vectors", "out", weight=d.weight)
    command("filter-clusters", filter_clusters, "clusters", "out", min_size=d.min_size)
    command("predict", predict, "inventory", "sense-vectors", "vectors", "test", "out", window=10, method="sim", most=3, ignore_case=False, stop_language=None)
    command("label", label, "clusters", "relations", "out", min_size=d.min_size, min_freq=0.0)
    command("anti", anti, "vectors", "out", top=[50, 100, 200])
    command("preprocess", preprocess, "corpus", "out")
    command("frequencies", frequencies, "corpus", "out", least=20)
    command("significance", significance, "left", "right", by_id=False)
    command("most-frequent", most_frequent, "clusters", "test", "out")
    command("random", random, "clusters", "test", "out", seed=7)
    command("similarity", similarity, "sense-vectors", "out", pairs=[""])
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("polysema").getOrCreate(), a)


if __name__ == "__main__":
    main()
