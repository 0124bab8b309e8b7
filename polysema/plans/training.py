"""The training chain as one call: vectors to graph, clusters, inventory and sense vectors, each stage kept as Parquet."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polysema.operators import cluster, corpus, ego, embeddings, graph, hypernyms, senses
from polysema.operators import phrases as phrases_


@dataclass(frozen=True)
class Settings:
    """Defaults of the training command; neighbours and edges a word, least size of a cluster, members pooled."""

    size: int = 300
    window: int = 5
    iterations: int = 5
    min_count: int = 10
    neighbours: int = 200
    edges: int = 200
    min_size: int = 5
    pooled: int = 20
    weight: str = "score"
    substrings: bool = True  # multiword nodes that begin or end with the ego join its network
    bigrams: bool = False  # adjacent pairs above the score threshold are joined before the training
    threshold: float = 10.0
    cbow: bool = True  # else skip-gram

    def stamp(self) -> str:
        return f"n{self.neighbours}-e{self.edges}-m{self.min_size}-p{self.pooled}-{self.weight}{'-s' if self.substrings else ''}{f'-b{self.threshold}' if self.bigrams else ''}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def kept(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at the path; made and written first if it is not there in full."""
    if not _exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def training_text(spark: SparkSession, at, docs: DataFrame, phrases: DataFrame | None, settings: Settings) -> DataFrame:
    """The texts with dictionary phrases and scored bigrams joined by underscores, as wanted."""
    known = [] if phrases is None else [phrases.select(F.translate("phrase", " ", "_").alias("phrase"))]
    if settings.bigrams:
        known.append(corpus.bigram_scores(docs, threshold=settings.threshold).select(F.concat_ws("_", "a", "b").alias("phrase")))
    if not known:
        return docs
    words = kept(spark, at("phrases"), lambda: reduce(DataFrame.unionAll, known).where(F.col("phrase").contains("_")).distinct())
    return kept(spark, at("corpus"), lambda: phrases_.merged(docs, words).select("doc_id", F.array_join("tokens", " ").alias("text")))


def closure(members: DataFrame, least: int) -> DataFrame:
    """members: word, cid, sense, score, one row a member with its sense. word, cid, cluster, kept: the members
    without a sense are left out; kept says whether enough are left."""
    w = Window.partitionBy("word", "cid").orderBy(F.desc("score"), "sense")
    rows = members.select("word", "cid", F.col("sense").alias("member"), F.col("score").alias("sim"), F.row_number().over(w).alias("pos"))
    return cluster.closed(cluster.folded(rows), least)


def train(
    spark: SparkSession,
    folder: str,
    docs: DataFrame | None = None,
    vectors: DataFrame | None = None,
    settings: Settings = Settings(),
    phrases: DataFrame | None = None,
    isa: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """docs (doc_id, text) or pretrained vectors (word, v); phrases (phrase) are joined in the docs.

    With relations isa (hypo, hyper, freq) the inventory's clusters are labelled, their members
    disambiguated and closed. Tables that an earlier run with the same settings left are
    reused, so another corpus, phrase list or set of relations takes another folder."""
    at = lambda name: f"{folder.rstrip('/')}/{settings.stamp()}/{name}"
    out = {}
    if vectors is None:
        text = training_text(spark, at, docs, phrases, settings)
        vectors = kept(spark, at(f"vectors-{'cbow' if settings.cbow else 'sg'}-{settings.size}-{settings.window}-{settings.iterations}-{settings.min_count}"), lambda: embeddings.word_vectors(text, settings.size, settings.window, settings.iterations, settings.min_count, settings.cbow))
    out["vectors"] = vectors
    out["near"] = kept(spark, at("near"), lambda: graph.nearest_words(out["vectors"], settings.neighbours))
    out["graph"] = kept(spark, at("graph"), lambda: graph.quantised(out["near"]))
    words = out["graph"].select(F.explode(F.array("src", "dst")).alias("word")).distinct()  # a word that is only a neighbour has a network of multiword nodes
    extra = kept(spark, at("substrings"), lambda: graph.substring_nodes(words, words)) if settings.substrings else None
    nodes = kept(spark, at("nodes"), lambda: graph.ego_nodes(out["graph"], extra))
    out["all_clusters"] = kept(spark, at("all_clusters"), lambda: cluster.emitted(ego.label_propagation(nodes, out["graph"], settings.edges)))
    out["clusters"] = kept(spark, at("clusters"), lambda: cluster.at_least(out["all_clusters"], settings.min_size))
    out["priors"] = kept(spark, at("priors"), lambda: senses.priors(out["clusters"]))
    out["sense_vectors"] = kept(spark, at("sense_vectors"), lambda: senses.pooled(out["clusters"], out["vectors"], settings.weight, settings.pooled))
    out["inventory"] = senses.inventory(out["priors"], out["sense_vectors"])
    if isa is not None:
        out["labels"] = kept(spark, at("labels"), lambda: hypernyms.labels(out["clusters"], isa))
        out["disambiguated"] = kept(spark, at("disambiguated"), lambda: hypernyms.disambiguated_members(out["clusters"]))
        out["closure"] = kept(spark, at("closure"), lambda: closure(out["disambiguated"], settings.min_size))
    return out
