"""Registered queries over the driver's tables and the SQL that gives the same rows.

The tables stand in for the domain's data: ``embeddings`` are word vectors (word
``w<id>w``), ``documents`` the corpus, ``labels`` the correctness of two systems,
``part`` the source of IS-A pairs. Reals are rounded before every ranking and on
output, so both engines order alike.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.functions import treebank
from polysema.functions import vectors as V
from polysema.operators import cluster, corpus, ego as networks, embeddings, evaluate, graph, hypernyms, instances as texts, morphology, phrases, senses, sparse, subwords, wsd
from polysema.plans import sql as S
from polysema.plans.training import Settings, closure
from polysema.tables import Scratch, table

#: Neighbours and edges a word, least cluster size, members that are pooled.
N, EDGES, LEAST, POOLED = 10, 10, 2, 20


@dataclass(frozen=True)
class Sizes:
    n: int = N
    edges: int = EDGES
    least: int = LEAST


#: The sizes that SQL can follow, and those of the training command (queries *_full, without SQL).
FULL = Sizes(Settings.neighbours, Settings.edges, Settings.min_size)
_SIZES: ContextVar[Sizes] = ContextVar("sizes", default=Sizes())

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- the chain of stages ------------------------------------------------------


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit("w")).alias("word"), V.doubles(F.col("embedding")).alias("v"))


def near(spark: SparkSession, d: str) -> DataFrame:
    return graph.nearest_words(vectors(spark, d), _SIZES.get().n)


def kept_near(spark: SparkSession, d: str) -> DataFrame:
    """The search's result as a table, where more than one step reads it."""
    return Scratch(spark, "near").keep(near(spark, d), "near")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.quantised(near(spark, d))


def kept_edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph as a table, as ego networks read it twice."""
    return Scratch(spark, "graph").keep(edges(spark, d), "edges")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Kept, as the ranks of clusters and of members both read it."""
    g = kept_edges(spark, d)
    return Scratch(spark, "labelled").keep(networks.label_propagation(graph.ego_nodes(g), g, _SIZES.get().edges), "labelled")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.at_least(cluster.emitted(labelled(spark, d)), _SIZES.get().least)


def model(spark: SparkSession, d: str) -> DataFrame:
    """The inventory as a table; what it is made of is a table too, as priors and vectors both read the clusters."""
    scratch = Scratch(spark, "model")
    c = scratch.keep(clusters(spark, d), "clusters")
    return scratch.keep(senses.inventory(senses.priors(c), senses.pooled(c, vectors(spark, d), most=POOLED)), "inventory")


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """ctx_id, word: eight context words of every target, by arithmetic on its number."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    k = e.select("vec_id").crossJoin(F.broadcast(n)).select("vec_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.pmod(F.col("vec_id") * 7 + k * 13, F.col("n")))).alias("c"))  # one row
    return k.where("c <> vec_id").select(F.col("vec_id").alias("ctx_id"), F.concat(F.lit("w"), F.col("c").cast("string"), F.lit("w")).alias("word")).distinct()


def instances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("ctx_id"), F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit("w")).alias("target"))


def target_senses(spark: SparkSession, d: str) -> DataFrame:
    m = model(spark, d)
    return instances(spark, d).join(m, F.col("target") == F.col("word")).select("ctx_id", "cid", "v")


def FLAGSHIP(spark: SparkSession, d: str) -> DataFrame:
    """word, cid, prob: graph, ego networks, clusters and priors of all words."""
    return senses.priors(clusters(spark, d)).select("word", "cid", F.round("prob", 6).alias("prob"))


# -- text -----------------------------------------------------------------------


@query("term_frequencies", S.TERM_FREQUENCIES)
def term_frequencies(spark, d):
    return corpus.term_frequencies(corpus.tokens(docs(spark, d)), 20)


@query("token_stats_by_lang", S.TOKEN_STATS)
def token_stats_by_lang(spark, d):
    words = X.split_space(F.col("text"))
    return docs(spark, d).select("lang", F.size(words).alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 4).alias("mean_tokens"), F.max("n").alias("max_tokens"))


@query("minimize_words", S.MINIMIZE)
def minimize_words(spark, d):
    words = docs(spark, d).select(F.explode(X.split_space(F.col("text"))).alias("word")).distinct()
    return words.select("word", X.minimize(F.col("word")).alias("form"))


@query("case_variants", S.CASE_VARIANTS)
def case_variants(spark, d):
    words = corpus.tokens(docs(spark, d)).distinct()
    return words.select("word", F.array_join(X.case_variants(F.concat("word", F.lit("-x_y"))), " ").alias("variants"))


@query("phrase_variants", S.PHRASE_VARIANTS)
def phrase_variants(spark, d):
    return table(spark, d, "part").select(F.explode(X.phrase_variants(F.col("p_name"))).alias("phrase")).distinct()


@query("clean_pages", S.CLEAN_PAGES)
def clean_pages(spark, d):
    t = X.without_markup(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(t.cast("binary")).alias("plain"), F.md5(X.one_space(t).cast("binary")).alias("spaced"), F.md5(X.csv_clean(F.concat(F.lit(' a;b &AMP; c &quot\\; "q" '), "html")).cast("binary")).alias("cleaned"))


@query("whitespace_lines", S.WHITESPACE)
def whitespace_lines(spark, d):
    return docs(spark, d).select("doc_id", F.length(X.one_line(F.col("text"))).alias("line_length"), F.length(X.one_space(F.col("text"))).alias("space_length"))


@query("url_extract", S.URLS)
def url_extract(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat_ws(" ", F.lit("see"), "url", F.lit("and"), F.upper("url")).alias("t"))
    return p.select("page_id", F.posexplode(X.urls(F.col("t"))).alias("at", "found"))


@query("pattern_flags", S.PATTERN_FLAGS)
def pattern_flags(spark, d):
    """The documents' texts and strings that tell the patterns apart."""
    names = [n for n in X.PATTERNS if n not in ("whitespaces", "newlines", "numeric_stops", "amp", "escape", "quote_escape")]
    probes = spark.createDataFrame([(-i - 1, p) for i, p in enumerate(S.PROBES)], "doc_id bigint, text string")
    return docs(spark, d).select("doc_id", "text").unionAll(probes).select("doc_id", *(X.matches(F.col("text"), n).cast("int").alias(n) for n in names))


@query("norm_babel", S.NORM_BABEL)
def norm_babel(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("#"), F.translate("p_brand", "#", ":"), F.lit(" ("), "p_type", F.lit(")_x")).alias("w"))
    return p.select("p_partkey", X.norm(F.col("w")).alias("norm"), X.babel(F.col("w")).alias("babel"), X.find_nth(F.col("w"), "e", 1).alias("second_e"))


@query("cluster_string_parse", S.CLUSTER_PARSE)
def cluster_string_parse(spark, d):
    s = F.concat_ws(", ", F.concat(F.split("p_name", " ")[0], F.lit(":0.5")), F.split("p_name", " ")[1], F.concat(F.lower("p_type"), F.lit(":x")), F.concat(F.lit("a:"), (F.col("p_size") / 64).cast("string")), F.concat(F.split("p_name", " ")[0], F.lit(":0.25")))
    p = table(spark, d, "part").select("p_partkey", F.explode(X.parse_cluster(s)).alias("x"))
    return p.select("p_partkey", F.col("x.word").alias("word"), F.round("x.sim", 6).alias("sim"), F.col("x.pos").alias("pos"))


@query("sense_ids", S.SENSE_IDS)
def sense_ids(spark, d):
    p = table(spark, d, "part").select("p_partkey", X.sense_id(F.concat("p_name", F.lit("#"), "p_type"), F.col("p_size")).alias("sense"))
    return p.select("p_partkey", "sense", X.parse_sense(F.col("sense"))["word"].alias("word"), X.parse_sense(F.col("sense"))["cid"].alias("cid"))


@query("word_tokenize", S.WORD_TOKENIZE)
def word_tokenize(spark, d):
    t = treebank.word_tokenize(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens"))


@query("treebank_tokens", S.TREEBANK)
def treebank_tokens(spark, d):
    """Sentences with quotes, contractions, prices, times and abbreviations around the names of the parts."""
    s = F.concat(
        F.lit("He said: \"It's "), "p_name", F.lit(",\" but can't (or won't) pay $"), F.col("p_size").cast("string"), F.lit('.50 -- not at 3:00 p.m. "Gimme '), "p_type", F.lit("...\", 'tis gonna be No. 5? Mr. "), "p_brand", F.lit(" cannot go.")
    )
    return table(spark, d, "part").select("p_partkey", F.array_join(treebank.word_tokenize(s), " ").alias("tokens"))


@query("lowercase_vocabulary", S.LOWERCASE)
def lowercase_vocabulary(spark, d):
    words = corpus.term_frequencies(corpus.tokens(docs(spark, d)), 1).select("word", F.col("freq").alias("value"))
    return corpus.lowercase_vocabulary(words)


@query("fixed_similarities", "select p_partkey, printf('%.12f', p_size / 1048576.0::DOUBLE) as sim from part")
def fixed_similarities(spark, d):
    return table(spark, d, "part").select("p_partkey", X.fixed_point(F.col("p_size") / 1048576).alias("sim"))


@query("split_underscores", "select p_partkey, len(string_split(replace(p_name, ' ', '_') || '_a', '_')) + 1 as n from part")
def split_underscores(spark, d):
    """The tokens of an array with joined ones, taken apart."""
    t = X.split_underscores(F.array(F.concat(F.translate("p_name", " ", "_"), F.lit("_a")), F.lit("b")))
    return table(spark, d, "part").select("p_partkey", F.size(t).cast("bigint").alias("n"))


@query("pos_variants", S.POS_VARIANTS)
def pos_variants(spark, d):
    return table(spark, d, "part").select(F.explode(X.pos_variants(F.split("p_name", " ")[0], True)).alias("form")).distinct()


@query("good_tokens", S.GOOD_TOKENS)
def good_tokens(spark, d):
    words = docs(spark, d).select(F.explode(X.split_space(F.col("text"))).alias("word")).distinct()
    return words.where(X.good_token(F.col("word"), ["the", "of", "1"])).agg(F.count(F.lit(1)).alias("good"))


@query("list_items", "select p_partkey, p_name as items, 3 as n from part")
def list_items(spark, d):
    """A written list with quotes of both kinds, read again."""
    written = F.concat(F.lit("['"), F.col("p_name"), F.lit("', \"x\", y]"))
    t = X.parse_list(written)
    return table(spark, d, "part").select("p_partkey", t[0].alias("items"), F.size(t).alias("n"))


@query("bigram_scores", S.BIGRAMS)
def bigram_scores(spark, d):
    return corpus.bigram_scores(docs(spark, d), 5, 10.0)


@query("phrase_merge", S.PHRASE_MERGE)
def phrase_merge(spark, d):
    """Every bigram above the score threshold is joined."""
    scored = bigram_scores(spark, d).select(F.concat_ws("_", "a", "b").alias("phrase"))
    return corpus.phrase_hits(phrases.merged(docs(spark, d), scored))


@query("phrase_merge_all", S.PHRASE_MERGE_ALL)
def phrase_merge_all(spark, d):
    """The vocabulary is every bigram above the score threshold, every dictionary phrase of several words, and every three words in a row that occur ten times."""
    scored = bigram_scores(spark, d).select(F.concat_ws("_", "a", "b").alias("phrase"))
    t = X.tokenize(F.col("text"))
    three = docs(spark, d).select(t.alias("t")).select(F.explode(F.expr("transform(slice(t, 1, greatest(size(t) - 2, 0)), (x, i) -> concat_ws('_', x, t[i + 1], t[i + 2]))")).alias("phrase"))
    often = three.groupBy("phrase").count().where("count >= 10").select("phrase")
    known = scored.unionAll(phrase_variants(spark, d).where(F.col("phrase").contains("_"))).unionAll(often).distinct()
    return corpus.phrase_hits(phrases.merged(docs(spark, d), known))


@query("phrase_places", S.PHRASE_PLACES)
def phrase_places(spark, d):
    """Where the words of the dictionary phrases, and scored bigrams, stand in the texts, in characters."""
    scored = bigram_scores(spark, d).select(F.concat_ws("_", "a", "b").alias("phrase"))
    rare = corpus.term_frequencies(corpus.tokens(docs(spark, d)), 20).where("freq < 25").select(F.col("word").alias("phrase"))
    return phrases.occurrences(docs(spark, d), scored.unionAll(rare).distinct())


@query("phrase_capacity", "select max(len(string_split(replace(p_name, ' ', '_'), '_'))) as capacity from part")
def phrase_capacity(spark, d):
    return corpus.phrase_capacity(table(spark, d, "part").select(F.translate("p_name", " ", "_").alias("phrase")))


# -- vectors and graphs -------------------------------------------------------


@query("l2_normalise", S.NORMALISE)
def l2_normalise(spark, d):
    v = vectors(spark, d).select("word", F.posexplode(V.normalise(F.col("v"))).alias("dim", "x"))
    return v.select("word", "dim", F.round("x", 6).alias("value"))


@query("cosine_pairs", S.COSINE_PAIRS)
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    n = e.select(F.col("vec_id").alias("b"), V.doubles(F.col("embedding")).alias("vb"))
    return e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), V.doubles(F.col("embedding")).alias("va")).join(n, "b").select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("sim"), F.round(V.logistic(V.dot(F.col("va"), F.col("vb"))), 6).alias("prob"))


@query("knn_graph", S.chain("graph", "select src, dst, weight from near"))
def knn_graph(spark, d):
    return near(spark, d)


@query("quantised_graph", S.chain("graph", "select src, dst, wq from graph"))
def quantised_graph(spark, d):
    return edges(spark, d)


@query("edge_lookup", S.chain("graph", S.EDGE_LOOKUP))
def edge_lookup(spark, d):
    pairs = table(spark, d, "embeddings").select(F.concat(F.lit("w"), "vec_id", F.lit("w")).alias("src"), F.concat(F.lit("w"), F.col("vec_id") + 1, F.lit("w")).alias("dst"))
    return graph.edge_weight(pairs, edges(spark, d))


@query("ego_nodes", S.chain("nodes", "select ego, node, wq from nodes"))
def ego_nodes(spark, d):
    return graph.ego_nodes(edges(spark, d))


@query("ego_edges", S.chain("edges", "select ego, a, b, wq from edges"))
def ego_edges(spark, d):
    g = kept_edges(spark, d)
    return networks.ego_edges(graph.ego_nodes(g), g, _SIZES.get().edges)


@query("substring_nodes", S.SUBSTRING_NODES)
def substring_nodes(spark, d):
    words = corpus.term_frequencies(corpus.tokens(docs(spark, d)), 20).select("word")
    pairs = corpus.adjacent(docs(spark, d)).groupBy("a", "b").count().where("count >= 20").select(F.concat_ws("_", "a", "b").alias("word"))
    return graph.substring_nodes(words, words.unionAll(pairs))


@query("ego_nodes_substrings", S.EGO_SUBSTRINGS)
def ego_nodes_substrings(spark, d):
    """Networks over frequent neighbours in text, with the multiword nodes that begin or end with the ego."""
    pairs = corpus.adjacent(docs(spark, d)).groupBy("a", "b").agg(F.count(F.lit(1)).cast("int").alias("wq")).where("wq >= 20")
    return graph.ego_nodes(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "wq"), substring_nodes(spark, d))


# -- clusters ------------------------------------------------------------------


@query("label_propagation", S.chain("labelled", "select ego, node, wq, label from labelled"))
def label_propagation(spark, d):
    return labelled(spark, d)


@query("cluster_ranks", S.chain("emitted", "select word, cid, size, member, sim, pos from emitted"))
def cluster_ranks(spark, d):
    return cluster.emitted(labelled(spark, d))


@query("min_size_filter", S.chain("clusters", "select word, cid, size, member, sim, pos from clusters"))
def min_size_filter(spark, d):
    return clusters(spark, d)


@query("senses_per_word_stats", S.chain("emitted", S.SENSE_STATS))
def senses_per_word_stats(spark, d):
    return cluster.sense_statistics(cluster_ranks(spark, d), _SIZES.get().least)


@query("cluster_strings", S.chain("clusters", S.CLUSTER_STRINGS))
def cluster_strings(spark, d):
    return cluster.folded(clusters(spark, d)).select("word", "cid", X.format_cluster(F.col("cluster")).alias("line"))


@query("similar_words", S.chain("emitted", S.SIMILAR_WORDS))
def similar_words(spark, d):
    return senses.similar_words(cluster_ranks(spark, d), 5)


# -- senses --------------------------------------------------------------------


@query("sense_priors", S.chain("priors", "select word, cid, round(prob, 6) as prob from priors"))
def sense_priors(spark, d):
    return FLAGSHIP(spark, d)


@query("number_of_senses", S.chain("clusters", "select count(*) as senses from (select distinct word, cid from clusters)"))
def number_of_senses(spark, d):
    return senses.number_of_senses(clusters(spark, d))


def _pooled(kind: str):
    def f(spark, d):
        v = senses.pooled(Scratch(spark, "clusters").keep(clusters(spark, d), "clusters"), vectors(spark, d), kind, POOLED)
        return v.select("word", "cid", F.posexplode("v").alias("dim", "x")).select("word", "cid", "dim", (F.round("x", 5) + 0.0).alias("value"))

    return f


for _kind in ("score", "rank", "ones"):
    query(f"sense_vectors_{_kind}", S.pooled(_kind))(_pooled(_kind))


@query("most_probable_sense", S.chain("priors", S.MOST_PROBABLE))
def most_probable_sense(spark, d):
    m = senses.most_probable(senses.priors(clusters(spark, d)))
    return m.select("word", "cid", F.round("prob", 6).alias("prob"))


@query("max_pairwise_sim", S.chain("model", S.MAX_PAIRWISE))
def max_pairwise_sim(spark, d):
    pairs = near(spark, d).select(F.col("src").alias("w1"), F.col("dst").alias("w2"))
    return senses.max_pairwise(pairs, model(spark, d))


@query("sense_knn", S.chain("model", S.SENSE_KNN))
def sense_knn(spark, d):
    return senses.nearest_senses(model(spark, d), 5)


@query("word_sense_mix", S.chain("model", S.MIX))
def word_sense_mix(spark, d):
    mixed = senses.with_word(model(spark, d), vectors(spark, d))
    return mixed.select("word", "cid", F.round(V.length(F.col("v")), 5).alias("length"))


@query("sense_vectors_fallback", S.POOLED_FALLBACK)
def sense_vectors_fallback(spark, d):
    """Members that are found by themselves, before their #, by parts of a compound (known and not, short ones too), or not at all."""
    v = table(spark, d, "embeddings").select(F.concat(F.lit("word"), F.col("vec_id").cast("string")).alias("word"), "vec_id", V.doubles(F.col("embedding")).alias("v"))
    w, near = F.col("word"), F.concat(F.lit("word"), (F.col("vec_id") + 1).cast("string"))
    forms = [w, F.concat(w, F.lit("#NN")), F.concat(F.lit("new_"), w, F.lit("_station#NP")), F.concat(w, F.lit("_"), near), F.concat(F.lit("abc_"), w, F.lit("_abc_xyzxyz")), F.lit("nowhere_to_find")]
    c = v.select(w.alias("word"), F.lit(1).alias("cid"), F.posexplode(F.array(*forms)).alias("i", "member")).select("word", "cid", "member", (F.col("i") + 1).alias("pos"), (1 / (F.col("i") + 2)).alias("sim"))
    p = senses.pooled(c, v, "score", POOLED)
    return p.select("word", "cid", F.posexplode("v").alias("dim", "x")).select("word", "cid", "dim", (F.round("x", 5) + 0.0).alias("value"))


@query("sense_vector_lookup", S.VECTOR_LOOKUP)
def sense_vector_lookup(spark, d):
    """Every second sense is asked for under an id that it has not: its vector is zero."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("label").cast("string").alias("word"), F.col("vec_id").alias("cid"), V.doubles(F.col("embedding")).alias("v"))
    size = e.select(F.max(F.size("embedding"))).first()[0] or 0  # one row
    asked = v.select("word", F.when(F.col("cid") % 2 == 0, F.col("cid")).otherwise(-F.col("cid")).alias("cid"))
    return senses.vector_or_zero(asked, v, size).select("word", "cid", F.round(V.length(F.col("v")), 5).alias("length"))


@query("subword_vectors", S.SUBWORD_VECTORS)
def subword_vectors(spark, d):
    """Words of the parts from rows of the matrix: seven rows of words, the others shared by n-grams."""
    p, e = table(spark, d, "part"), table(spark, d, "embeddings")
    w1, w2 = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    words = p.select(F.explode(F.array("p_brand", w1, F.concat(w2, F.col("p_size").cast("string")), F.lower("p_type"))).alias("word"))
    known = p.select(w1.alias("word"), "p_partkey").groupBy("word").agg((F.min("p_partkey") % 7).alias("row"))
    size = e.select(F.max(F.size("embedding"))).first()[0] or 0  # one row
    found = subwords.word_vectors(words, known, e.select(F.col("vec_id").alias("row"), F.col("embedding").alias("v")), size, e.count() - 7, offset=7)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return found.select("word", F.size("v").cast("bigint").alias("dims"), (F.round(total, 5) + 0.0).alias("total"), F.round(V.length(F.col("v")), 5).alias("length"), "known")


# -- disambiguation ---------------------------------------------------------------


@query("wsd_context_window", S.CONTEXT_WINDOW)
def wsd_context_window(spark, d):
    vocabulary = docs(spark, d).select(F.explode(X.split_space(F.col("text"))).alias("word")).groupBy("word").count()
    stop = vocabulary.where("count >= 2000").select("word")
    i = docs(spark, d).select(F.col("doc_id").alias("ctx_id"), F.col("text").alias("context"), F.lit("the").alias("target"))
    return wsd.context_words(wsd.located(i), vocabulary.where("count >= 20"), 10, stop)


@query("wsd_significance", S.chain("sig", "select ctx_id, word, sig, r from sig where r <= 3"))
def wsd_significance(spark, d):
    return wsd.significant(wsd.context_scores(contexts(spark, d), target_senses(spark, d), vectors(spark, d)), 3)


@query("wsd_sim", S.chain("sim_scores", "select ctx_id, cid, score from sim_scores"))
def wsd_sim(spark, d):
    return wsd.sense_scores(contexts(spark, d), target_senses(spark, d), vectors(spark, d), "sim", 3)


@query("wsd_prob", S.chain("prob_scores", "select ctx_id, cid, score from prob_scores"))
def wsd_prob(spark, d):
    return wsd.sense_scores(contexts(spark, d), target_senses(spark, d), vectors(spark, d), "prob", 3)


@query("wsd_disambiguate", S.chain("sim_scores", S.DISAMBIGUATE))
def wsd_disambiguate(spark, d):
    """Every target with all of its context."""
    return wsd.disambiguate(instances(spark, d), contexts(spark, d), model(spark, d), vectors(spark, d)).drop("sense")


@query("wsd_disambiguate_all", S.chain("sim_scores", S.DISAMBIGUATE_ALL))
def wsd_disambiguate_all(spark, d):
    """The same with the sense's name."""
    return wsd.disambiguate(instances(spark, d), contexts(spark, d), model(spark, d), vectors(spark, d))


@query("wsd_texts", S.WSD_TEXTS)
def wsd_texts(spark, d):
    """From texts to senses: words get the vectors of the documents that begin with them; graph, networks, clusters and
    priors of these words; every occurrence of a word of the inventory in any text; its sense by five known words each side."""
    scratch = Scratch(spark, "texts")
    e = table(spark, d, "embeddings")
    first = docs(spark, d).select(F.col("doc_id").alias("vec_id"), F.get(X.tokenize(F.col("text")), 0).alias("word")).where("word is not null")
    one = first.join(e.select("vec_id"), "vec_id", "left_semi").groupBy("word").agg(F.min("vec_id").alias("vec_id"))
    v = scratch.keep(one.join(e, "vec_id").select("word", V.doubles(F.col("embedding")).alias("v")), "vectors")
    g = scratch.keep(graph.quantised(graph.nearest_words(v, N)), "graph")
    c = scratch.keep(cluster.at_least(cluster.emitted(networks.label_propagation(graph.ego_nodes(g), g, EDGES)), LEAST), "clusters")
    inv = scratch.keep(senses.inventory(senses.priors(c), senses.pooled(c, v, most=POOLED)), "inventory")
    found = scratch.keep(texts.found_in_texts(docs(spark, d).select("doc_id", "text"), inv.select("word").distinct(), v.select("word"), 5), "instances")
    answers = wsd.disambiguate(found, found.select("ctx_id", F.explode("words").alias("word")), inv, v)
    return found.select("ctx_id", "doc_id", "start").join(answers, "ctx_id").select("doc_id", "start", "target", "cid", "score", "how")


# -- anti-edge induction --------------------------------------------------------


@query("anti_pairs", S.chain("apart", "select ego, a, b from apart"))
def anti_pairs(spark, d):
    return cluster.anti_pairs(vectors(spark, d), near(spark, d))


@query("anti_nodes", S.chain("apart", "select ego, node, n from anti_nodes"))
def anti_nodes(spark, d):
    return cluster.anti_nodes(anti_pairs(spark, d))


def _anti(spark, d):
    n = kept_near(spark, d)
    return cluster.anti_clusters(cluster.anti_pairs(vectors(spark, d), n), graph.quantised(n))


@query("anti_clusters", S.chain("anti_labelled", "select ego, node, n, label from anti_labelled"))
def anti_clusters(spark, d):
    return _anti(spark, d)


@query("anti_inventory", S.chain("anti_labelled", S.ANTI_INVENTORY))
def anti_inventory(spark, d):
    inv = cluster.anti_inventory(_anti(spark, d))
    return inv.select("word", "cid", "keyword", F.array_join("cluster", ", ").alias("cluster"))


@query("anti_disambiguate", S.chain("anti_labelled", S.ANTI_DISAMBIGUATE))
def anti_disambiguate(spark, d):
    tokens = contexts(spark, d).groupBy("ctx_id").agg(F.sort_array(F.collect_list("word")).alias("tokens"))
    i = instances(spark, d).join(tokens, "ctx_id")
    return wsd.disambiguate_by_keyword(i, cluster.anti_inventory(_anti(spark, d)), vectors(spark, d))


# -- sparse vectors --------------------------------------------------------------


def _sparse(spark, d):
    """The vectors, kept once, as every query reads them several times."""
    scratch = Scratch(spark, "sparse")
    words = scratch.keep(corpus.term_frequencies(corpus.tokens(docs(spark, d)), 20).select(F.col("word")), "words")
    pairs = corpus.adjacent(docs(spark, d)).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("score"))
    rows = pairs.select(F.col("a").alias("word"), F.col("b").alias("feature"), "score")
    kept = rows.where("score >= 2").join(words, "word", "left_semi").join(words.withColumnRenamed("word", "feature"), "feature", "left_semi")
    return scratch.keep(sparse.folded(kept), "vectors")


@query("sparse_vectors", S.chain("sparse", "select word, feature, score from sparse"))
def sparse_vectors(spark, d):
    return _sparse(spark, d)


@query("top_features", S.chain("sparse", S.TOP_FEATURES))
def top_features(spark, d):
    return sparse.top_features(_sparse(spark, d), 10).select("word", "feature", "score", "rank")


@query("sparse_cosine", S.chain("sparse", S.SPARSE_COSINE))
def sparse_cosine(spark, d):
    v = _sparse(spark, d)
    pairs = sparse.top_features(v, 3).select(F.col("word").alias("w1"), F.col("feature").alias("w2"))
    return sparse.similarity(pairs, v)


def _sparse_senses(spark, d, mark: str = ""):
    """Two senses a word, of its strongest features by turns."""
    v = _sparse(spark, d)
    members = sparse.top_features(v, 6).select("word", F.pmod("rank", F.lit(2)).alias("cid"), F.concat("feature", F.lit(mark)).alias("member"), F.col("score").alias("sim"), F.ceil(F.col("rank") / 2).cast("int").alias("pos"))
    return sparse.pooled(members, v, "score", 2)


@query("sparse_sense_pooling", S.chain("sparse", S.SPARSE_POOLING))
def sparse_sense_pooling(spark, d):
    return _sparse_senses(spark, d)


@query("sparse_sense_pooling_marked", S.chain("sparse", S.SPARSE_POOLING))
def sparse_sense_pooling_marked(spark, d):
    """Members with a mark of their part of speech, known without it."""
    return _sparse_senses(spark, d, "#NN")


# -- hypernyms ----------------------------------------------------------------------


def _isa(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_name").alias("hyponym"), F.element_at(F.split("p_name", " "), -1).alias("hypernym")).unionAll(p.select("p_name", "p_type"))
    return hypernyms.relations(rows.groupBy("hyponym", "hypernym").agg(F.count(F.lit(1)).alias("freq")), 2)


@query("isa_merge", S.chain("isa", "select hypo, hyper, freq from isa"))
def isa_merge(spark, d):
    return _isa(spark, d)


@query("hyponyms", S.chain("isa", S.HYPONYMS))
def hyponyms(spark, d):
    isa = _isa(spark, d)
    return hypernyms.hyponyms_of(isa.select(F.col("hyper").alias("word")).distinct(), isa, 5)


@query("hypernyms", S.chain("isa", S.HYPERNYMS))
def all_hypernyms(spark, d):
    return hypernyms.hypernyms_of(table(spark, d, "part").select(F.upper("p_name").alias("word")).distinct(), _isa(spark, d), 3)


@query("has_relation", S.chain("isa", S.HAS_RELATION))
def has_relation(spark, d):
    pairs = table(spark, d, "part").select(F.initcap("p_name").alias("hypo"), F.col("p_type").alias("hyper")).distinct()
    return hypernyms.has_relation(pairs, _isa(spark, d))


def _tagged(spark, d):
    """Tagged tokens and terms made of the parts' names."""
    p = table(spark, d, "part")
    w1, w2 = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    last = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.lower("p_type"))
    rows = [
        (w1, w1, F.lit("ADJ")),
        (F.concat(w2, F.when(F.col("p_size") % 2 == 0, F.lit("s")).otherwise(F.lit(""))), w2, F.lit("NOUN")),
        (F.lit("of"), F.lit("of"), F.lit("ADP")),
        (last, last, F.when(F.col("p_size") % 3 == 0, F.lit("PROPN")).otherwise(F.lit("NOUN"))),
    ]
    one = F.array(*(F.struct(F.lit(i + 1).alias("place"), f.alias("form"), l.alias("lemma"), t.alias("tag")) for i, (f, l, t) in enumerate(rows)))
    tokens = p.select(F.col("p_partkey").alias("sentence"), F.explode(one).alias("x")).select("sentence", "x.*")
    lower = F.lower("p_type")
    made = [
        F.col("p_name"), F.concat("p_name", F.lit("s of "), lower), F.concat(w2, F.lit(" of "), "p_brand"), F.concat(F.lit("un"), "p_name", F.lit("els in "), lower),
        F.concat("p_type", F.lit(" "), w1), F.concat(F.lit("Qqq "), "p_brand"), F.concat("p_brand", F.lit("x ofs zz")),
    ]
    return tokens, p.select(F.explode(F.array(*made)).alias("term")).distinct()


@query("lemmas", S.LEMMAS)
def lemmas(spark, d):
    """Known forms, and unknown ones by their endings."""
    tokens, terms = _tagged(spark, d)
    words = terms.select(F.explode(X.split_space(F.col("term"))).alias("word"))
    return morphology.lemmas(words.unionAll(words.select(F.concat("word", F.lit("s")))), tokens)


@query("term_tags", S.TERM_TAGS)
def term_tags(spark, d):
    """Parts of speech of every word of the terms, by Viterbi."""
    tokens, terms = _tagged(spark, d)
    return morphology.tagged(terms, tokens).select("term", F.posexplode("tokens").alias("at", "x")).select("term", "at", "x.text", "x.pos", "x.entity")


@query("head_hypernyms", S.HEAD_HYPERNYMS)
def head_hypernyms(spark, d):
    tokens, terms = _tagged(spark, d)
    found = hypernyms.head_hypernym(morphology.tagged(terms, tokens))
    return found.select("term", "hyper", F.round("score", 6).alias("score"))


def _part_clusters(spark, d):
    """word = type, sense = brand number mod 3, members = names with their counts as similarity."""
    p = table(spark, d, "part").select(F.lower("p_type").alias("word"), F.pmod(F.col("p_size"), F.lit(3)).alias("cid"), F.col("p_name").alias("member"))
    n = p.groupBy("word", "cid", "member").agg((F.count(F.lit(1)) / 64).alias("sim"))
    pos = F.row_number().over(Window.partitionBy("word", "cid").orderBy(F.desc("sim"), "member"))
    return n.withColumn("pos", pos).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("word", "cid"))).select("word", "cid", "size", "member", "sim", "pos")


@query("hypernym_scores", S.chain("part_clusters", S.HYPERNYM_SCORES))
def hypernym_scores(spark, d):
    return hypernyms.labels(_part_clusters(spark, d), _isa(spark, d), 5)


@query("cluster_closure", S.chain("part_clusters", S.CLOSURE))
def cluster_closure(spark, d):
    marked = _part_clusters(spark, d).withColumn("member", F.when(F.length("member") % 4 == 0, F.concat("member", F.lit("#?"))).otherwise(F.col("member")))
    c = cluster.closed(cluster.folded(marked), 15)
    return c.select("word", "cid", "kept", F.size("cluster").cast("bigint").alias("left"))


@query("disambiguated_closure", S.chain("emitted", S.MEMBER_CLOSURE))
def disambiguated_closure(spark, d):
    """The members of every cluster by their senses, and whether enough of them have one."""
    c = closure(cluster_word_senses(spark, d), 5)
    return c.select("word", "cid", "kept", F.size("cluster").cast("bigint").alias("left"))


@query("cluster_word_senses", S.chain("emitted", S.MEMBER_SENSES))
def cluster_word_senses(spark, d):
    return hypernyms.disambiguated_members(cluster_ranks(spark, d))


def _synsets(spark, d):
    p = table(spark, d, "part")
    s = p.select(F.concat(F.lit("s"), F.col("p_size")).alias("synset"), F.split("p_name", " ")[0].alias("word"))
    h = p.select(F.concat(F.lit("h"), F.col("p_size")).alias("synset"), F.split("p_name", " ")[1].alias("word"))
    n = s.unionAll(h).groupBy("synset", "word").count()
    return n.select("synset", "word", F.row_number().over(Window.partitionBy("synset").orderBy(F.desc("count"), "word")).alias("rank"))


@query("synset_label_pairs", S.chain("synsets", S.LABEL_PAIRS))
def synset_label_pairs(spark, d):
    return hypernyms.label_pairs(_synsets(spark, d), 3)


def _close_synsets(spark, d):
    ids = _synsets(spark, d).select(F.expr("substring(synset, 2)").cast("int").alias("i")).distinct()
    close = ids.select(F.concat(F.lit("h"), "i").alias("src"), F.explode(F.array((F.col("i") + 1).alias("a"), F.col("i") + 2, F.col("i") + 3)).alias("j"), "i")
    return close.select("src", F.concat(F.lit("s"), "j").alias("dst"), (F.col("j") - F.col("i")).alias("rank"))


@query("synset_vector_pairs", S.chain("synsets", S.VECTOR_PAIRS))
def synset_vector_pairs(spark, d):
    return hypernyms.vector_pairs(_synsets(spark, d), _close_synsets(spark, d), 8, 2)


@query("restored_bigrams", "select p_partkey, case when p_size % 2 = 0 then replace(p_name, ' ', '_') || ' end' else p_name || ' end' end as line from part")
def restored_bigrams(spark, d):
    """Pairs that the original text had joined are joined again, others are left."""
    tokens = F.split(F.concat("p_name", F.lit(" end")), " ")
    original = F.when(F.col("p_size") % 2 == 0, F.array(F.translate("p_name", " ", "_"), F.lit("end"))).otherwise(tokens)
    return table(spark, d, "part").select("p_partkey", F.array_join(X.restore_bigrams(tokens, original), " ").alias("line"))


@query("word_neighbours", S.chain("graph", "select src, dst, wq from graph where src = 'w7w'"))
def word_neighbours(spark, d):
    return graph.neighbours(edges(spark, d), "w7w")


@query("senses_of_words", S.chain("model", "select 'W' || vec_id || 'W' as asked, word, cid, round(prob, 6) as prob from model join vec using (word)"))
def senses_of_words(spark, d):
    """Words asked for in capitals, found by their variants."""
    words = instances(spark, d).select(F.upper("target").alias("word"))
    return senses.senses_of(words, model(spark, d), ignore_case=True).select("asked", "word", "cid", F.round("prob", 6).alias("prob"))


@query("clusters_of_senses", S.chain("clusters", "select word, cid, member, sim from clusters where cid = 1 and word in (select word from vec where vec_id % 2 = 0) union all select word, -1, null, null from vec where vec_id % 2 = 0 and word not in (select word from clusters where cid = 1)"))
def clusters_of_senses(spark, d):
    """The members of the first sense of every second word; words without one come once without a member."""
    asked = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.concat(F.lit("w"), "vec_id", F.lit("w")).alias("word"), F.lit("1").alias("cid"))
    return senses.cluster_of(asked, clusters(spark, d)).select("word", F.when(F.col("member").isNull(), -1).otherwise(F.col("cid").cast("int")).alias("cid"), "member", "sim")


@query("predicted_senses", S.chain("sim_scores", S.PREDICTED))
def predicted_senses(spark, d):
    """A test set with spans: the target, then its context words, answered from its text."""
    t = contexts(spark, d).groupBy("ctx_id").agg(F.array_join(F.sort_array(F.collect_list("word")), " ").alias("rest"))
    blank = {c: F.lit("") for c in ("target_pos", "gold_sense_ids", "predict_sense_ids", "golden_related", "predict_related")}
    rows = instances(spark, d).join(t, "ctx_id").select(F.col("ctx_id").alias("context_id"), "target", F.concat(F.lit("0,"), F.length("target")).alias("target_position"), F.concat("target", F.lit(" "), "rest").alias("context"), *(c.alias(n) for n, c in blank.items()))
    return wsd.predicted(rows, model(spark, d), vectors(spark, d)).select("context_id", "target", "predict_sense_ids")


@query("synset_sweep", S.chain("synsets", S.SWEEP))
def synset_sweep(spark, d):
    """Relations at two settings, in one plan."""
    found = hypernyms.swept(_synsets(spark, d), _close_synsets(spark, d), [3], [8], [1, 2])
    return reduce(DataFrame.unionAll, [r.withColumn("synsets", F.lit(c)) for (_, _, c), r in found.items()])


@query("sparse_sense_similarity", S.chain("sparse", S.SPARSE_SENSE_SIM))
def sparse_sense_similarity(spark, d):
    """Cosine of the two senses of each word, and of a sense that isn't there."""
    s = Scratch(spark, "sparse_senses").keep(_sparse_senses(spark, d), "senses")
    w = s.select("word").distinct()
    pairs = w.select(F.col("word").alias("w1"), F.lit(0).alias("c1"), F.col("word").alias("w2"), F.explode(F.array(F.lit(1), F.lit(7))).alias("c2"))
    return sparse.sense_similarity(pairs, s)


@query("sparse_sense_mix", S.chain("sparse", S.SPARSE_MIX))
def sparse_sense_mix(spark, d):
    v = _sparse(spark, d)
    return sparse.with_word(_sparse_senses(spark, d), v.where("word >= 'm'"))


# -- evaluation --------------------------------------------------------------------


@query("mfs_baseline", S.chain("clusters", S.MFS))
def mfs_baseline(spark, d):
    return evaluate.with_most_frequent(instances(spark, d), clusters(spark, d)).select("ctx_id", "target", F.coalesce("predicted", F.lit(-1)).alias("predicted"))


@query("random_baseline", S.chain("clusters", S.RANDOM))
def random_baseline(spark, d):
    return evaluate.random_sense(instances(spark, d), clusters(spark, d))


@query("spearman_similarity", S.chain("graph", S.SPEARMAN))
def spearman_similarity(spark, d):
    number = lambda c: F.regexp_extract(c, r"\d+", 0).cast("bigint")
    return evaluate.spearman(kept_near(spark, d).select("weight", F.abs(number("src") - number("dst")).alias("gap")), "weight", "gap")


@query("mcnemar_midp", S.MCNEMAR)
def mcnemar_midp(spark, d):
    return evaluate.mcnemar(table(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b")), "a", "b")


@query("summary_statistics", S.SUMMARY)
def summary_statistics(spark, d):
    return evaluate.summary(docs(spark, d), "n_chars")


@query("word2vec_neighbours")
def word2vec_neighbours(spark, d):
    """Continuous bag of words at the training command's sizes, and every word's neighbours."""
    c = Settings()
    v = Scratch(spark, "word2vec").keep(embeddings.word_vectors(docs(spark, d), c.size, c.window, c.iterations, c.min_count, c.cbow), "vectors")
    return graph.nearest_words(v, c.neighbours)


# -- the chain at the training command's sizes ---------------------------------------


def sized(name: str, sizes: Sizes) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the chain at other sizes; plans are built inside the call, so the sizes hold for all of it."""

    def f(spark, d):
        mark = _SIZES.set(sizes)
        try:
            return _QUERIES[name](spark, d)
        finally:
            _SIZES.reset(mark)

    return f


CHAIN = (
    "knn_graph quantised_graph edge_lookup ego_nodes ego_edges label_propagation cluster_ranks min_size_filter senses_per_word_stats cluster_strings similar_words sense_priors "
    "number_of_senses sense_vectors_score sense_vectors_rank sense_vectors_ones most_probable_sense max_pairwise_sim sense_knn word_sense_mix wsd_significance wsd_sim wsd_prob "
    "wsd_disambiguate anti_pairs anti_nodes anti_clusters anti_inventory anti_disambiguate cluster_word_senses mfs_baseline random_baseline spearman_similarity"
).split()
for _name in CHAIN:
    query(f"{_name}_full")(sized(_name, FULL))
for _n in (50, 100):
    query(f"anti_inventory_top{_n}")(sized("anti_inventory", Sizes(_n, FULL.edges, FULL.least)))
query("ego_edges_strongest")(sized("ego_edges", Sizes(FULL.n, 50, FULL.least)))
