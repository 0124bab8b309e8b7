"""Registered queries that write each text format into the shared folder, read it again and return what came back.

Their SQL computes the same rows from the tables, so that a lost field, a wrong
order of columns or a changed digit shows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.functions import vectors as V
from polysema.operators import cluster, evaluate
from polysema.plans import sql as S
from polysema.plans.catalogue import query
from polysema.sources import readers, schemas, writers
from polysema.tables import shared_dir, table


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/formats-{uuid.uuid4().hex[:12]}/{name}"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").cast("array<float>").alias("v"))


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("name", F.translate("p_name", " ", "_"))


@query("format_word2vec", "select 'w' || vec_id as word, len(embedding)::INT as size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0.0 as total from embeddings")
def format_word2vec(spark, d):
    path = _path(spark, "vectors")
    writers.word2vec(_vectors(spark, d), path)
    total = F.aggregate(V.doubles(F.col("v")), F.lit(0.0), lambda a, x: a + x)
    return readers.word2vec_text(spark, path).select("word", F.size("v").alias("size"), (F.round(total, 4) + 0.0).alias("total"))


@query("format_word2vec_vocabulary", "select 'w' || vec_id as word from embeddings")
def format_word2vec_vocabulary(spark, d):
    path = _path(spark, "vectors")
    writers.word2vec(_vectors(spark, d), path)
    return readers.word2vec_vocabulary(spark, path)


@query("format_edges", "select 'p' || p_partkey as src, replace(p_name, ' ', '_') as dst, p_size / 64.0::DOUBLE as weight from part")
def format_edges(spark, d):
    path = _path(spark, "edges")
    writers.edges(_part(spark, d).select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.col("name").alias("dst"), (F.col("p_size") / 64).alias("weight")), path)
    return readers.edges(spark, path)


@query("format_inventory", "select replace(p_name, ' ', '_') as word, p_partkey::VARCHAR as cid, p_size / 64.0::DOUBLE as prob from part")
def format_inventory(spark, d):
    path = _path(spark, "inventory")
    writers.inventory(table(spark, d, "part").select(F.col("p_name").alias("word"), F.col("p_partkey").alias("cid"), (F.col("p_size") / 64).alias("prob")), path)
    return readers.inventory(spark, path)


def _members(spark: SparkSession, d: str) -> DataFrame:
    """One sense a brand and size; its members are the parts, the smaller key first."""
    rows = table(spark, d, "part").select(F.translate("p_brand", "#", "-").alias("word"), F.col("p_size").alias("cid"), F.col("p_partkey").alias("pos"), F.concat(F.lit("m"), "p_partkey").alias("member"), (F.col("p_size") / 64).alias("sim"))
    return cluster.folded(rows)


_MEMBERS_SQL = """select replace(p_brand, '#', '-') as word, p_size::VARCHAR as cid, 'm' || p_partkey as member, round(p_size / 64.0::DOUBLE, 6) as sim,
  (row_number() over (partition by p_brand, p_size order by p_partkey))::INT as pos from part"""


@query("format_clusters", _MEMBERS_SQL)
def format_clusters(spark, d):
    path = _path(spark, "clusters")
    writers.clusters(_members(spark, d), path, digits=6)
    back = readers.clusters(spark, path)
    return back.select("word", "cid", F.explode("cluster").alias("x")).select("word", "cid", F.col("x.word").alias("member"), "x.sim", "x.pos")


@query("format_clusters_vocabulary", "select 'n' || p_size as word, replace(p_brand, '#', '-') as cid, count(*) as n from part where p_size in (select s_nationkey from supplier) group by all")
def format_clusters_vocabulary(spark, d):
    """Only the senses of the words of a vocabulary file are read."""
    path, words = _path(spark, "clusters"), _path(spark, "words")
    writers.clusters(_members(spark, d).select(F.concat(F.lit("n"), "cid").alias("word"), F.col("word").alias("cid"), "cluster"), path)
    writers.predictions(table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("word")).distinct(), words)
    back = readers.clusters(spark, path, readers.vocabulary(spark, words))
    return back.select("word", "cid", F.size("cluster").cast("bigint").alias("n"))


@query("format_closure", "select word, cid, count(*) >= 5 as kept, count(*) as n from (" + _MEMBERS_SQL + ") where right(member, 1) <> '7' group by all")
def format_closure(spark, d):
    """Members whose key ends in 7 are marked ? and go; both folders of the write are read again."""
    path = _path(spark, "closure")
    marked = F.transform("cluster", lambda x: F.struct(F.when(x["word"].endswith("7"), F.concat(x["word"], F.lit("#?"))).otherwise(x["word"]).alias("word"), x["sim"].alias("sim"), x["pos"].alias("pos")))
    writers.closure(cluster.closed(_members(spark, d).withColumn("cluster", marked), 5), path)
    f = F.split("value", "\t")
    back = spark.read.schema("value string, kept boolean").text(path)
    return back.select(f[0].alias("word"), f[1].alias("cid"), "kept", F.size(X.parse_cluster(f[2])).cast("bigint").alias("n")).where("n > 0")


@query("format_keyword_inventory", "select replace(p_name, ' ', '_') as word, p_partkey::INT as cid, p_type as keyword, p_brand || '|' || p_type as cluster from part")
def format_keyword_inventory(spark, d):
    path = _path(spark, "keywords")
    rows = _part(spark, d).select(F.col("name").alias("word"), F.col("p_partkey").cast("int").alias("cid"), F.col("p_type").alias("keyword"), F.array("p_brand", "p_type").alias("cluster"))
    writers.keyword_inventory(rows, path)
    return readers.keyword_inventory(spark, path).withColumn("cluster", F.array_join("cluster", "|"))


@query("format_relations", "select p_name as hyponym, p_type as hypernym, p_size::DOUBLE as freq from part")
def format_relations(spark, d):
    """A tab-separated table with a header, as IS-A lists come."""
    path = _path(spark, "relations")
    writers.predictions(table(spark, d, "part").select(F.col("p_name").alias("hyponym"), F.col("p_type").alias("hypernym"), F.col("p_size").cast("double").alias("freq")), path)
    return readers.relations(spark, path)


@query("format_sparse_vectors", "select p_brand as word, p_type as feature, sum(p_size)::DOUBLE as score from part group by all")
def format_sparse_vectors(spark, d):
    """Rows of equal word and feature are summed; rows without a number are left out."""
    path = _path(spark, "sparse")
    rows = table(spark, d, "part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("n"))
    rows = rows.unionAll(rows.select("p_brand", "p_type", F.lit("none")))
    rows.write.csv(path, sep="\t", quote="", escape="")
    return readers.sparse_vectors(spark, path)


@query("format_wsd_set", "select doc_id::VARCHAR as context_id, lang as target, (doc_id % 5)::INT as start, (doc_id % 5 + 3)::INT as \"end\", source as context from documents")
def format_wsd_set(spark, d):
    path = _path(spark, "wsd")
    t = table(spark, d, "documents")
    none = {c: F.lit("") for c in ("target_pos", "gold_sense_ids", "predict_sense_ids", "golden_related", "predict_related")}
    rows = t.withColumns({"context_id": F.col("doc_id").cast("string"), "target": F.col("lang"), "target_position": F.concat_ws(",", F.col("doc_id") % 5, F.col("doc_id") % 5 + 3), "context": F.col("source"), **none})
    order = ("context_id", "target", "target_pos", "target_position", "gold_sense_ids", "predict_sense_ids", "golden_related", "predict_related", "context")
    writers.predictions(rows.select(*order), path)
    return readers.wsd_set(spark, path).select("context_id", "target", "start", "end", "context")


@query("format_word_pairs", "select p_partkey::INT as id, replace(p_name, ' ', '_') as word1, p_brand as word2, p_size / 8.0::DOUBLE as score from part")
def format_word_pairs(spark, d):
    """Lists whose lines end with a separator."""
    path = _path(spark, "pairs")
    rows = _part(spark, d).select(F.concat_ws(";", "p_partkey", "name", "p_brand", F.col("p_size") / 8, F.lit("")).alias("id;word1;word2;score;"))
    rows.write.csv(path, sep="\t", header=True, quote="", escape="")
    return readers.word_pairs(spark, path)


@query("format_target_words", "select distinct unnest([replace(p_name, ' ', '_'), p_brand]) as word from part")
def format_target_words(spark, d):
    path = _path(spark, "pairs")
    rows = _part(spark, d).select(F.concat_ws(";", "p_partkey", "name", "p_brand", F.lit("1.0"), F.lit("")).alias("id;word1;word2;score;"))
    rows.write.csv(path, sep="\t", header=True, quote="", escape="")
    return readers.target_words(spark, [path, path])


@query("format_frequencies", "select p_brand as word, count(*) as freq from part group by all")
def format_frequencies(spark, d):
    """One line a word, the frequency last."""
    path = _path(spark, "frequencies")
    writers.frequencies(table(spark, d, "part").groupBy(F.col("p_brand").alias("word")).agg(F.count(F.lit(1)).alias("freq")), path)
    return spark.read.text(path).select(F.substring_index("value", " ", 1).alias("word"), F.substring_index("value", " ", -1).cast("bigint").alias("freq"))


@query("format_corpus", "select p_partkey, replace(p_name, ' ', '_') as line, 3 as n from part")
def format_corpus(spark, d):
    """A gzip-compressed corpus of tokens, read as lines and tokenised again."""
    path = _path(spark, "corpus")
    writers.tokenised(_part(spark, d).select(F.array(F.col("p_partkey").cast("string"), F.lit("x"), "name", F.lit("y")).alias("tokens")), path)
    back = readers.corpus(spark, path)
    return back.select(F.substring_index("text", " ", 1).cast("bigint").alias("p_partkey"), F.split("text", " ")[2].alias("line"), F.size("tokens").alias("n"))


@query("format_phrases", "select distinct unnest([p, upper(p[1]) || lower(p[2:]), replace(p, ' ', '_'), upper(p[1]) || lower(replace(p, ' ', '_')[2:])]) as phrase from (select p_name as p from part)")
def format_phrases(spark, d):
    path = _path(spark, "phrases")
    table(spark, d, "part").select("p_name").write.text(path)
    return readers.phrases(spark, path)


@query("format_pair_similarities", "select p_brand || p_partkey as w1, replace(p_name, ' ', '_') as w2, p_size / 64.0::DOUBLE as sim from part")
def format_pair_similarities(spark, d):
    path = _path(spark, "similarities")
    writers.pair_similarities(_part(spark, d).select(F.concat("p_brand", "p_partkey").alias("w1"), F.col("name").alias("w2"), (F.col("p_size") / 64).alias("sim")), path)
    return readers.tsv(spark, path, "w1 string, w2 string, sim double", sep=",")


def _answers(spark, d, name: str, right):
    """An evaluated file in the order of p_partkey, several parts."""
    path = _path(spark, name)
    blank = {c: F.lit("-") for c in ("target_pos", "target_position", "gold_sense_ids", "predict_sense_ids", "golden_related", "predict_related", "context")}
    rows = table(spark, d, "part").orderBy("p_partkey").select(F.lit(name).alias("context_id"), F.col("p_brand").alias("target"), *(c.alias(n) for n, c in blank.items()), right.alias("correct"))
    writers.predictions(rows, path)
    return readers.evaluated(spark, path)


@query("format_evaluated", "select p_brand as target, p_size % 3 > 0 as correct, count(*) as n from part group by all")
def format_evaluated(spark, d):
    return _answers(spark, d, "a", F.col("p_size") % 3 > 0).groupBy("target", "correct").agg(F.count(F.lit(1)).alias("n"))


@query("file_places", "select row_number() over (order by p_partkey) - 1 as place, p_brand as target, p_size % 3 > 0 as correct from part")
def file_places(spark, d):
    """The number of each line of a written folder."""
    return evaluate.placed(_answers(spark, d, "a", F.col("p_size") % 3 > 0)).select("place", "target", "correct")


@query("significance_by_place", S.SIGNIFICANCE_BY_PLACE)
def significance_by_place(spark, d):
    """Two systems' files without common ids, paired line by line."""
    left, right = _answers(spark, d, "a", F.col("p_size") % 3 > 0), _answers(spark, d, "b", (F.col("p_partkey") + F.col("p_size")) % 4 > 0)
    return evaluate.mcnemar(evaluate.joined_by_place(left, right), "a", "b")


@query("format_labelled", "select replace(p_name, ' ', '_') as word, p_partkey::VARCHAR as cid, p_brand || ':1' as cluster, p_type as isas, p_size::VARCHAR as coverage from part")
def format_labelled(spark, d):
    """Senses with hypernym labels and coverage, five named columns."""
    path = _path(spark, "labelled")
    writers.labelled(_part(spark, d).select(F.col("name").alias("word"), F.col("p_partkey").alias("cid"), F.concat("p_brand", F.lit(":1")).alias("cluster"), F.col("p_type").alias("isas"), F.col("p_size").alias("coverage")), path)
    return readers.tsv(spark, path, schemas.LABELLED, header=True)


@query("format_disambiguated", "select p_brand as word, p_size::VARCHAR as cid, string_agg(p_type || '#' || p_partkey || ':' || printf('%.3f', p_partkey / 1048576.0), ', ' order by p_partkey desc) as cluster from part group by all")
def format_disambiguated(spark, d):
    """Members by their senses, folded by falling score."""
    path = _path(spark, "disambiguated")
    writers.disambiguated(table(spark, d, "part").select(F.col("p_brand").alias("word"), F.col("p_size").alias("cid"), F.concat("p_type", F.lit("#"), "p_partkey").alias("sense"), (F.col("p_partkey") / 1048576).alias("score")), path)
    return readers.tsv(spark, path, schemas.CLUSTERS, header=True).select("word", "cid", "cluster")


@query("format_label_relations", "select replace(p_name, ' ', '_') as hypo, p_type as hyper, 'label:' || p_partkey as source from part")
def format_label_relations(spark, d):
    path = _path(spark, "label_relations")
    writers.relations(_part(spark, d).select(F.col("name").alias("hypo"), F.col("p_type").alias("hyper"), F.concat(F.lit("label:"), "p_partkey").alias("source")), path)
    return readers.tsv(spark, path, "hypo string, hyper string, source string")


@query("format_sparse_senses", "select p_brand as word, p_size::VARCHAR as cid, string_agg(p_type || p_partkey || ':' || printf('%.2f', p_size / 4.0), ', ' order by p_partkey) as features from part group by p_brand, p_size")
def format_sparse_senses(spark, d):
    path = _path(spark, "sparse_senses")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("word"), F.col("p_size").alias("cid"), F.col("p_partkey").alias("rank"), F.concat("p_type", "p_partkey").alias("feature"), (F.col("p_size") / 4).alias("score"))
    writers.sparse_senses(rows, path)
    return readers.tsv(spark, path, f"{schemas.CLUSTERS}, features string", header=True).select("word", "cid", "features")


@query("format_features", "select distinct p_brand as feature from part")
def format_features(spark, d):
    """One feature a line."""
    path = _path(spark, "features")
    writers.feature_list(table(spark, d, "part").select(F.col("p_brand").alias("feature")), path)
    return spark.read.text(path).withColumnRenamed("value", "feature")


@query("format_clusters_nulls", "select case when p_size % 2 = 0 then p_brand else '' end as word, case when p_size % 3 = 0 then p_partkey::VARCHAR else '-1' end as cid, (p_size % 5 = 0)::INT as members, count(*) as n from part where p_size % 2 = 0 or p_size % 3 = 0 or p_size % 5 = 0 group by all")
def format_clusters_nulls(spark, d):
    """Missing words, ids and clusters are filled; a line of separators only is no row."""
    path = _path(spark, "clusters")
    p = table(spark, d, "part")
    empty = F.lit("")
    rows = p.select(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(empty).alias("word"), F.when(F.col("p_size") % 3 == 0, F.col("p_partkey").cast("string")).otherwise(empty).alias("cid"), F.when(F.col("p_size") % 5 == 0, F.concat("p_type", F.lit(":0.5"))).otherwise(empty).alias("cluster"), empty.alias("isas"))
    rows.write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="")
    return readers.clusters(spark, path).groupBy("word", "cid", F.size("cluster").alias("members")).agg(F.count(F.lit(1)).alias("n"))


@query("format_vocabularies", "select distinct word from (select unnest([p_brand, p_type, 'x', 'y z', 'BRAND']) as word from part)")
def format_vocabularies(spark, d):
    """The word column of two files and three literals."""
    frames = []
    for c in ("p_brand", "p_type"):
        path = _path(spark, c)
        table(spark, d, "part").select(F.col(c).alias("word")).write.csv(path, sep="\t", header=True, quote="", escape="")
        frames.append(readers.vocabulary(spark, path))
    return readers.union_vocabulary(frames, ["x", "y z", "BRAND"])


@query("format_gold_pairs", "select p_brand as word1, p_type as word2, p_size / 8.0::DOUBLE as gold from part")
def format_gold_pairs(spark, d):
    path = _path(spark, "gold")
    table(spark, d, "part").select(F.col("p_brand").alias("word1"), F.col("p_type").alias("word2"), (F.col("p_size") / 8).alias("gold")).write.csv(path, sep="\t", header=True, quote="", escape="")
    return readers.gold_pairs(spark, path)


@query("format_csv_pairs", "select p_brand as word1, p_type as word2 from part")
def format_csv_pairs(spark, d):
    path = _path(spark, "csv")
    table(spark, d, "part").select(F.col("p_brand").alias("word1"), F.col("p_type").alias("word2")).write.csv(path, header=True, quote="", escape="")
    return readers.csv_pairs(spark, path)


@query("format_contexts", "select p_brand as word, 'a \"' || p_name || '\" context' as context from part")
def format_contexts(spark, d):
    """Contexts with quotes in them."""
    path = _path(spark, "contexts")
    table(spark, d, "part").select(F.col("p_brand").alias("word"), F.concat(F.lit('a "'), "p_name", F.lit('" context')).alias("context")).write.csv(path, sep="\t", header=True, quote="", escape="")
    return readers.contexts(spark, path)
