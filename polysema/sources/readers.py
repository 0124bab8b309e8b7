"""Readers of the text formats. Paths may be files, folders, globs or compressed files, in any store Spark reads."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.sources import schemas


def tsv(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t") -> DataFrame:
    """Separated text without quoting; lines with another number of fields are left out."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, quote="", escape="", mode="DROPMALFORMED", enforceSchema=True)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """text, tokens: one row a line."""
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return lines.withColumn("tokens", X.tokenize(F.col("text")))


def _vector_lines(spark: SparkSession, path: str, size: int | None) -> DataFrame:
    """value, f (fields) of the lines that hold a vector: as many numbers as most lines, or as given, have.

    The header (``n d``) has another length; of vectors of one number it is the line that tells their count."""
    lines = spark.read.text(path).withColumn("f", F.split(F.rtrim("value"), " "))
    if size is None or size == 1:
        found = lines.groupBy(F.size("f").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1).collect()  # one row
        size, n = (found[0]["k"] - 1, found[0]["count"]) if found else (0, 0)
        if size == 1:
            lines = lines.where(F.col("value") != f"{n - 1} 1")
    return lines.where(F.size("f") == size + 1)


def word2vec_text(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """word, v. The header and lines of another length or with what is no number are left out. A known
    size of the vectors (above 1) saves a pass that counts the lines' lengths."""
    lines = _vector_lines(spark, path, size)
    return lines.select(F.col("f")[0].alias("word"), F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: x.try_cast("float")).alias("v")).where(~F.exists("v", lambda x: x.isNull()))


def word2vec_vocabulary(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """word: the first field of each line but the header; the numbers are not parsed."""
    return _vector_lines(spark, path, size).select(F.col("f")[0].alias("word"))


def word2vec_binary(spark: SparkSession, path: str) -> DataFrame:
    """word, v of binary files (a file is decoded by one task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                at = data.index(b"\n")
                n, d = map(int, data[:at].split())
                at += 1
                words, rows = [], []
                for _ in range(n):
                    end = data.index(b" ", at)
                    words.append(data[at:end].strip().decode("utf-8", "ignore"))
                    rows.append(np.frombuffer(data, "<f4", d, end + 1).tolist())
                    at = end + 1 + struct.calcsize("f") * d
                    if len(words) == 10_000:
                        yield pa.RecordBatch.from_pydict({"word": words, "v": pa.array(rows, pa.list_(pa.float32()))})
                        words, rows = [], []
                yield pa.RecordBatch.from_pydict({"word": words, "v": pa.array(rows, pa.list_(pa.float32()))})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "word string, v array<float>")


def edges(spark: SparkSession, path: str) -> DataFrame:
    rows = tsv(spark, path, schemas.EDGES)
    return rows.select(X.strip(F.col("src")).alias("src"), X.strip(F.col("dst")).alias("dst"), F.col("weight").try_cast("double").alias("weight")).where("weight is not null and src is not null and dst is not null")


def clusters(spark: SparkSession, path: str, vocabulary: DataFrame | None = None, prob: bool = False, strip_sense: bool = False) -> DataFrame:
    """word, cid, (prob,) cluster, isas with parsed members; a word may be restricted to a vocabulary."""
    rows = tsv(spark, path, schemas.CLUSTERS_PROB if prob else schemas.CLUSTERS, header=True).fillna("", ["word", "cluster", "isas"]).fillna("-1", ["cid"])
    if vocabulary is not None:
        rows = rows.join(vocabulary.select("word"), "word", "left_semi")
    return rows.withColumns({c: X.parse_cluster(F.col(c), strip_sense) for c in ("cluster", "isas")})


def inventory(spark: SparkSession, path: str, senses: DataFrame | None = None) -> DataFrame:
    """word, cid, prob. If the file is missing and senses (sense) are given: their ids with exactly one #, prior 1."""
    try:
        rows = tsv(spark, path, schemas.INVENTORY).withColumn("s", X.parse_sense(F.col("sense")))
    except AnalysisException:  # no such path
        if senses is None:
            raise
        one = senses.where(F.size(F.split("sense", "#")) == 2).withColumn("s", X.parse_sense(F.col("sense")))
        return one.where("s is not null").select("s.word", "s.cid", F.lit(1.0).alias("prob"))
    return rows.select("s.word", "s.cid", F.col("prob").try_cast("double").alias("prob")).where("word is not null and prob is not null")


def keyword_inventory(spark: SparkSession, path: str) -> DataFrame:
    rows = tsv(spark, path, schemas.KEYWORD_INVENTORY, header=True)
    return rows.withColumn("cluster", F.transform(F.split("cluster", ","), lambda x: F.trim(x)))


def relations(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.RELATIONS, header=True)


def sparse_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, feature, score; duplicates summed, unreadable rows left out, no order needed."""
    rows = tsv(spark, path, schemas.SPARSE).withColumn("score", F.col("score").try_cast("double")).where("score is not null")
    return rows.groupBy("word", "feature").agg(F.sum("score").alias("score"))


def wsd_set(spark: SparkSession, path: str) -> DataFrame:
    """The test set with start and end of the target."""
    span = X.parse_span(F.col("target_position"))
    return tsv(spark, path, schemas.WSD_SET, header=True).withColumns({"start": span["start"], "end": span["end"]})


def evaluated(spark: SparkSession, path: str, extra: str = "correct boolean") -> DataFrame:
    return tsv(spark, path, f"{schemas.WSD_SET}, {extra}", header=True)


def word_pairs(spark: SparkSession, path: str) -> DataFrame:
    """id, word1, word2, score of ;-separated lists, whose lines end with a separator."""
    return tsv(spark, path, schemas.WORD_PAIRS, header=True, sep=";").drop("_empty")


def target_words(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct words of several pair lists."""
    both = reduce(DataFrame.unionAll, [word_pairs(spark, p) for p in paths])
    return both.select(F.explode(F.array("word1", "word2")).alias("word")).distinct()


def gold_pairs(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.GOLD_PAIRS, header=True)


def csv_pairs(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.CSV_PAIRS, header=True, sep=",")


def contexts(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, schemas.CONTEXTS, header=True)


def vocabulary(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    words = tsv(spark, path, schemas.VOCABULARY, header=True)
    return words.select((X.csv_clean(F.col("word")) if clean else F.col("word")).alias("word")).distinct()


def union_vocabulary(frames: list[DataFrame], literals: list[str] = ()) -> DataFrame:
    """Distinct ``word`` of several frames and some literals."""
    spark = frames[0].sparkSession
    own = spark.createDataFrame([(w,) for w in literals], "word string")
    return reduce(DataFrame.unionAll, [*(f.select("word") for f in frames), own]).distinct()


def phrases(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.select(F.explode(X.phrase_variants(F.col("value"))).alias("phrase")).where("phrase <> ''").distinct()
