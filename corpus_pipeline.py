"""Documents to token ids in five stages, each written as Parquet and read again.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all that the
stage before kept; all but the last return the columns of ``documents``.

quality: documents that the compression classifier rejects go, empty ones too.
near_duplicates: of documents linked by 75 % of their word shingles one stays.
lines: repeated lines and repeated passages of 50 words or more go, except their first occurrence.
benchmark: documents that hold a test item go.
tokens: ids and the decoded text as digests, one row a document.

Defined results: null and empty texts score 0 and go with the first stage, as do
all texts where no label is good; repeated rows of a document leave one row; of
linked documents the smallest doc_id stays, a null id only if there is no other;
of a repeated line or passage the occurrence of the smallest doc_id stays, then
the first in it; texts of any length are taken whole; further columns of
``documents`` are carried unchanged up to the last stage, whatever their names;
n_chars is counted anew; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysema.llm import bpe, decontamination, jaccard, passages, quality
from polysema.llm.queries import TEXT_ROWS, tokenizer_spec
from polysema.tables import Scratch, table


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """A stage's frame is evaluated after it returns, so the setting stays until the caller sets it back, as run() does."""
    spark.conf.set(BATCH, TEXT_ROWS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return jaccard.one_of_each(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    cut = passages.remove(docs, passages.repeats(docs.select("doc_id", "text")))
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return bpe.encode_texts(docs, tokenizer_spec(), ids=False, digests=True)


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("lines", lines), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL can't express compression, nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(BATCH, before)
    return docs
