"""Queries of the training-data operators with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysema.llm import alignment, ann, bpe, decontamination, html, jaccard, langid, passages, periodic, quality, sharding, simhash, urlfilter
from polysema.llm.sampling import held_out
from polysema.tables import table

#: Rows that an Arrow batch of whole texts may have; bounds a Python worker's memory.
TEXT_ROWS = "512"
TOKENIZER = "word_bpe_49k.json"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer file's content; by default the public file by name."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def aligned_specs(a: str | None = None, b: str | None = None) -> tuple[str, bytes]:
    """Contents of the two tokenizer files that are aligned; by default the public files by name."""
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path(ALIGNED[0]), b or public_tokenizers.path(ALIGNED[1])
    with open(a, encoding="utf-8") as x, open(b, "rb") as y:
        return x.read(), y.read()


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
    return table(spark, sf_dir, name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it holds."""
    return decontamination.matches(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(texts(spark, sf_dir, "documents"), tokenizer_spec(), ids=False, digests=True)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), 10, lambda vec_id: vec_id % 100 == 0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.manifest(table(spark, sf_dir, "documents"), shards=8)


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each removed span, with its place and the place that is kept: repeated lines, and repeated passages wherever they stand."""
    return passages.repeats(texts(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash", "digest")


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is its row in ``labels`` (doc_id = page_id): good if of quality and not toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    good = F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(good)
    outcomes = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", "good")
    return urlfilter.judge(pages, outcomes, urlfilter.RULES)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(texts(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(texts(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.add_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned_documents(texts(spark, sf_dir, "documents"), *aligned_specs())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(texts(spark, sf_dir, "documents"))
    return periodic.periodic_runs(docs, runs=False, text=False, digests=True)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(texts(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_bpe": op2_bpe,
        "op3_ann": op3_ann,
        "op4_sharding": op4_sharding,
        "op5_linededup": op5_linededup,
        "op6_urlfilter": op6_urlfilter,
        "op7_langid": op7_langid,
        "op8_jaccard": op8_jaccard,
        "op9_html": op9_html,
        "op10_quality": op10_quality,
        "op11_alignment": op11_alignment,
        "op12_runs": op12_runs,
        "op13_simhash": op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.ORACLE_SQL, "op5_linededup": passages.ORACLE_SQL, "op6_urlfilter": urlfilter.ORACLE_SQL}
