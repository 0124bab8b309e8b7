"""Term frequencies over a growing corpus folder (an extra, not one of the batch engine's own operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysema.functions import text as X


def lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """text of every line of new files; the stream takes a bounded number of files at a time."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).withColumnRenamed("value", "text")


def term_frequencies(stream: DataFrame) -> DataFrame:
    """word, freq so far; the state is one row a word, so write it in update mode."""
    return stream.select(F.explode(X.tokenize(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
