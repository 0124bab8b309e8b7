"""Bounded labelled samples for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 4; remainder 2 is held out. A null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 2


def labelled_texts(docs: DataFrame, labels: DataFrame, per_class: int) -> list[tuple[int, object, str]]:
    """(doc_id, label, text) of at most per_class labelled documents a class, outside the held-out
    part, in the order of a hash of doc_id; the same rows however the tables are partitioned.

    docs: doc_id, text. labels: doc_id, label. The ids are picked from the narrow table first (each
    task keeps per_class rows a class), so that one scan brings only the texts that are used.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    classes = sorted(r[0] for r in one.select("label").distinct().collect())  # as many as there are classes
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = [(r[0], c) for c in classes for r in one.where(F.col("label") == F.lit(c)).select("doc_id").orderBy(*order).limit(per_class).collect()]
    if not picked:
        return []
    kind = labels.schema["label"].dataType.simpleString()
    ids = F.broadcast(docs.sparkSession.createDataFrame(picked, f"doc_id bigint, label {kind}"))  # per_class rows a class at most
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return sorted((r["doc_id"], r["label"], r["text"]) for r in rows)
