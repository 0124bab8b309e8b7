"""Substring deduplication by line hashing.

Every line with a word is normalised (A-Z to lower case, runs of ASCII white
space to one space, trimmed) and hashed with MD5; a caller may ask for longer lines. Digests are
grouped over all documents; the occurrence of the lowest rank (document id, then
place) stays and every other occurrence is removed. Removed spans keep their
offsets in the original text.

Skew: the first occurrence of a digest is a minimum, so a hot line arrives as
one row a task. Only digests that occur more than once are kept, in a table in
the shared folder; its join with the lines reads two tables and nothing stands
between exchange and join, so a hot digest's partition can be split at run time.

Defined results: null and empty texts have no lines; rows equal in id and text
are one document: each of its spans is one row, and ``remove`` takes it from all of them; of rows with one id and
different texts the one with the smaller text hash comes first; a null id comes
last; repeats inside a document are removed too; extra columns are carried by
``remove`` unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysema.llm.memory import begins
from polysema.tables import Scratch

_UNITS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("digest", pa.binary())])
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lines(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Start, end, words and digest of each line that is long enough; offsets in characters."""
    at = 0
    for line in text.split("\n"):
        w = line.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if len(w) >= min_words:
            yield at, at + len(line), len(w), hashlib.md5(b" ".join(w)).digest()
        at += len(line) + 1


def text_hash() -> Column:
    return F.xxhash64(F.col("text"))


def units(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """docs: doc_id, text. One row a line: doc_id, text_hash, start, end, n_words, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("lines")
        for batch in batches:
            cols: list[list] = [[] for _ in _UNITS]
            for doc, h, text in zip(*(batch.column(i) for i in range(3))):
                for found in lines(text.as_py(), min_words):
                    for c, x in zip(cols, (doc.as_py(), h.as_py(), *found)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _UNITS)], schema=_UNITS)

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, start bigint, end bigint, n_words bigint, digest binary")


def rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"), F.col("start"))


def repeats(docs: DataFrame, min_words: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """The occurrences to remove: doc_id, text_hash, start, end, n_words, digest (hex), kept_doc_id, kept_start."""
    scratch = scratch or Scratch(docs.sparkSession, "linededup")
    found = units(docs, min_words)
    firsts = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank()).alias("kept")).where("n > 1").select("digest", "kept")
    firsts = scratch.keep(firsts, "firsts")
    gone = found.join(firsts, "digest").where(rank() > F.col("kept")).select(
        "doc_id", "text_hash", "start", "end", "n_words", F.lower(F.hex("digest")).alias("digest"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start")
    )
    return gone.dropDuplicates(["doc_id", "text_hash", "start"])


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents without the spans (doc_id, text_hash, start, end) and their line ends; same columns.

    The spans of a document are few enough for a row, being lines of its text."""
    by_doc = spans.select("doc_id", "text_hash", "start", "end").distinct().groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    d, s = docs.alias("d"), by_doc.hint("merge").alias("s")  # grows with the documents, so it is shuffled at every size
    joined = d.join(s, F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64("d.text") == F.col("s.text_hash")), "left")
    cut = F.col("s.spans")
    parts = F.expr(
        "array_join(transform(sequence(0, size(s.spans)), i -> substring(d.text, cast(if(i = 0, 0, s.spans[i - 1].end + 1) as int) + 1, "
        "cast(greatest(if(i = size(s.spans), length(d.text), s.spans[i].start) - if(i = 0, 0, s.spans[i - 1].end + 1), 0) as int))), '')"
    )
    text = F.when(cut.isNull(), F.col("d.text")).otherwise(parts)
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns))
