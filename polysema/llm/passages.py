"""Substring deduplication: repeated lines of any length by ``linededup``, and repeated passages that are no lines.

Lines are those of ``linededup`` with at least one word. A passage is a run of
WIDTH words or more of one text, wherever it begins and ends: every window of
WIDTH words that occurred before (in the order of ``linededup.rank``) goes, unless
it overlaps its own first occurrence or all of its words stand in removed lines.
A removed word always has an earlier copy, so of every text one copy is kept.

Method: winnowing. Of each window the k-gram with the smallest hash is its anchor;
equal windows have equal anchors, so only windows whose anchor occurs twice are
written out and compared, by 128-bit hashes of all their words. Windows whose
words all stand in removed lines take no part, so they have no anchor either:
a line or a text that is common as a whole leaves the anchors of one occurrence.
Nothing is sampled.

Defined results: as in ``linededup``; words are those of ``shingles``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polysema.llm import linededup
from polysema.llm.linededup import text_hash
from polysema.llm.memory import begins
from polysema.llm.shingles import _LOWER, _SPACE, mix, powers, word_hashes
from polysema.tables import Scratch

#: Words of a passage at least, and of the k-grams among which a window's anchor is chosen.
WIDTH, GRAM = 50, 25
#: Rows that are handed to Spark at a time.
ROWS = 100_000

_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

_ANCHORS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("anchor", pa.int64()), ("at", pa.int32())])
_WINDOWS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in characters."""
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    a = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[a], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    if len(data) != len(text):
        edge = np.concatenate(([0], np.cumsum((a & 0xC0) != 0x80)))[edge]
    return edge[::2], edge[1::2]


def rolling(w: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every run of that many words."""
    n = len(w)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * powers(base, n), dtype=np.uint64)))
    return mix((sums[width:] - sums[:-width]) * powers(pow(base, -1, 1 << 64), n)[: n - width + 1])


def candidates(text: str) -> tuple | None:
    """Word hashes, k-gram hashes, and the k-gram that is each window's anchor."""
    w = word_hashes(text)
    if len(w) < WIDTH:
        return None
    grams = rolling(w, GRAM, _FIRST)
    return w, grams, np.lib.stride_tricks.sliding_window_view(grams, WIDTH - GRAM + 1).argmin(1) + np.arange(len(w) - WIDTH + 1)


def _mapped(df: DataFrame, schema: pa.Schema, ddl: str, rows) -> DataFrame:
    """df: doc_id, text_hash, text, more columns for rows(text, ...), which gives the other columns as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("lines")
        for batch in batches:
            held, n = [], 0
            for doc, h, text, *rest in zip(*(batch.column(i) for i in range(batch.num_columns))):
                found = rows(text.as_py(), *(x.as_py() for x in rest))
                if found is not None and (m := len(found[0])):
                    held.append(pa.RecordBatch.from_arrays([pa.repeat(doc, m), pa.repeat(h, m), *(pa.array(x, f.type) for x, f in zip(found, list(schema)[2:]))], schema=schema))
                    n += m
                if n >= ROWS:
                    yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                    held, n = [], 0
            if held:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()

    return df.mapInArrow(run, ddl)


def _free(text: str, cut: list[dict] | None, n: int) -> np.ndarray:
    """Whether each of the n windows has a word outside the removed lines."""
    if not cut:
        return np.ones(n, bool)
    start = places(text)[0]
    gone = np.zeros(len(start) + 1, np.int64)
    for line in cut:
        gone[np.searchsorted(start, [line["start"], line["end"]])] += (1, -1)
    left = np.concatenate(([0], np.cumsum(np.cumsum(gone[:-1]) == 0)))
    return left[WIDTH:] > left[:n]


def _anchors(text: str, cut: list[dict] | None) -> tuple | None:
    found = candidates(text)
    if found is None:
        return None
    _, grams, chosen = found
    at = np.unique(chosen[_free(text, cut, len(chosen))])
    return grams[at].view(np.int64), at.astype(np.int32)


def _windows(text: str, cut: list[dict] | None, at: list[int]) -> tuple | None:
    """The windows of the anchors at these places that have a word outside the removed lines."""
    w, _, chosen = candidates(text)
    i = np.flatnonzero(np.isin(chosen, at) & _free(text, cut, len(chosen)))
    start, end = places(text)
    h1, h2 = rolling(w, WIDTH, _FIRST)[i], rolling(mix(w ^ np.uint64(_SECOND)), WIDTH, _SECOND)[i]
    return i, start[i], end[i + WIDTH - 1], h1.view(np.int64), h2.view(np.int64)


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def repeats(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The spans to remove: doc_id, text_hash, unit (line or passage), start, end, n_words, digest (hex), kept_doc_id, kept_start.

    A passage is as long as its windows and their first occurrences go on side by side."""
    scratch = scratch or Scratch(docs.sparkSession, "passages")
    lines = scratch.keep(linededup.repeats(docs, 1, scratch), "lines")
    cut = lines.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("cut"))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    # tables of documents grow with them, so they are shuffled at every size
    told = texts.alias("d").join(cut.hint("merge").alias("c"), _same("d", "c"), "left").select("d.doc_id", "d.text_hash", "text", "cut")
    anchors = scratch.keep(_mapped(told, _ANCHORS, "doc_id bigint, text_hash bigint, anchor bigint, at int", _anchors), "anchors")
    twice = scratch.keep(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "twice")
    at = scratch.keep(anchors.join(twice, "anchor").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("at")), "at")
    again = told.alias("d").join(at.hint("merge").alias("a"), _same("d", "a")).select("d.doc_id", "d.text_hash", "text", "cut", "at")
    windows = _mapped(again, _WINDOWS, "doc_id bigint, text_hash bigint, word bigint, start bigint, end bigint, h1 bigint, h2 bigint", _windows)
    windows = scratch.keep(windows, "windows")
    firsts = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_order(), "word")).alias("first")).where("n > 1")
    for t in (anchors, twice, at):
        scratch.drop(t)
    kept = F.struct(*(F.col(f"first.{c}").alias(c) for c in ("no_id", "doc_id", "text_hash", "start")))
    firsts = scratch.keep(firsts.select("h1", "h2", kept.alias("kept"), F.col("first.word").alias("kept_word")), "firsts")
    own = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash")) & (F.col("word") < F.col("kept_word") + WIDTH)
    gone = windows.join(firsts, ["h1", "h2"]).where((linededup.rank() > F.col("kept")) & ~own)
    run = [F.col("doc_id"), F.col("text_hash"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.text_hash").alias("kept_text_hash"), (F.col("word") - F.col("kept_word")).alias("apart")]
    gone = gone.select(*run, "word", "start", "end", F.col("kept.start").alias("kept_start"), "h1", "h2")
    keys = ["doc_id", "text_hash", "kept_doc_id", "kept_text_hash", "apart"]
    island = (F.col("word") - F.dense_rank().over(Window.partitionBy(*keys).orderBy("word"))).alias("island")
    digest = F.concat(*(F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("first.h1", "first.h2")))
    runs = gone.select("*", island).groupBy(*keys, "island").agg(F.min(F.struct("word", "start", "kept_start", "h1", "h2")).alias("first"), F.max("word").alias("last"), F.max("end").alias("end"))
    found = runs.select("doc_id", "text_hash", F.lit("passage").alias("unit"), F.col("first.start").alias("start"), "end", (F.col("last") - F.col("first.word") + WIDTH).alias("n_words"), digest.alias("digest"), "kept_doc_id", F.col("first.kept_start").alias("kept_start"))
    whole = lines.select("doc_id", "text_hash", F.lit("line").alias("unit"), "start", "end", "n_words", "digest", "kept_doc_id", "kept_start")
    return whole.unionByName(found)


def _order() -> list:
    return [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"), F.col("start")]


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents without the spans; a line goes with its line end, a passage leaves the white space around it."""
    stop = F.when(F.col("unit") == "line", F.col("end") + 1).otherwise(F.col("end"))
    one = spans.select("doc_id", "text_hash", "start", stop.alias("stop")).distinct()
    by = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = one.withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("part", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = fresh.groupBy("doc_id", "text_hash", "part").agg(F.min("start").alias("start"), (F.max("stop") - 1).alias("end"))
    return linededup.remove(docs, joined)


#: Columns of the registered query: one row a removed span. Words with their separators give
#: offsets and line numbers; windows are grouped by the MD5 of their words.
ORACLE_SQL = rf"""
with docs as (
  select distinct doc_id, text from documents where text is not null
), cut as (
  select doc_id, string_split(text, chr(10)) as l from docs
), placed as (
  select doc_id, unnest(l) as line, unnest(range(len(l))) as i, l from cut
), sized as (
  select doc_id, i, line, coalesce(list_sum(list_transform(l[1:i], lambda x: length(x) + 1)), 0)::BIGINT as start from placed
), normal as (
  select doc_id, i, start, (start + length(line))::BIGINT as "end",
    list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') as w from sized
), ranked as (
  select doc_id, i, start, "end", len(w)::BIGINT as n_words, first_value(doc_id) over o as kept_doc_id, first_value(start) over o as kept_start, row_number() over o as r
  from normal where len(w) > 0 window o as (partition by md5(array_to_string(w, ' ')) order by doc_id, start)
), gone_lines as (
  select * from ranked where r > 1
), pieces as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]*[^ 	-
]+') as p from docs
), each as (
  select doc_id, p, unnest(p) as piece, unnest(range(len(p))) as k from pieces
), word as (
  select doc_id, k, regexp_replace(piece, '^[ 	-
]+', '') as w, sum(length(piece)) over o as "end", sum(length(piece) - length(replace(piece, chr(10), ''))) over o as i
  from each window o as (partition by doc_id order by k)
), told as (
  select word.doc_id, k, w, "end" - length(w) as start, word."end", g.doc_id is null as free
  from word left join (select doc_id, i from gone_lines) g on g.doc_id = word.doc_id and g.i = word.i
), whole as (
  select doc_id, list(w order by k) as ws from told group by doc_id
), seen as (
  select doc_id, k, start, lead("end", {WIDTH - 1}) over (partition by doc_id order by k) as "end",
    sum(free::INT) over (partition by doc_id order by k rows between current row and {WIDTH - 1} following) as n_free from told
), windows as (
  select doc_id, k, start, "end", md5(array_to_string(ws[k + 1:k + {WIDTH}], ' ')) as h from seen join whole using (doc_id) where "end" is not null and n_free > 0
), first as (
  select *, first_value(doc_id) over o as kept_doc_id, first_value(k) over o as kept_k, first_value(start) over o as kept_start, row_number() over o as r
  from windows window o as (partition by h order by doc_id, start)
), gone as (
  select *, k - kept_k as apart, k - row_number() over (partition by doc_id, kept_doc_id, k - kept_k order by k) as island
  from first where r > 1 and not (doc_id = kept_doc_id and k < kept_k + {WIDTH})
)
select doc_id, 'line' as unit, start, "end", n_words, kept_doc_id, kept_start from gone_lines
union all
select doc_id, 'passage', min(start)::BIGINT, max("end")::BIGINT, (max(k) - min(k) + {WIDTH})::BIGINT, kept_doc_id, min(kept_start)::BIGINT from gone group by doc_id, kept_doc_id, apart, island
"""
