"""Benchmark decontamination: BM25 over test items, searched with block-max WAND.

The test items are indexed: for each word a list of the items that hold it, with
the word's BM25 impact in the item as a share of the item's own total, cut into
blocks with their largest impact. Every training document is cut into passages
that overlap by the longest item, so that some passage holds any item whole.
Every passage is a query: block-max WAND returns all items whose score is at
least MIN_SCORE, leaving out only items whose upper bound stays below. Retrieved
items are verified: of the question's word trigrams at least MIN_QUESTION, and
of the answer's at least MIN_ANSWER must occur in the passage. The answer is
what follows an ``Answer:`` mark, else the item's last sentence.

The index is broadcast in parts of about PART_WORDS item words, one part after
the other, so that no task and no driver holds more than one of them, whatever
the number of items; document frequencies are over all items, counted by Spark
over the words that the search takes. Documents are not shuffled.

Defined results: null and empty documents and items match nothing; an item of
fewer than three words is verified by its word sequence; repeated documents give
repeated matches, repeated item ids are one match with the best score; extra
columns are ignored; an empty table gives no matches.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polysema.tables import Scratch
from polysema.llm.memory import begins

MIN_SCORE, MIN_QUESTION, MIN_ANSWER = 0.6, 0.6, 0.6
K1, B, BLOCK, PART_WORDS, GRAM = 1.2, 0.75, 8, 1_000_000, 3
#: Shortest overlap of passages; a longer item raises it.
LEAST_STEP = 64
END = 1 << 62

words = re.compile(r"\w+").findall


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of both parts; an item of a single sentence is all question."""
    marked = re.split(r"\banswer\s*:", text, maxsplit=1, flags=re.I)
    if len(marked) == 2:
        return words(marked[0].lower()), words(marked[1].lower())
    cut = [s for s in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if words(s)]
    return (words(text.lower()), []) if len(cut) < 2 else (words(" ".join(cut[:-1]).lower()), words(cut[-1].lower()))


def grams(w: list[str]) -> frozenset[tuple[str, ...]]:
    return frozenset(tuple(w[i : i + GRAM]) for i in range(max(1, len(w) - GRAM + 1))) if w else frozenset()


@dataclass
class Index:
    """Items in order of length, BLOCK of them a block, so that a block's impacts are alike.
    Terms are numbered in the order of their largest impacts.

    Term t has the entries start[t]..start[t + 1]: block, largest impact in it, and the
    postings first[e]..first[e + 1] (item, impact) inside the block. Entry e is of term[e];
    by_block[block_start[g]..block_start[g + 1]] are the entries of block g."""

    items: list[tuple[int, frozenset, frozenset]]  # item_id, grams of question and of answer
    terms: dict[str, int]
    start: np.ndarray
    block: np.ndarray
    most: np.ndarray
    first: list[int]
    posted: list[tuple[int, float]]
    top: np.ndarray  # largest impact of each term, 0 at the end for words that no item holds
    step: int
    term: np.ndarray
    by_block: np.ndarray
    block_start: np.ndarray
    asked: np.ndarray  # of each term, all false between searches


def build(items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float) -> Index:
    """df, n, mean: document frequencies, number and mean length of all items."""
    lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
    kept, longest = [], LEAST_STEP
    cut = [(item_id, *question_and_answer(text)) for item_id, text in items]
    for item_id, question, answer in sorted(cut, key=lambda x: (len(x[1]) + len(x[2]), x[0])):
        w = question + answer
        if not w:
            continue
        longest = max(longest, len(w))
        tf = Counter(w)
        raw = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
        total = sum(raw.values())
        for t, x in raw.items():
            lists[t].append((len(kept), float(x / total)))
        kept.append((item_id, grams(question), grams(answer)))
    terms = {t: i for i, t in enumerate(sorted(lists, key=lambda t: (max(x for _, x in lists[t]), t)))}
    start, block, most, first, posted = [0], [], [], [0], []
    for t in terms:
        for g, part in groupby(lists[t], lambda x: x[0] // BLOCK):
            own = list(part)
            block.append(g)
            most.append(max(x for _, x in own))
            posted += own
            first.append(len(posted))
        start.append(len(block))
    top = np.array([max(x for _, x in lists[t]) for t in terms] + [0.0])
    block, term = np.array(block, np.int64), np.repeat(np.arange(len(terms)), np.diff(start))
    block_start = np.searchsorted(np.sort(block), np.arange(block.max() + 2 if len(block) else 1))
    return Index(kept, terms, np.array(start), block, np.array(most), first, posted, top, longest, term, np.argsort(block, kind="stable"), block_start, np.zeros(len(terms), bool))


def ranges(start: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The numbers start[k]..start[k + 1] of all keys."""
    first = start[keys]
    counts = start[keys + 1] - first
    end = counts.cumsum()
    return (first - end + counts).repeat(counts) + np.arange(end[-1])


def block_max_wand(query: np.ndarray, index: Index, least: float) -> list[tuple[int, float]]:
    """All items whose impacts over the query's distinct terms (rising) sum to at least `least`.

    The terms of the smallest impacts, which together stay below half the threshold, find
    no block: only the other terms' lists say which blocks of items are looked at, and a
    block goes if its maxima of these and all that the others can add stay below. Of the
    blocks left the maxima of all terms are summed, and in those that may reach the
    threshold the lists are walked by pivots, with the block maxima as their bounds."""
    found, low = [], least - 1e-9
    rest = index.top[query].cumsum()  # what a term and all lesser ones can add
    if not len(query) or rest[-1] < low:
        return found
    weak = int(rest.searchsorted(low / 2))
    entries = ranges(index.start, query[weak:])
    bounds = np.bincount(index.block[entries], index.most[entries])
    blocks = np.flatnonzero(bounds >= low - (rest[weak - 1] if weak else 0.0))
    if not len(blocks):
        return found
    entries = index.by_block[ranges(index.block_start, blocks)]
    index.asked[query] = True
    entries = entries[index.asked[index.term[entries]]]
    index.asked[query] = False
    of_block = index.block[entries]
    bounds = np.bincount(of_block, index.most[entries], minlength=blocks[-1] + 1)[blocks]
    for g in blocks[bounds >= low]:
        # a cursor: item, place, end, bound
        cursors = [[index.posted[index.first[e]][0], index.first[e], index.first[e + 1], index.most[e]] for e in entries[of_block == g].tolist()]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= low:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = sum(index.posted[c[1]][1] for c in cursors if c[0] == item)
                if score >= low:
                    found.append((item, score))
                item += 1
            for c in cursors:
                while c[0] < item:
                    c[1] += 1
                    c[0] = index.posted[c[1]][0] if c[1] < c[2] else END
            cursors = [c for c in cursors if c[0] != END]
    return found


def share(part: frozenset, there: set) -> float:
    return sum(g in there for g in part) / len(part) if part else 1.0


def search(text: str | None, index: Index) -> list[tuple[int, float, float, float, int]]:
    """item_id, score, question overlap, answer overlap and first word of the best passage of each verified item."""
    if not text or not index.items:
        return []
    w = words(text.lower())
    none, step = len(index.terms), index.step
    ids = np.fromiter(map(index.terms.get, w, repeat(none)), np.int64, len(w))
    starts = np.arange(0, max(1, len(w) - step), step)  # passages of 2 steps; the last one ends the text
    ends = np.minimum(starts + 2 * step, len(w))
    sums = np.concatenate(([0.0], np.cumsum(index.top[ids])))
    best: dict[int, tuple[int, float, float, float, int]] = {}
    for s, e in zip(starts[live := sums[ends] - sums[starts] >= MIN_SCORE - 1e-9], ends[live]):  # bounds of the whole lists
        query = np.unique(ids[s:e])
        query = query[query < none]
        there = None
        for k, score in block_max_wand(query, index, MIN_SCORE):
            item_id, question, answer = index.items[k]
            if there is None:
                there = {tuple(w[i : i + GRAM]) for i in range(s, e)}
            short = {tuple(w[i : i + m]) for m in {len(g) for g in question | answer} - {GRAM} for i in range(s, e)}
            q, a = share(question, there | short if short else there), share(answer, there | short if short else there)
            if q >= MIN_QUESTION and a >= MIN_ANSWER and (item_id not in best or score > best[item_id][1] + 1e-12):
                best[item_id] = item_id, float(score), q, a, int(s)
    return [best[i] for i in sorted(best)]


def counted(items: DataFrame) -> DataFrame:
    """items: item_id, text. Adds the number of words and the distinct words, as the search takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("decontamination")
        for batch in batches:
            found = [words(t.as_py().lower()) for t in batch.column(1)]
            more = [pa.array([len(w) for w in found], pa.int64()), pa.array([sorted(set(w)) for w in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["item_id", "text", "n_words", "words"])

    return items.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("words", T.ArrayType(T.StringType()))]))


def indexes(items: DataFrame, item_col: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The index in parts of about PART_WORDS words (a longer item makes its part longer), one at a time."""
    rows = counted(items.where(F.col(text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(text).alias("text")).distinct())
    n, total = rows.select(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts = max(1, -(-total // PART_WORDS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    freq = dealt.select("part", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.collect_set("part").alias("parts"))
    for p in range(parts):
        own = sorted((r["item_id"], r["text"]) for r in dealt.where(F.col("part") == p).select("item_id", "text").collect())
        df = {r["word"]: r["df"] for r in freq.where(F.array_contains("parts", F.lit(p).cast("bigint"))).select("word", "df").collect()}
        yield build(own, df, n, max(1.0, total / max(1, n)))


MATCH = "item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint"


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id_col, item_id, score, question_overlap, answer_overlap, first_word of every verified match."""
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = scratch or Scratch(docs.sparkSession, "decontamination")
    found = []
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # of about PART_WORDS item words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            begins("decontamination")
            for batch in batches:
                ids, cols = [], [[] for _ in range(5)]
                for doc, t in zip(batch.column(0), batch.column(1)):
                    for row in search(t.as_py(), shared.value):
                        ids.append(doc.as_py())
                        for c, x in zip(cols, row):
                            c.append(x)
                types = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(cols, types))], [id_col, *(x.split()[0] for x in MATCH.split(", "))])

        found.append(scratch.keep(docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, {MATCH}"), "matches"))
        shared.unpersist()
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The documents without a verified match, all columns as they are, whatever their names: a map without a
    shuffle. Between the parts of a large index the documents that are left are written and read again."""
    scratch = scratch or Scratch(docs.sparkSession, "decontamination")
    out, at, before = docs, docs.columns.index(text), None
    schema = T.StructType(docs.schema.fields)
    for index in indexes(items):
        if before is not None:
            out = scratch.keep(out, "left")
            before.unpersist()
        before = shared = docs.sparkSession.sparkContext.broadcast(index)  # of about PART_WORDS item words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            begins("decontamination")
            for batch in batches:
                yield batch.filter(pa.array([not search(t.as_py(), shared.value) for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out
