"""Instances of target words in texts, with the known words around them.

Targets and known words are each a trie (see ``phrases``); a text goes once through both, and each
occurrence of a target leaves the text as one row with a bounded context. Texts are not
shuffled, and no text is repeated for its instances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.operators.phrases import BUDGET, taken, with_longest


def found_in_texts(docs: DataFrame, targets: DataFrame, vocabulary: DataFrame, window: int = 10, stop: DataFrame | None = None, text: str = "text", budget: int = BUDGET) -> DataFrame:
    """ctx_id, doc_id, target, start, end, words array<string>: every occurrence of a target in the texts, left to right, the longest
    first, none inside another.

    docs: doc_id, text. targets, vocabulary, stop: word; phrases are joined by underscores. start, end: of the target, in
    characters. words: the known words nearest to it, ``window`` on each side, each once, without stop words; unknown words don't count for
    the window, stop words do. A word is an alphabetic token. ctx_id is a hash of document, text and place; equal rows of docs have equal
    instances, which come once for each. Null and empty texts have none."""
    as_phrases = lambda df: df.select(F.col("word").alias("phrase"))
    single = as_phrases(vocabulary.where(~F.col("word").contains("_")))
    rows = with_longest(docs, single, X.tokenize(F.col(text)), ["doc_id", text], 1, budget).select("doc_id", text, F.col("n").alias("known"))
    marks = ["known"]
    if stop is not None:
        rows = with_longest(rows, as_phrases(stop), X.tokenize(F.col(text)), ["doc_id", text, "known"], 1, budget).select("doc_id", text, "known", F.col("n").alias("stop"))
        marks.append("stop")
    rows = with_longest(rows, as_phrases(targets), X.tokenize(F.col(text)), ["doc_id", text, *marks], 1, budget)
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = rows.select("doc_id", text, "tokens", "n", *marks, F.xxhash64(text).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            ids, bodies, lists, n, known, *rest = (batch.column(i) for i in range(batch.num_columns))
            stops, h = (rest[0], rest[1]) if len(rest) == 2 else (None, rest[0])
            for k in range(batch.num_rows):
                length = n[k].values.to_numpy() if n[k].is_valid else np.zeros(0, int)
                at = taken(length)
                if not at:
                    continue
                body, tokens, place, starts = bodies[k].as_py(), lists[k].as_py(), 0, []
                for w in tokens:  # what stands between tokens holds no token
                    place = body.index(w, place)
                    starts.append(place)
                    place += len(w)
                places = np.flatnonzero(known[k].values.to_numpy() == 1)
                out = set() if stops is None else set(np.flatnonzero(stops[k].values.to_numpy() == 1).tolist())
                for i in at:
                    j = i + int(length[i])
                    a, b = np.searchsorted(places, (i, j))
                    near = [p for p in (*places[max(0, a - window) : a].tolist(), *places[b : b + window].tolist()) if p not in out]
                    row = ids[k].as_py(), h[k].as_py(), "_".join(tokens[i:j]), starts[i], starts[j - 1] + len(tokens[j - 1]), list(dict.fromkeys(tokens[p] for p in near))
                    for c, x in zip(cols, row):
                        c.append(x)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "h", "target", "start", "end", "words"])

    found = hashed.mapInArrow(run, f"doc_id {kind}, h bigint, target string, start int, end int, words array<string>")
    return found.select(F.xxhash64("doc_id", "h", "start").alias("ctx_id"), "doc_id", "target", "start", "end", "words")
