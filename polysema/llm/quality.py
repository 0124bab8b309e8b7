"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled good and bad text. A text is
cut into blocks of 2 KB and every block is compressed with each of them. The
difference of the compressed sizes, over the larger one, says which class the
text resembles; the whole text's size compressed without a dictionary, over its
plain size, says how redundant it is. A logistic curve fitted on labelled documents that were not
used for the dictionaries turns these normalised differences into a probability.

Fitted on a bounded sample (SAMPLE documents a class) of labelled rows outside
the held-out quarter; applied to every whole text, without a shuffle.

Defined results: null and empty texts score 0; repeated rows get equal scores;
an empty table gives an empty table. From one labelled text of each class on, texts are told apart; the
only text of a class then serves dictionary and calibration alike. Without any labelled text of
one of the classes nothing can be told apart, and every non-empty text gets the score of the other
class (1 if there are no labels at all).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polysema.llm.memory import begins
from polysema.llm.sampling import held_out, labelled_texts

#: Labelled documents a class at most that are used to fit, half for the
#: dictionaries and half for the calibration; bytes of a block and of a dictionary.
SAMPLE, BLOCK, DICTIONARY, LEVEL = 1500, 2048, 65536, 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the features, the constant last; for one class only the constant


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of too few samples for training, their own bytes."""
    parts = [b for t in texts for b in blocks(t.encode("utf-8"))]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


@functools.lru_cache(maxsize=4)
def compressors(good: bytes, bad: bytes) -> tuple:
    out = []
    for content in (good, bad):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
    return *out, zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress


def features(text: bytes, model: Model) -> tuple[float, ...]:
    by_good, by_bad, plain = compressors(model.good, model.bad)
    cut = blocks(text)
    good, bad = sum(len(by_good(b)) for b in cut), sum(len(by_bad(b)) for b in cut)
    like_good = (bad - good) / max(bad, good)
    dense = min(len(plain(text)) / len(text), 1.5)
    size = np.log1p(len(text)) / 10
    return like_good, like_good * size, dense, dense * dense, size, 1.0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id and a 0/1 column. Reads at most sample texts a class to the driver."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    rows = [(y, t) for _, y, t in labelled_texts(docs, marked, sample) if t]
    by_class = {c: [t for y, t in rows if y == c] for c in (0, 1)}
    if not all(by_class.values()):
        return Model(b"", b"", (0.0 if by_class[0] else 1.0,))
    second = {c: by_class[c][1::2] or by_class[c] for c in (0, 1)}
    model = Model(*(dictionary(by_class[c][::2]) for c in (1, 0)), weights=())
    n = {r["label"]: r["n"] for r in marked.where(~held_out(F.col("doc_id"))).groupBy("label").agg(F.count("*").alias("n")).collect()}
    rest = [(c, t) for c in (0, 1) for t in second[c]]
    x = np.array([features(t.encode("utf-8"), model) for _, t in rest])
    y = np.array([c for c, _ in rest], float)
    each = {c: n[c] / sum(n.values()) / len(second[c]) * len(rest) for c in (0, 1)}  # classes count as in all labels
    w = logistic(x, y, np.array([each[c] for c, _ in rest]))
    return Model(model.good, model.bad, tuple(map(float, w)))


def score(text: str | None, model: Model) -> float:
    if not text:
        return 0.0
    if len(model.weights) == 1:
        return model.weights[0]
    z = float(np.dot(features(text.encode("utf-8"), model), model.weights))
    return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def add_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The input with its score as a further column: a map without a shuffle.

    If the input has a column of that name (in any case), the score replaces it."""
    kept = [c for c in docs.columns if c.lower() != name.lower() or c == text]
    if any(c.lower() == name.lower() for c in kept):
        raise ValueError(f"{name} is the text column")
    df = docs.select(*(f"`{c}`" for c in kept))
    at = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 64 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("quality")
        m = shared.value
        for batch in batches:
            scores = pa.array([score(t.as_py(), m) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows that score at least ``least``, with all columns as they are, whatever their names."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 64 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("quality")
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py(), m) >= least for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
