"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. For each bit a binary linear
classifier over hashed character n-grams (orders 1 to 3 of lower-cased letters,
word borders included) says which half of the languages a text belongs to. The
codeword with the smallest sum of logistic losses, weighted by the bits'
training accuracy, is the answer; a small lead over the second is flagged.

Fitted on a bounded sample (EXAMPLES whole texts and excerpts) outside the
held-out quarter; applied to every whole text, without a shuffle.

Defined results: null text and text without a letter give ``und`` with score 0;
equal losses go to the smaller language name; repeated rows get equal results;
an empty table gives an empty table; with no labelled language all is ``und``.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysema.llm.sampling import labelled_texts

#: Training examples at most, hashed features, and the lead below which a
#: prediction is flagged as ambiguous.
EXAMPLES, BINS, AMBIGUOUS = 3600, 4096, 0.2
UNDETERMINED = "und"


@dataclass(frozen=True, eq=False)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # BINS + 1 x bit, the constant last
    trust: np.ndarray  # of each bit


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point of any plane is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def counts(text: str) -> np.ndarray | None:
    """Root of the relative frequency of each hashed n-gram; None without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, np.uint32(32))
    c = c[np.concatenate(([True], is_letter[1:] | is_letter[:-1]))]  # one border for a run of others
    c = np.concatenate((np.array([32], np.uint32), c, np.array([32], np.uint32)))
    a = c * np.uint32(0x9E3779B1)
    b = a[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))
    d = b[:-1] ^ (c[2:] * np.uint32(0xC2B2AE3D))
    out = np.zeros(BINS)
    for h in (a, b * np.uint32(0x27D4EB2F), d * np.uint32(0x165667B1)):
        out += np.bincount(h >> np.uint32(20), minlength=BINS)
    return np.sqrt(out / out.sum())


def codewords(n: int) -> np.ndarray:
    """n codewords: for up to 5 languages all splits in two; for more, of pseudo-random
    candidates the ones farthest from each other."""
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T.reshape(n, -1)
    bits = 15 + 4 * int(np.ceil(np.log2(n)))
    pool = np.random.default_rng(7).choice(np.array([1, -1], np.int8), (max(256, 8 * n), bits))
    chosen, nearest = [0], np.full(len(pool), bits + 1)
    while len(chosen) < n:
        nearest = np.minimum(nearest, (pool != pool[chosen[-1]]).sum(1))
        chosen.append(int(nearest.argmax()))
    return pool[chosen]


def examples(text: str, seed: int) -> list[str]:
    """The text and two excerpts of it, as short documents occur too."""
    draw = np.random.default_rng(seed)
    out = [text]
    for low, high in ((12, 60), (60, 300)):
        n = int(draw.integers(low, high))
        at = int(draw.integers(0, max(1, len(text) - n)))
        out.append(text[at : at + n])
    return out


def train(rows: list[tuple[str, str]], steps: int = 150, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """rows: language, text."""
    languages = tuple(sorted({y for y, _ in rows}))
    code = codewords(len(languages)) if len(languages) > 1 else np.ones((len(languages), 1), np.int8)
    xs, ys = [], []
    for i, (y, text) in enumerate(rows):
        for t in examples(text, i):
            if (x := counts(t)) is not None:
                xs.append(x)
                ys.append(languages.index(y))
    if len(languages) < 2 or not xs:
        return Model(languages, code, np.zeros((BINS + 1, code.shape[1])), np.ones(code.shape[1]))
    x, target = np.array(xs, np.float32), code[ys].astype(np.float32)
    each = 1 / np.bincount(ys, minlength=len(languages))[ys] / len(languages)  # languages count alike
    w, b = np.zeros((BINS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):  # Adam
        slope = -(target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))) * each[:, None].astype(np.float32)
        g = x.T @ slope + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * slope.sum(0)
    right = ((x @ w + b) * target > 0).mean(0)
    return Model(languages, code, np.vstack([w, b]).astype(np.float64), np.clip(2 * right - 1, 0.05, 1))


def fit(docs: DataFrame, most: int = EXAMPLES) -> Model:
    """docs: doc_id, text, lang. Reads a bounded number of texts of each language to the driver."""
    named = docs.select("doc_id", F.col("lang").alias("label"))
    n = max(1, named.where("label is not null").select("label").distinct().count())
    rows = labelled_texts(docs, named, max(8, most // (3 * n)))
    return train([(y, t) for _, y, t in rows])


def predict(text: str | None, model: Model) -> tuple[str, float, bool]:
    x = counts(text) if text and model.languages else None
    if x is None:
        return UNDETERMINED, 0.0, False
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    margin = x @ model.weights[:-1] + model.weights[-1]
    loss = (np.logaddexp(0, -model.code * margin) * model.trust).sum(1)
    p = np.exp(loss.min() - loss)
    p /= p.sum()
    best = int(loss.argmin())
    second = np.partition(p, -2)[-2]
    return model.languages[best], float(p[best]), bool(p[best] - second < AMBIGUOUS)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, lang_pred, score, ambiguous for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                [id_col, "lang_pred", "score", "ambiguous"],
            )

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")
