"""Word vectors by CBOW or skip-gram with negative sampling, over a model that no task and no driver holds whole.

The model is a table (a row a word: input vector, output vector, frequency). The corpus
is dealt by a hash of its sentences into parts of about PART_TOKENS tokens, so what a part
is depends on the corpus alone, not on the number of cores. In every iteration

1. the words that a part needs, its own and those drawn as negatives, are joined with the
   model table: each part gets a model of its own words;
2. an Arrow function trains the part's sentences on it, in small batches;
3. the parts' changes are summed word by word and applied to the table as the mean over
   the parts, each weighted by how often it changed the word.

Words are known by a 64-bit hash, so texts need no join with the vocabulary: a token
whose hash brings no vector is out of it. Negatives come from a pool of POOL words drawn
from the 3/4 power of the frequencies, anew in each iteration; the pool is the only thing
that is broadcast, at 8 bytes a draw.

The update rule, the decay of the rate, the shrinking window and the thinning of frequent
words are those of the word2vec program: CBOW predicts a word from the mean of its context,
skip-gram from each context word by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.tables import Scratch

#: Tokens of a part, tokens of a sentence (longer texts are cut there), draws of negatives in the pool.
PART_TOKENS, SENTENCE, POOL = 500_000, 10_000, 1_000_000
#: Negatives an example, examples of a batch, first and last rate, frequency share from which words are thinned.
NEGATIVES, BATCH, RATE, LAST_RATE, THIN = 5, 128, 0.025, 0.0001, 1e-3


def scatter_add(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to the table's rows ``at``; repeated ones are summed."""
    if len(at):
        order = np.argsort(at, kind="stable")
        s = at[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        table[s[first]] += np.add.reduceat(rows[order], first, axis=0)


def step(inner: np.ndarray, outer: np.ndarray, context: np.ndarray, used: np.ndarray, target: np.ndarray, negatives: np.ndarray, rate: float) -> None:
    """One batch: every row predicts its target from the mean of its used context words, and not its negatives. A negative equal to the target is skipped."""
    n = used.sum(1)
    mean = (inner[context] * used[:, :, None]).sum(1) / n[:, None]
    words = np.concatenate((target[:, None], negatives), 1)
    label = np.zeros(words.shape, inner.dtype)
    label[:, 0] = 1
    u = outer[words]
    gain = (label - 1 / (1 + np.exp(-np.clip(np.einsum("md,mkd->mk", mean, u), -30, 30)))) * rate
    gain[:, 1:][negatives == target[:, None]] = 0
    gain = gain.astype(inner.dtype)
    back = np.einsum("mk,mkd->md", gain, u)
    scatter_add(outer, words.ravel(), (gain[:, :, None] * mean[:, None, :]).reshape(-1, inner.shape[1]))
    row, _ = np.nonzero(used)
    scatter_add(inner, context[used], back[row])


def examples(words: np.ndarray, sentence: np.ndarray, window: int, cbow: bool, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """target, context and used of all places of the sentences; every place has a window of its own, 1 to ``window`` wide."""
    n = len(words)
    reach = draw.integers(1, window + 1, n)
    offsets = np.array([k for k in range(-window, window + 1) if k])
    at = np.arange(n)[:, None] + offsets
    inside = (at >= 0) & (at < n) & (np.abs(offsets) <= reach[:, None])
    at = np.clip(at, 0, max(n - 1, 0))
    used = inside & (sentence[at] == sentence[:, None]) if n else inside
    if cbow:
        some = used.any(1)
        return words[some], words[at[some]], used[some]
    row, k = np.nonzero(used)
    return words[row], words[at[row, k]][:, None], np.ones((len(row), 1), bool)


def train_part(sentences: list[np.ndarray], inner: np.ndarray, outer: np.ndarray, share: np.ndarray, noise: np.ndarray, window: int, cbow: bool, rates: tuple[float, float], draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Trains the part's model in place; times that each word's vectors were changed (input, output).

    sentences: places in the model, -1 for words out of it. share: of a word in the corpus. noise: places to draw from."""
    changed_in, changed_out = np.zeros(len(inner), np.int64), np.zeros(len(inner), np.int64)
    keep = np.minimum(1, np.sqrt(THIN / np.maximum(share, 1e-300)) + THIN / np.maximum(share, 1e-300))
    total, done, at = max(1, sum(map(len, sentences))), 0, 0
    while at < len(sentences):
        some, size = [], 0
        while at < len(sentences) and size < 50_000:  # bounds the tables of windows
            some.append(sentences[at])
            size += len(sentences[at])
            at += 1
        words, sentence = np.concatenate(some), np.repeat(np.arange(len(some)), [len(s) for s in some])
        kept = words >= 0
        kept[kept] = draw.random(int(kept.sum())) < keep[words[kept]]
        target, context, used = examples(words[kept], sentence[kept], window, cbow, draw)
        negatives = noise[draw.integers(0, len(noise), (len(target), NEGATIVES))] if len(noise) else np.zeros((len(target), 0), int)
        for b in range(0, len(target), BATCH):
            s = slice(b, b + BATCH)
            progress = (done + size * b / max(1, len(target))) / total
            step(inner, outer, context[s], used[s], target[s], negatives[s], rates[0] + (rates[1] - rates[0]) * progress)
        np.add.at(changed_in, context[used], 1)
        np.add.at(changed_out, target, 1)
        np.add.at(changed_out, negatives.ravel(), 1)
        done += size
    return changed_in, changed_out


def _vectors(flat: np.ndarray, size: int) -> pa.FixedSizeListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, size, dtype=np.int32)), pa.array(flat.ravel()))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(c.flatten(), np.float32).reshape(-1, size)


def summed(changes: DataFrame, size: int) -> DataFrame:
    """id, part, di, do, ni, no. id with the sums; rows come sorted by id, so a task holds one sum at a time."""
    schema = "id bigint, di array<float>, do array<float>, ni bigint, no bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            sums = [np.add.reduceat(_matrix(batch.column(c), size).astype(np.float64), first, axis=0) for c in (1, 2)]
            sums += [np.add.reduceat(batch.column(c).to_numpy(), first)[:, None] for c in (3, 4)]
            ids = ids[first]
            if last is not None:
                if ids[0] == last:
                    for s, h in zip(sums, held):
                        s[0] += h[0]
                else:
                    ids, sums = np.concatenate(([last], ids)), [np.concatenate((h, s)) for h, s in zip(held, sums)]
            last, held = ids[-1], [s[-1:] for s in sums]
            yield _sums(ids[:-1], [s[:-1] for s in sums])
        if last is not None:
            yield _sums(np.array([last]), held)

    def _sums(ids: np.ndarray, s: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64()), *(_vectors(x.astype(np.float32), size) for x in s[:2]), *(pa.array(x[:, 0], pa.int64()) for x in s[2:])]
        return pa.RecordBatch.from_arrays(columns, ["id", "di", "do", "ni", "no"])

    return changes.select("id", "di", "do", "ni", "no", "part").repartition("id").sortWithinPartitions("id", "part").mapInArrow(run, schema)


def moved(old: Column, change: Column, n: Column) -> Column:
    """A vector with the mean of its changes."""
    return F.when(n > 0, F.zip_with(old, change, lambda a, b: (a + b / n).cast("float"))).otherwise(old)


def sentences_of(docs: DataFrame, tokens: Column) -> DataFrame:
    """place (a hash of the text, and its number among the text's cuts), words (hashes). Equal texts are equal rows."""
    t = docs.select(F.transform(tokens, lambda w: F.xxhash64(w)).alias("t")).where(F.size("t") > 0)
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / SENTENCE).cast("int")), lambda k: F.struct(k.alias("k"), F.slice("t", k * SENTENCE + 1, SENTENCE).alias("words")))
    return t.select(F.xxhash64("t").alias("text"), F.explode(cuts).alias("x")).select("text", F.col("x.k").alias("k"), "x.words")


def word_vectors(
    docs: DataFrame, size: int = 300, window: int = 5, iterations: int = 5, least: int = 10, cbow: bool = True, seed: int = 1, text: str = "text", tokens: Column | None = None, part_tokens: int = PART_TOKENS, scratch: Scratch | None = None,
) -> DataFrame:
    """word, v (array<double>) of every word that occurs ``least`` times. The same rows on any number of cores.

    tokens: the texts' tokens, by default their alphabetic ones. Null and empty texts bring none; an empty
    corpus gives an empty table."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    tokens = X.tokenize(F.col(text)) if tokens is None else tokens
    words = docs.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)
    start = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: ((F.xxhash64("word", k, F.lit(seed)).bitwiseAND(0xFFFFFF) / float(1 << 24) - 0.5) / size).cast("float"))
    model = scratch.keep(words.select(F.xxhash64("word").alias("id"), "word", "freq", start.alias("vi"), F.array_repeat(F.lit(0.0).cast("float"), size).alias("vo")), "model")
    total, mass = model.agg(F.coalesce(F.sum("freq"), F.lit(0)), F.sum(F.pow("freq", F.lit(0.75)))).first()  # one row
    parts = max(1, -(-total // part_tokens))
    dealt = sentences_of(docs, tokens).withColumn("part", F.pmod(F.xxhash64("text", "k"), F.lit(parts)).cast("int"))
    corpus = scratch.keep(dealt, "corpus")
    own = scratch.keep(corpus.select("part", F.explode("words").alias("id")).distinct(), "own")
    ids = {"part": "int", "id": "bigint"}

    def noise(parts_batches: Iterator[pa.RecordBatch], pool: np.ndarray, iteration: int) -> Iterator[pa.RecordBatch]:
        for batch in parts_batches:
            for part in batch.column(0).to_pylist():
                got = drawn(pool, iteration, part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), part), pa.int32()), pa.array(got)], list(ids))

    def drawn(pool: np.ndarray, iteration: int, part: int) -> np.ndarray:
        """A part's negatives: a twentieth of its tokens, at most a fifth of the pool."""
        n = max(1000, min(part_tokens, total) // 20)
        return pool[np.random.default_rng([seed, iteration, part, 7]).integers(0, len(pool), min(n, len(pool)))] if len(pool) else pool

    def trainer(shared, iteration: int, rates: tuple[float, float]):
        """The training of a part in an iteration."""

        def train(key, text_rows: pa.Table, model_rows: pa.Table) -> pa.Table:
            part = key[0].as_py()
            order = np.argsort(model_rows.column("id").to_numpy())
            model_rows = model_rows.take(pa.array(order))
            known = model_rows.column("id").to_numpy()
            inner, outer = _matrix(model_rows.column("vi"), size), _matrix(model_rows.column("vo"), size)
            before = inner.copy(), outer.copy()
            text_rows = text_rows.sort_by([("text", "ascending"), ("k", "ascending")])
            lists = text_rows.column("words").combine_chunks() if text_rows.num_rows else pa.array([], pa.list_(pa.int64()))

            def places(x: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
                return np.where(known[at] == x, at, -1) if len(known) else np.full(len(x), -1)

            flat, ends = places(np.asarray(lists.flatten())), np.cumsum([0, *(len(x) for x in lists)])
            got = places(drawn(shared.value, iteration, part))
            changed = train_part(
                [flat[s:e] for s, e in zip(ends[:-1], ends[1:])], inner, outer, model_rows.column("freq").to_numpy() / max(1, total), got[got >= 0], window, cbow, rates, np.random.default_rng([seed, iteration, part])
            )
            some = (changed[0] > 0) | (changed[1] > 0)
            # a change counts as often as it was made
            weighted = [((x - b) * n[:, None].astype(np.float32))[some] for x, b, n in zip((inner, outer), before, changed)]
            return pa.table({"id": known[some], "part": np.full(int(some.sum()), part, np.int32), "di": _vectors(weighted[0], size), "do": _vectors(weighted[1], size), "ni": changed[0][some], "no": changed[1][some]})

        return train

    for iteration in range(iterations):
        wanted = F.col("freq").cast("double") ** 0.75 * (POOL / (mass or 1.0))
        draws = F.floor(wanted + F.xxhash64("id", F.lit(iteration), F.lit(seed)).bitwiseAND(0xFFFFFF) / float(1 << 24))
        pool_rows = model.select("id", draws.cast("int").alias("n")).where("n > 0").orderBy("id").toArrow()  # POOL draws in all, so POOL rows at most
        pool = np.repeat(pool_rows.column("id").to_numpy(), pool_rows.column("n").to_numpy())
        shared = spark.sparkContext.broadcast(pool)
        rates = tuple(RATE + (LAST_RATE - RATE) * (iteration + k) / iterations for k in (0, 1))

        negative = spark.range(parts).select(F.col("id").cast("int").alias("part")).mapInArrow(lambda b, s=shared, i=iteration: noise(b, s.value, i), "part int, id bigint")
        needed = own.unionAll(negative).distinct()
        fetched = needed.join(model.select("id", "freq", "vi", "vo"), "id").select("part", "id", "freq", "vi", "vo")

        changes = corpus.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(trainer(shared, iteration, rates), "id bigint, part int, di array<float>, do array<float>, ni bigint, no bigint")
        sums = scratch.keep(summed(changes, size), "sums")
        after = model.join(sums, "id", "left")
        n_in, n_out = F.coalesce("ni", F.lit(0)), F.coalesce("no", F.lit(0))
        after = after.select("id", "word", "freq", moved(F.col("vi"), F.col("di"), n_in).alias("vi"), moved(F.col("vo"), F.col("do"), n_out).alias("vo"))
        done, model = model, scratch.keep(after, "model")
        scratch.drop(done)
        scratch.drop(sums)
        shared.unpersist()
    for t in (corpus, own):
        scratch.drop(t)
    return model.select("word", F.transform("vi", lambda x: x.cast("double")).alias("v"))
