"""Approximate nearest neighbours by score-aware quantisation and four-bit table scans.

Smallest Euclidean distance is largest q.x - |x|^2 / 2, a maximum inner product
with a term of x alone, which is stored as it is. Vectors are coded by product
quantisation with 16 centroids for every WIDTH dimensions. Codebooks and codes
minimise an anisotropic loss: the residual's part parallel to the vector, which
moves high inner products most, counts ETA times the orthogonal part. Two
four-bit codes share a byte; a query's table has the sums for all 256 values of
each byte, and a scan adds one entry a byte for every row. Of each block of BLOCK
rows the best SHORTLIST by the tables are measured exactly on the original vectors,
which lie beside the codes, in double precision; then every further row whose table
score is within MARGIN standard errors of the query's k-th nearest so far. So recall
neither falls as a table grows nor in a dense group whose rows have nearly the same
codes: such a group is measured whole, a block at a time. A task keeps each query's
nearest over all its blocks, so what it emits doesn't grow with its rows; the tasks'
lists are merged.

Codebooks are fitted on a bounded sample (SAMPLE vectors in hash order); every
vector is coded and scanned for every query. Equal vectors are one class that is
scanned once and stands for its smallest ids, as many as any answer can use, so
copies neither crowd a shortlist nor a task. Queries go out in blocks of
QUERIES vectors; every block is one pass over the codes.

Defined results: vectors that are null, zero, of another length than most, or
with null or non-finite components take no part; ties go to the smaller id;
repeated rows count once; with fewer candidates all are returned; extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polysema.tables import Scratch

#: Dimensions of a subspace, weight threshold of the anisotropic loss, vectors of
#: the fit, its rounds and the sweeps of a coding.
WIDTH, THRESHOLD, SAMPLE, ROUNDS, SWEEPS = 2, 0.2, 8192, 8, 3
SHORTLIST, BLOCK, QUERIES = 200, 16384, 2048
#: Standard errors of a table score within which rows are measured beyond the shortlist.
MARGIN = 2.0
#: Rows of a file of codes and vectors, once there are enough rows for all cores.
FILE = 1 << 18


@dataclass(frozen=True, eq=False)
class Codebooks:
    centroids: np.ndarray  # subspace x 16 x WIDTH
    eta: float
    spread: np.ndarray | None = None  # mean outer product of the residuals, dimension x dimension

    def error(self, queries: np.ndarray) -> np.ndarray:
        """The standard error of each query's table scores."""
        q = padded(queries)
        return np.sqrt(np.einsum("qd,de,qe->q", q, self.spread, q).clip(0))


def padded(x: np.ndarray) -> np.ndarray:
    """Zeros added so that the dimensions fill pairs of subspaces."""
    extra = -x.shape[1] % (2 * WIDTH)
    return np.hstack([x, np.zeros((len(x), extra))]) if extra else x


def encode(x: np.ndarray, books: Codebooks, codes: np.ndarray | None = None) -> np.ndarray:
    """Codes (row x subspace) that minimise the anisotropic loss by coordinate descent."""
    s = books.centroids.shape[0]
    parts = x.reshape(len(x), s, WIDTH)
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    away = ((parts[:, :, None, :] - books.centroids[None]) ** 2).sum(-1)  # row x subspace x 16
    along = np.einsum("nsw,nskw->nsk", unit, parts[:, :, None, :] - books.centroids[None])
    codes = away.argmin(2) if codes is None else codes
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(SWEEPS):
        for j in range(s):
            others = total - along[rows, j, codes[:, j]]
            codes[:, j] = (away[:, j] + (books.eta - 1) * (others[:, None] + along[:, j]) ** 2).argmin(1)
            total = others + along[rows, j, codes[:, j]]
    return codes


def fit(sample: np.ndarray) -> Codebooks:
    """Codebooks of a sample (row x dimension): rounds of coding and of solving each centroid's normal equations."""
    x = padded(sample)
    s = x.shape[1] // WIDTH
    d = max(2, sample.shape[1])
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    parts = x.reshape(len(x), s, WIDTH)
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    draw = np.random.default_rng(11).permutation(len(x))
    start = parts[draw[np.arange(16) % len(x)]].transpose(1, 0, 2).copy()
    books = Codebooks(start + 1e-6 * np.random.default_rng(12).standard_normal(start.shape), eta)
    for r in range(ROUNDS):
        codes = encode(x, Codebooks(books.centroids, 1.0 if r < ROUNDS // 2 else eta))
        weight = 0.0 if r < ROUNDS // 2 else eta - 1
        new = books.centroids.copy()
        coded = new[np.arange(s)[None], codes]
        along = (unit * (parts - coded)).sum(2)
        for j in range(s):
            u, others = unit[:, j], along.sum(1) - along[:, j]
            for k in range(16):
                m = codes[:, j] == k
                if m.any():
                    um, xm = u[m], parts[m, j]
                    a = m.sum() * np.eye(WIDTH) + weight * um.T @ um
                    b = xm.sum(0) + weight * (um * (others[m] + (um * xm).sum(1))[:, None]).sum(0)
                    new[j, k] = np.linalg.solve(a, b)
        books = Codebooks(new, eta)
    left = x - books.centroids[np.arange(s)[None], encode(x, books)].reshape(x.shape)
    return Codebooks(books.centroids, eta, left.T @ left / len(x))


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def tables(queries: np.ndarray, books: Codebooks) -> np.ndarray:
    """query x byte x 256: the inner products of both codes of a byte, summed."""
    q = padded(queries).reshape(len(queries), -1, WIDTH)
    one = np.einsum("qsw,skw->qsk", q, books.centroids)
    return (one[:, ::2, None, :] + one[:, 1::2, :, None]).reshape(len(q), -1, 256).astype(np.float32)


def scan(codes: np.ndarray, half: np.ndarray, table: np.ndarray) -> np.ndarray:
    """q.x - |x|^2 / 2 of every row (byte-wise codes, column by column) for one query's table."""
    score = table[0][codes[0]]
    for t, c in zip(table[1:], codes[1:]):
        score += t[c]
    return score - half


def shortlist(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores of a block, and of all that tie with the last of them."""
    if len(score) <= n:
        return np.arange(len(score))
    return np.flatnonzero(score >= np.partition(score, -n)[-n])


def distances(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x, squares added in the order of the dimensions."""
    return np.sqrt(np.cumsum((x - query) ** 2, axis=1)[:, -1])


def nearer(held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, distance: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest of a list and further rows, nearest first, ties to the smaller id."""
    ids, distance = np.concatenate([held[0], ids]), np.concatenate([held[1], distance])
    order = np.lexsort((ids, distance))[:n]
    return ids[order], distance[order]


def measured(held: tuple[np.ndarray, np.ndarray], query: np.ndarray, error: float, score: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A query's n nearest so far and those of a block with these table scores."""
    some = shortlist(score, max(SHORTLIST, n))
    held = nearer(held, ids[some], distances(query, x[some]), n)
    if len(some) < len(score):
        floor = (query @ query - held[1][-1] ** 2) / 2 - MARGIN * error
        more = np.flatnonzero((score >= floor) & (score < score[some].min()))
        if len(more):
            held = nearer(held, ids[more], distances(query, x[more]), n)
    return held


def runs(batches: Iterator[pa.RecordBatch], kind: type = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, codes (byte by byte), halves and vectors (of numbers of a kind) of BLOCK rows or somewhat more at a time."""
    own, n = [], 0

    def matrix(column: pa.ChunkedArray, of: type) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), of).reshape(n, -1)

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(own)
        return t.column(0).to_numpy(), np.ascontiguousarray(matrix(t.column(1), np.uint8).T), t.column(2).to_numpy().astype(np.float32), matrix(t.column(3), kind)

    for batch in batches:
        if batch.num_rows:
            own.append(batch)
            n += batch.num_rows
        if n >= BLOCK:
            yield joined()
            own, n = [], 0
    if n:
        yield joined()


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part, each once."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0)).distinct()


def nearest(vectors: DataFrame, k: int, is_query, id_col: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of each query's k nearest other rows.

    is_query: Column -> Column, says of an id whether it is a query."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    rows = scratch.keep(usable(vectors, id_col, vector), "rows")
    copies = rows.withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    classes = scratch.keep(copies.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids"), "classes")
    asked = scratch.keep(rows.where(is_query(F.col("vec_id"))).join(classes.select("rep", "v"), "v").select(F.col("vec_id").alias("query_id"), "rep"), "asked")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = classes.count()
    # vectors of single precision are kept in it beside the codes
    kind = np.float32 if vectors.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    sample = classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()
    if not sample:
        return empty
    shared_books = spark.sparkContext.broadcast(books := fit(np.array([r["v"] for r in sample])))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), float)
                c = packed(encode(padded(x), shared_books.value))
                packs = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (c, x.astype(kind))]
                yield pa.RecordBatch.from_arrays([batch.column(0), packs[0], pa.array((x * x).sum(1) / 2), packs[1]], ["rep", "code", "half", "own"])

    # as many files as there are cores or blocks, and more only when files would pass FILE rows
    files = max(1, -(-n // FILE), min(-(-n // BLOCK), spark.sparkContext.defaultParallelism))
    coded = classes.select("rep", "v").mapInArrow(code, "rep bigint, code binary, half double, own binary")
    coded = scratch.keep(coded.repartition(files, "rep").sortWithinPartitions("rep"), "codes")  # blocks don't depend on the order of arrival

    wanted = asked.select("rep").distinct().join(classes.select("rep", "v"), "rep")
    parts = max(1, -(-wanted.count() // QUERIES))
    wanted = scratch.keep(wanted.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int")), "queries")
    lists = []
    for p in range(parts):
        block = wanted.where(F.col("part") == p).select("rep", "v").collect()  # near QUERIES vectors
        if not block:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["rep"] for r in block], np.int64), np.array([r["v"] for r in block], float)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            reps, q = shared.value
            held, errors = [(np.empty(0, np.int64), np.empty(0))] * len(q), shared_books.value.error(q)
            for ids, codes, half, x in runs(batches, kind):
                for at in range(0, len(q), 64):
                    for i, t in enumerate(tables(q[at : at + 64], shared_books.value), at):
                        held[i] = measured(held[i], q[i], errors[i], scan(codes, half, t), ids, x, k + 1)
            for at in range(0, len(q), 64):
                some = held[at : at + 64]
                who = np.repeat(reps[at : at + 64], [len(x) for x, _ in some])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([x for x, _ in some])), pa.array(np.concatenate([y for _, y in some]))], ["q", "c", "score"])

        # a class stands for an id at least, and a query only leaves itself out: k + 1 classes are enough, and k + 1 ids
        found = coded.mapInArrow(search, "q bigint, c bigint, score double")
        lists.append(scratch.keep(found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "c"))).where(F.col("r") <= k + 1).drop("r"), "near"))
    if not lists:
        return empty
    near = reduce(DataFrame.unionAll, lists)
    each = near.join(classes.select(F.col("rep").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    folded = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    own = asked.join(folded, asked["rep"] == folded["q"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
