"""Similarity graphs and ego networks.

``inner_products`` is the exact search. Vectors are dealt into cells around centroids;
a query meets its own cell first, which gives a score that its k-th best must reach. A
cell goes on only if an upper bound of its scores, from the angles between query,
centroid and the cell's farthest member, reaches that score; what can't is never shipped.
Queries then are dealt into few large parts, and the vectors that a part needs pass by it
in the order of their words, so what is shuffled is a copy of the vectors a part, whatever k is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polysema.functions import text as X
from polysema.functions import vectors as V
from polysema.operators.streams import Best, by_part, stream
from polysema.tables import Scratch

#: Vectors of a unit; a product of two units takes 8 * BLOCK**2 bytes, in strips.
BLOCK, STRIP = 8192, 512
#: Vectors from which there is more than one cell, vectors of a cell, cells at most, sampled vectors a cell, rounds of their means.
FEW, CELL, CELLS, SAMPLED, ROUNDS = 8192, 2048, 1024, 16, 5
#: Queries of a part at most, parts that there are for parallel work if each has FEWEST queries.
PART, PARTS, FEWEST = 32768, 16, 1024
#: By how much a bound may be missed: scores are rounded, and sums of products have errors of their own.
SLACK = 1e-5


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _best(q: np.ndarray, words: pa.Array, m: np.ndarray, k: int, digits: int, least: np.ndarray | None = None, own: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, place in the words and score of the k best of each query (of those that reach ``least``, without the word ``own``), best first. words are sorted."""
    place = None if own is None else np.asarray(pa.compute.fill_null(pa.compute.index_in(own, words), -1))
    rows, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for at in range(0, len(q) if len(m) else 0, STRIP):
        score = np.round(q[at : at + STRIP] @ m.T, digits) + 0.0
        if place is not None:
            mine = np.flatnonzero(place[at : at + STRIP] >= 0)
            score[mine, place[at : at + STRIP][mine]] = -np.inf
        floor = np.partition(score, -min(k, score.shape[1]), axis=1)[:, -min(k, score.shape[1])]
        if least is not None:
            floor = np.maximum(floor, least[at : at + STRIP])
        r, c = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        s = score[r, c]
        order = np.lexsort((c, -s, r))  # words rise with c
        r, c, s = r[order], c[order], s[order]
        first = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1)) if len(r) else np.zeros(0, int)
        kept = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r)))) < k
        rows.append(r[kept] + at)
        places.append(c[kept])
        scores.append(s[kept])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(scores)


def centroids(vectors: DataFrame, n: int) -> np.ndarray:
    """One centre a CELL vectors, CELLS at most: means of a sample of SAMPLED vectors a centre, the same however the table is partitioned."""
    c = max(1, min(CELLS, -(-n // CELL)))
    rows = vectors.select(F.xxhash64("word").alias("h"), "word", "v").orderBy("h", "word").limit(SAMPLED * c).toArrow()  # SAMPLED * CELLS rows at most
    x = _matrix(rows.column("v"))
    centre = x[:c].copy()
    for _ in range(ROUNDS if len(x) else 0):
        own = (x @ centre.T - (centre**2).sum(1) / 2).argmax(1)
        for i in range(len(centre)):
            if (own == i).any():
                centre[i] = x[own == i].mean(0)
    return centre


class Cells:
    """Centres with what bounds the scores of their members: number of units, largest angle, norms."""

    def __init__(self, centre: np.ndarray):
        self.centre = centre
        self.norm = np.sqrt((centre**2).sum(1))
        n = len(centre)
        self.units, self.angle, self.most, self.least = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)

    def cosines(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        length = norm[:, None] * self.norm
        return np.divide(x @ self.centre.T, length, out=np.zeros(length.shape), where=length > 0).clip(-1, 1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centre.T - self.norm**2 / 2).argmax(1)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The most that a member of each cell can score with each row. A centre or vector of length 0 has no angle, so nothing is left out there."""
        norm = np.sqrt((x**2).sum(1))
        apart = np.arccos(self.cosines(x, norm)) - self.angle
        c = np.where(self.norm > 0, np.cos(np.maximum(apart, 0)), 1.0)
        return norm[:, None] * np.where(c > 0, c * self.most, c * self.least)


def _placed(df: DataFrame, key: str, v: str, cells: Cells) -> DataFrame:
    """The table with its cell, the angle to the centre, and the norm."""
    shared = df.sparkSession.sparkContext.broadcast(cells)  # CELLS vectors
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, c.centre.shape[1]))
            norm = np.sqrt((x**2).sum(1))
            cell = c.nearest(x)
            angle = np.where(norm > 0, np.arccos(c.cosines(x, norm)[np.arange(len(x)), cell]), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle), pa.array(norm)], [key, v, "cell", "angle", "norm"])

    return df.select(key, v).mapInArrow(run, f"{key} {kind}, {v} array<double>, cell int, angle double, norm double")


def _with_unit(df: DataFrame, key: str, cells: Cells) -> DataFrame:
    units = F.array(*(F.lit(int(max(1, n))) for n in cells.units))
    return df.withColumn("unit", F.pmod(F.xxhash64(key), F.element_at(units, F.col("cell") + 1)).cast("int"))


def inner_products(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, others: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """query, word, score: the k largest inner products of each query, rounded, ties to the smaller word. Exact.
    others: without the word that equals the query.

    queries: query, qv. vectors: word, v."""
    scratch = scratch or Scratch(queries.sparkSession, "nearest")
    queries, vectors = queries.select("query", V.doubles(F.col("qv")).alias("qv")), vectors.select("word", V.doubles(F.col("v")).alias("v"))
    kinds = {"query": queries.schema["query"].dataType.simpleString(), "word": vectors.schema["word"].dataType.simpleString()}
    n, nq = vectors.count(), queries.count()
    if n <= FEW:
        return _few(queries, vectors, kinds, nq, k, digits, others)
    rows, first, cells = _first_pass(queries, vectors, kinds, n, k, digits, others, scratch)
    return _second_pass(first, rows, cells, kinds, nq, k, digits, others, scratch)


def _few(queries: DataFrame, vectors: DataFrame, kinds: dict[str, str], nq: int, k: int, digits: int, others: bool) -> DataFrame:
    """FEW vectors at most: they are copied to every BLOCK of queries, each of which is done then."""
    parts = max(1, -(-nq // BLOCK))
    q = queries.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
    v = vectors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pa.compute.sort_indices(right.column("word")))
        r, c, s = _best(_matrix(left.column("qv")), right.column("word"), _matrix(right.column("v")), k, digits, own=left.column("query") if others else None)
        return pa.table({"query": left.column("query").take(pa.array(r)), "word": right.column("word").take(pa.array(c)), "score": s})

    return q.groupBy("part").cogroup(v.groupBy("part")).applyInArrow(best, f"query {kinds['query']}, word {kinds['word']}, score double")


def _first_pass(queries: DataFrame, vectors: DataFrame, kinds: dict[str, str], n: int, k: int, digits: int, others: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame, Cells]:
    """Vectors with their units; queries with their unit and the score to reach, the k-th best of the unit; the cells."""
    cells = Cells(centroids(vectors, n))
    rows = scratch.keep(_placed(vectors, "word", "v", cells), "vectors")
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a"), F.max("norm").alias("m"), F.min("norm").alias("l")).collect():  # CELLS rows at most
        cells.units[r["cell"]], cells.angle[r["cell"]], cells.most[r["cell"]], cells.least[r["cell"]] = -(-r["n"] // BLOCK), r["a"], r["m"], r["l"]
    rows = _with_unit(rows.select("word", "v", "cell"), "word", cells)
    # queries of a cell are dealt like its vectors, so a unit meets about as many of them
    asked = _with_unit(_placed(queries, "query", "qv", cells).select("query", "qv", "cell"), "query", cells)

    def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pa.compute.sort_indices(right.column("word")))
        r, c, s = _best(_matrix(left.column("qv")), right.column("word"), _matrix(right.column("v")), k, digits, own=left.column("query") if others else None)
        count = np.bincount(r, minlength=left.num_rows) if len(r) else np.zeros(left.num_rows, int)
        ends = np.concatenate(([0], np.cumsum(count)))
        least = np.full(left.num_rows, -np.inf)
        least[count == k] = s[ends[1:][count == k] - 1]
        return left.select(["query", "qv", "cell", "unit"]).append_column("least", pa.array(least))

    schema = f"query {kinds['query']}, qv array<double>, cell int, unit int, least double"
    return rows, scratch.keep(asked.groupBy("cell", "unit").cogroup(rows.groupBy("cell", "unit")).applyInArrow(best, schema), "first"), cells


def _needed(first: DataFrame, cells: Cells) -> DataFrame:
    """from_cell, from_unit, cell, unit, n: the units beside its own that may hold one of a query's best, and for how many queries of a batch."""
    shared = first.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        to_cell = np.repeat(np.arange(len(c.units)), c.units)
        to_unit = np.arange(len(to_cell)) - np.repeat(np.concatenate(([0], np.cumsum(c.units)[:-1])), c.units)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, unit, least = (batch.column(i).to_numpy() for i in (1, 2, 3))
            may = c.bounds(_matrix(batch.column(0)))[:, to_cell] + SLACK >= least[:, None]
            may &= (to_cell != cell[:, None]) | (to_unit != unit[:, None])
            for x, y in {*zip(cell.tolist(), unit.tolist())}:
                n = may[(cell == x) & (unit == y)].sum(0)
                to = np.flatnonzero(n)
                own = np.full(len(to), x, np.int32), np.full(len(to), y, np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (*own, to_cell[to].astype(np.int32), to_unit[to].astype(np.int32), n[to]))], ["from_cell", "from_unit", "cell", "unit", "n"])

    return first.select("qv", "cell", "unit", "least").mapInArrow(run, "from_cell int, from_unit int, cell int, unit int, n bigint")


def _second_pass(first: DataFrame, rows: DataFrame, cells: Cells, kinds: dict[str, str], nq: int, k: int, digits: int, others: bool, scratch: Scratch) -> DataFrame:
    """Queries of neighbouring cells make up a part, by which all vectors that one of them needs pass once."""
    parts = max(-(-nq // PART), min(PARTS, -(-nq // FEWEST)), 1)
    asked = first.groupBy("cell", "unit").agg(F.count(F.lit(1)).alias("n")).orderBy("cell", "unit").collect()  # a row a unit
    each, before, dealt = -(-nq // parts), 0, []
    for r in asked:  # a unit with more queries than a part is dealt over several
        dealt.append((r["cell"], r["unit"], before // each, max(1, -(-r["n"] // each))))
        before += r["n"]
    dealt = first.sparkSession.createDataFrame(dealt, "cell int, unit int, part int, copies int")
    left = first.join(F.broadcast(dealt), ["cell", "unit"]).select((F.col("part") + F.pmod(F.xxhash64("query"), F.col("copies"))).cast("int").alias("part"), "query", "qv", "least")
    needed = scratch.keep(_needed(first, cells), "needed")
    own = dealt.select(F.col("cell").alias("from_cell"), F.col("unit").alias("from_unit"), "cell", "unit")
    needed = needed.select("from_cell", "from_unit", "cell", "unit").distinct().unionAll(own)
    every = dealt.select(F.col("cell").alias("from_cell"), F.col("unit").alias("from_unit"), F.explode(F.sequence(F.col("part"), F.col("part") + F.col("copies") - 1)).alias("part"))
    wanted = needed.join(F.broadcast(every), ["from_cell", "from_unit"]).select("part", "cell", "unit").distinct()
    right = rows.join(F.broadcast(wanted), ["cell", "unit"]).select("part", "word", "v")  # a row a pair of part and unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, mine, passing in by_part(batches):
            queries = pa.Table.from_batches(list(mine))
            if not queries.num_rows:
                continue
            best = Best(_matrix(queries.column("qv")), queries.column("least").to_numpy(), k, digits)
            names: list[pa.Array] = []
            own = queries.column("query") if others else None
            for block in passing:
                words = block.column("word")
                names.extend(words.chunks)
                best.add(_matrix(block.column("v")), None if own is None else np.asarray(pa.compute.fill_null(pa.compute.index_in(own, words), -1)))
            for r, number, score in best.rows() if names else ():
                yield pa.RecordBatch.from_arrays([queries.column("query").take(pa.array(r)).combine_chunks(), pa.chunked_array(names).take(pa.array(number)).combine_chunks(), pa.array(score)], ["query", "word", "score"])

    return stream(left, right, ["word"]).mapInArrow(run, f"query {kinds['query']}, word {kinds['word']}, score double")


def skipped(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, others: bool = False) -> dict[str, float]:
    """How much of the search the bounds leave out: share of pairs of units and of pairs of query and unit that are never shipped."""
    scratch = Scratch(queries.sparkSession, "skipped")
    queries, vectors = queries.select("query", V.doubles(F.col("qv")).alias("qv")), vectors.select("word", V.doubles(F.col("v")).alias("v"))
    kinds = {"query": queries.schema["query"].dataType.simpleString(), "word": vectors.schema["word"].dataType.simpleString()}
    _, first, cells = _first_pass(queries, vectors, kinds, vectors.count(), k, digits, others, scratch)
    units = int(cells.units.sum())
    pairs = scratch.keep(_needed(first, cells), "pairs")
    asked = pairs.select(F.sum("n")).first()[0] or 0
    return {"units": units, "unit_pairs": 1 - pairs.drop("n").distinct().count() / max(1, units * (units - 1)), "query_units": 1 - asked / max(1, first.count() * (units - 1))}


def nearest_words(vectors: DataFrame, n: int) -> DataFrame:
    """vectors: word, v. src, dst, weight: the n most similar other words by cosine (6 decimals).

    The word itself is left out by its key, so copies of a vector are proper neighbours."""
    unit = vectors.select("word", V.normalise(V.doubles(F.col("v"))).alias("v"))
    found = inner_products(unit.select(F.col("word").alias("query"), F.col("v").alias("qv")), unit, n, others=True)
    return found.select(F.col("query").alias("src"), F.col("word").alias("dst"), F.col("score").alias("weight"))


def quantised(edges: DataFrame) -> DataFrame:
    """src, dst, wq: integer weights from the weights rounded to 6 decimals; duplicate edges are summed."""
    q = edges.select("src", "dst", V.quantise(F.round("weight", 6)).alias("wq")).where("wq is not null")
    return q.groupBy("src", "dst").agg(F.sum("wq").cast("int").alias("wq"))


def neighbours(graph: DataFrame, word: str) -> DataFrame:
    return graph.where(F.col("src") == F.lit(word))


def edge_weight(pairs: DataFrame, graph: DataFrame) -> DataFrame:
    """pairs: src, dst. Their weight, 0 if there is no such edge."""
    return pairs.join(graph, ["src", "dst"], "left").withColumn("wq", F.coalesce("wq", F.lit(0)))


def substring_nodes(egos: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """egos, vocabulary: word. ego, node of the multiword nodes that begin with ``ego_`` or end with ``_ego``.

    Each node's prefixes and suffixes are exploded and joined by equality, instead of a scan for each ego."""
    parts = F.split("node", "_")
    n = F.size(parts)
    cuts = F.sequence(F.lit(1), n - 1)
    heads = F.transform(cuts, lambda k: F.array_join(F.slice(parts, 1, k), "_"))
    tails = F.transform(cuts, lambda k: F.array_join(F.slice(parts, k + 1, n - k), "_"))
    nodes = vocabulary.select(F.col("word").alias("node")).where(F.col("node").contains("_"))
    pieces = nodes.select("node", F.explode(F.array_distinct(F.concat(heads, tails))).alias("ego")).where("ego <> ''")
    return pieces.join(egos.select(F.col("word").alias("ego")).distinct(), "ego").select("ego", "node").distinct()


def ego_nodes(graph: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """ego, node, wq: neighbours of another form than the ego (positive weights), and extra nodes (ego, node) of weight 1."""
    nodes = graph.where(X.minimize(F.col("dst")) != X.minimize(F.col("src"))).where("wq > 0").select(F.col("src").alias("ego"), F.col("dst").alias("node"), "wq")
    if extra is not None:
        nodes = nodes.unionByName(extra.select("ego", "node", F.lit(10000).alias("wq"))).groupBy("ego", "node").agg(F.max("wq").alias("wq"))
    return nodes


def ego_edges(nodes: DataFrame, graph: DataFrame, n: int) -> DataFrame:
    """ego, a, b, wq (a < b): of every node its n strongest edges into the ego network, made undirected.

    The rank is taken after the restriction to the network; with n at least the graph's
    neighbours a node the restriction alone decides, and Spark prunes the window early."""
    from_node = nodes.select("ego", F.col("node").alias("src")).join(graph.where("wq > 0"), "src")
    inside = from_node.join(nodes.select("ego", F.col("node").alias("dst")), ["ego", "dst"])
    w = Window.partitionBy("ego", "src").orderBy(F.desc("wq"), F.desc("dst"))
    kept = inside.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return kept.groupBy("ego", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("wq").alias("wq"))
