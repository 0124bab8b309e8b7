"""Ego networks from packed adjacency: edges, or labels of their nodes, without a table of all edges.

A word's neighbours are one row, its sorted numbers and their weights (12 bytes each). The egos are dealt into
groups, and past each group go the rows of its nodes, each once however many egos of the group have it. An
Arrow function finds the ends that are nodes of the same ego, and clusters the networks of a group together. What is
shuffled is a row for each node of a group, and the groups of a round at a time. No word but the node's own is shipped as text.

Words are numbered by a 64-bit hash. A group's networks are held in one task: NUMBERS possible ends in all, or one ego.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysema.operators.cluster import SWEEPS
from polysema.operators.streams import by_part, stream
from polysema.tables import Scratch, fits

#: Possible ends (squares of the numbers of nodes) of a group, groups that there are for parallel work, groups of a round at least, ends that are looked up at once, egos that are clustered together.
NUMBERS, GROUPS, ROUND, LOOKED_UP, TOGETHER = 40_000_000, 16, 12, 1 << 20, 64

Network = tuple[np.ndarray, np.ndarray, np.ndarray]  # ends a < b (places in word order) and weights


def packed(graph: DataFrame) -> DataFrame:
    """word, ends array<bigint>, weights array<int>: the graph's edges (src, dst, wq) of positive weight, one row a word."""
    near = F.sort_array(F.collect_list(F.struct(F.xxhash64("dst").alias("id"), "wq")))
    rows = graph.where("wq > 0").groupBy(F.col("src").alias("word")).agg(near.alias("near"))
    return rows.select("word", F.col("near.id").alias("ends"), F.col("near.wq").alias("weights"))


class Group:
    """The networks of some egos. ids: of their nodes, each ego's in word order; sizes: nodes of each ego."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.sizes, self.ids = sizes, ids
        self.ego = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(ids)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.by_id]
        # a coarse table says which ends can't be nodes of an ego
        self.width = 1 << max(6, min(int(64 * sizes.max(initial=1)).bit_length(), int((1 << 26) // max(1, len(sizes))).bit_length() - 1))
        self.may = np.zeros(len(sizes) * self.width, bool)
        self.may[self.ego * self.width + (ids & (self.width - 1))] = True
        for odd in (-7046029254386353131, -4417276706812531889, 1609587929392839161):  # numbers of pairs of ego and node; another factor if two were equal
            self.odd = np.int64(odd)
            key = self._key(self.ego, ids)
            self.by_key = np.argsort(key)
            self.keys = key[self.by_key]
            if not (self.keys[1:] == self.keys[:-1]).any():
                break
        self.found: list[tuple[np.ndarray, ...]] = []

    def _key(self, ego: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return ids + (ego + 1) * self.odd  # wraps around

    def add(self, id_: np.ndarray, counts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> None:
        """Rows of the adjacency; counts: ends of each."""
        if not len(self.ids) or not len(id_):
            return
        low, high = (np.searchsorted(self.sorted_ids, id_, side) for side in ("left", "right"))
        start, many = np.concatenate(([0], np.cumsum(counts)[:-1])), (high - low) * counts
        cuts = np.flatnonzero(np.diff(np.concatenate(([-1], np.cumsum(many) // LOOKED_UP))))
        for s, e in zip(cuts, [*cuts[1:], len(id_)]):
            n = high[s:e] - low[s:e]
            row = np.repeat(np.arange(s, e), n)  # a row of the adjacency for each ego that has the node
            node = self.by_id[np.repeat(low[s:e] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(row))]
            deg = counts[row]
            which = np.repeat(np.arange(len(row)), deg)
            at = np.repeat(start[row] - np.concatenate(([0], np.cumsum(deg)[:-1])), deg) + np.arange(len(which)) if len(row) else which
            end, ego = ends[at], self.ego[node][which]
            some = np.flatnonzero(self.may[ego * self.width + (end & (self.width - 1))])
            end, ego = end[some], ego[some]
            hit = self.by_key[np.minimum(np.searchsorted(self.keys, self._key(ego, end)), len(self.keys) - 1)]
            true = (self.ids[hit] == end) & (self.ego[hit] == ego)
            some, hit = some[true], hit[true]
            self.found.append((ego[true].astype(np.int32), self.place[node[which[some]]].astype(np.int32), self.place[hit].astype(np.int32), weights[at[some]]))

    def edges(self, n: int | None, without: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
        """ego, low, high, weight: of every node its n strongest edges (ties: the greater word) that lead to a node, made undirected.

        without: ego, low, high of pairs that are no edges."""
        if not self.found:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        e, a, b, w = (np.concatenate(x) for x in zip(*self.found))
        self.found = []
        m = np.int64(self.sizes.max())
        source = e * m + a
        if n is not None and np.bincount(source).max() > n:
            best = np.lexsort((-b, -w.astype(np.int64), source))
            source = source[best]
            first = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1])))
            best = best[np.arange(len(source)) - np.repeat(first, np.diff(np.append(first, len(source)))) < n]
            e, a, b, w = e[best], a[best], b[best], w[best]
        key = (e * m + np.minimum(a, b)) * m + np.maximum(a, b)
        if without is not None:
            x, low, high = without
            left = ~np.isin(key, (x * m + low) * m + high)
            key, w = key[left], w[left]
        by = np.lexsort((w, key))
        key, w = key[by], w[by]
        last = np.concatenate((key[1:] != key[:-1], [True])) if len(key) else np.zeros(0, bool)
        key, w = key[last], w[last]
        return key // (m * m), key // m % m, key % m, w


def network(ids: np.ndarray, counts: np.ndarray, ends: np.ndarray, weights: np.ndarray, n: int) -> Network:
    """Edges between the nodes of one ego.

    ids: of the nodes in word order. counts: ends of each. ends, weights: of all nodes in a row."""
    group = Group(ids, np.array([len(ids)]))
    group.add(ids, counts, ends, weights)
    return group.edges(n)[1:]


def labels(sizes: np.ndarray, edges: tuple[np.ndarray, ...], sweeps: int = SWEEPS) -> np.ndarray:
    """Labels of all nodes of all egos; edges: ego (rising), ends and weights. In every sweep each node in turn takes the label of the largest
    weight among its neighbours, ties to the smallest. TOGETHER egos go through a sweep at once, as their networks don't touch."""
    out = []
    cut = np.searchsorted(edges[0], np.arange(0, len(sizes) + TOGETHER, TOGETHER))
    for k, at in enumerate(range(0, len(sizes), TOGETHER)):
        some = sizes[at : at + TOGETHER]
        e, a, b, w = (x[cut[k] : cut[k + 1]] for x in edges)
        width = int(some.max(initial=0)) + 1
        label = np.tile(np.arange(1, width + 1), (len(some), 1))
        ego, source, to, weight = np.concatenate((e, e)) - at, np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w)).astype(float)
        order = np.argsort(source * len(some) + ego, kind="stable")
        ego, source, to, weight = ego[order], source[order], to[order], weight[order]
        steps: list = []
        moving = np.ones(len(some), bool)
        for sweep in range(sweeps):
            if sweep == 0 or moving.sum() * 2 < active:  # an ego whose sweep changed nothing has its labels
                active = int(moving.sum())
                left = moving[ego]
                ego, source, to, weight = ego[left], source[left], to[left], weight[left]
                number = np.cumsum(moving) - 1
                steps = []
                ends = np.searchsorted(source, np.arange(width)).tolist()
                for i, (s, t) in enumerate(zip(ends, ends[1:])):
                    if t > s:
                        mine = np.unique(ego[s:t])
                        steps.append((i, ego[s:t] * width + to[s:t], number[ego[s:t]] * (width + 1), weight[s:t], mine, number[mine]))
            moved = np.zeros(len(some), bool)
            flat = label.ravel()
            for i, near, base, weights, mine, number_ in steps:
                sums = np.bincount(base + flat[near], weights, active * (width + 1)).reshape(active, width + 1)  # sums of integers are exact
                best = sums.argmax(1)[number_]
                changed = best != label[mine, i]
                if changed.any():
                    label[mine, i] = best
                    moved[mine[changed]] = True
            moving = moved
            if not moving.any():  # a sweep without a change repeats for ever
                break
        out.append(label[np.arange(width) < some[:, None]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def propagate(m: int, edges: Network, sweeps: int = SWEEPS) -> np.ndarray:
    """Labels 1..m of the nodes of one network."""
    return labels(np.array([m]), (np.zeros(len(edges[0]), np.int64), *edges), sweeps)


def _by_group(nodes: DataFrame, graph: DataFrame, emit: Callable[[pa.Table, Group], pa.Table], schema: str, apart: DataFrame | None = None) -> DataFrame:
    """Maps the networks of groups of egos; nodes: ego, node, wq. The table that ``emit`` gets has a row an ego: ego, nodes, wqs (in word order), ids,
    and x, y: the numbers of the words of its pairs in apart (ego, a, b)."""
    spark = nodes.sparkSession
    scratch = Scratch(spark, "networks")
    adjacency = scratch.keep(packed(graph).select(F.xxhash64("word").alias("id"), "ends", "weights"), "adjacency")
    all_ = F.sort_array(F.collect_list(F.struct("node", "wq"))).alias("all")
    egos = nodes.groupBy("ego").agg(all_).select("ego", F.col("all.node").alias("nodes"), F.col("all.wq").alias("wqs"))
    if apart is not None:
        two = F.collect_list(F.struct(F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"))).alias("two")
        egos = egos.join(apart.groupBy("ego").agg(two), "ego", "left").select("ego", "nodes", "wqs", F.col("two.x").alias("x"), F.col("two.y").alias("y"))
    egos = scratch.keep(egos.withColumn("ids", F.transform("nodes", lambda x: F.xxhash64(x))), "egos")
    n, numbers = egos.agg(F.count(F.lit(1)), F.sum(F.size("nodes").cast("double") * F.size("nodes"))).first()
    groups = max(int(-(-(numbers or 0) // NUMBERS)), min(GROUPS, -(-n // TOGETHER)), 1)
    dealt = egos.withColumn("part", F.pmod(F.xxhash64("ego"), F.lit(groups)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, mine, passing in by_part(batches):
            held = pa.Table.from_batches(list(mine)).combine_chunks()
            if not held.num_rows:
                continue
            ids = held.column("ids").combine_chunks()
            group = Group(np.asarray(ids.flatten()), np.asarray(pa.compute.list_value_length(ids)))
            for block in passing:
                ends, weights = block.column("ends").combine_chunks(), block.column("weights").combine_chunks()
                group.add(block.column("id").to_numpy(), np.asarray(pa.compute.list_value_length(ends)), np.asarray(ends.flatten()), np.asarray(weights.flatten()))
            yield from emit(held, group).to_batches(max_chunksize=1 << 16)

    def of_round(low: int, high: int) -> DataFrame:
        left = dealt.where(F.col("part").between(low, high - 1))
        wanted = left.select("part", F.explode("ids").alias("id")).groupBy("id").agg(F.collect_set("part").alias("parts"))
        wanted = scratch.keep(wanted, "wanted")
        few = F.broadcast(wanted) if fits(wanted, 8 * (high - low)) else wanted
        right = adjacency.join(few, "id").select(F.explode("parts").alias("part"), "id", "ends", "weights")
        return stream(left, right, []).mapInArrow(run, schema)

    step = max(ROUND, spark.sparkContext.defaultParallelism)
    if groups <= step:
        return of_round(0, groups)
    return reduce(DataFrame.unionAll, [scratch.keep(of_round(k, min(k + step, groups)), "round") for k in range(0, groups, step)])


def ego_edges(nodes: DataFrame, graph: DataFrame, n: int) -> DataFrame:
    """ego, a, b, wq (a < b): of every node its n strongest edges into the ego network, made undirected. The rank is taken after the restriction to the network."""
    ego, node = nodes.schema["ego"].dataType.simpleString(), nodes.schema["node"].dataType.simpleString()

    def emit(held: pa.Table, group: Group) -> pa.Table:
        e, a, b, w = group.edges(n)
        words, before = held.column("nodes").combine_chunks().flatten(), np.concatenate(([0], np.cumsum(group.sizes)[:-1]))
        return pa.table({"ego": held.column("ego").take(pa.array(e)), "a": words.take(pa.array(before[e] + a)), "b": words.take(pa.array(before[e] + b)), "wq": pa.array(w, pa.int32())})

    return _by_group(nodes, graph, emit, f"ego {ego}, a {node}, b {node}, wq int")


def label_propagation(nodes: DataFrame, graph: DataFrame, n: int | None, sweeps: int = SWEEPS, apart: DataFrame | None = None) -> DataFrame:
    """ego, node, wq, label of every node of every ego network over the graph (src, dst, wq); nodes: ego, node, wq. apart: ego, a, b (a < b) that
    are no edges of the ego's network. n: strongest edges of a node that count, all if none."""
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("ego", "node", "wq")}
    with_pairs = apart is not None

    def emit(held: pa.Table, group: Group) -> pa.Table:
        without = None
        if with_pairs:
            x, y = held.column("x").combine_chunks(), held.column("y").combine_chunks()
            own = np.repeat(np.arange(held.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(x), 0)))
            # both words of a pair are nodes of its ego
            at = [group.place[group.by_key[np.minimum(np.searchsorted(group.keys, group._key(own, np.asarray(z.flatten()))), len(group.keys) - 1)]].astype(np.int64) for z in (x, y)]
            without = own, np.minimum(*at), np.maximum(*at)
        found = labels(group.sizes, group.edges(n, without), sweeps)
        nodes_, wqs = held.column("nodes").combine_chunks().flatten(), held.column("wqs").combine_chunks().flatten()
        return pa.table({"ego": held.column("ego").take(pa.array(group.ego)), "node": nodes_, "wq": wqs, "label": pa.array(found.astype(np.int32))})

    return _by_group(nodes, graph, emit, f"ego {kinds['ego']}, node {kinds['node']}, wq {kinds['wq']}, label int", apart)
