"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in more than half of the XXH64
hashes (seed 42) of a text's word shingles, repeats included. Two fingerprints at
a distance of RADIUS bits or less have a point in the middle that is within half
the radius of both, so if every fingerprint emits all variants within that half (a
ball of 2081 points for a radius of 4), the two meet at a variant.

The shuffle on variants is made compact by the variants' syndrome, the exclusive or
of the numbers of their set bits: it deals all points into 64 classes, and a
fingerprint has 33 variants in each (34 at most). So a fingerprint travels once a class,
8 bytes each, and its variants are made where they are compared. A class whose
fingerprints are too many for a task is dealt by further linear bits of the variant: first
in passes over the same rows, then, beyond PER_TASK rows, into tasks of their own.

All fingerprints that meet at a variant are within the radius of each other, since each
is within half of it, so what meets is joined by a chain of checked pairs, and a task
emits a spanning forest of its links, a row a fingerprint at most. Groups of any size
are therefore linear. Connected components of these rows give the result.

Skew: equal fingerprints are one row from the start (a minimum a task), whatever
the number of their documents.

Defined results: null texts and texts without a word have fingerprint zero and link like
any other; with fewer words than a shingle the whole sequence is the only one; rows
of equal id or text are rows of their own with equal results; a null id is the smallest of a component only if all its ids are
null; texts of any length are taken whole; other columns are ignored, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysema.llm.components import connected_components
from polysema.tables import Scratch

WIDTH, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a class that one task takes (8 bytes each), and variants that it holds at a time (16 bytes each).
PER_TASK, AT_ONCE = 8_000_000, 4_000_000
#: Shingles hashed at a time.
PIECE = 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Number of each bit for the second syndrome: a product by an odd number, spread over 32 bits.
_SPREAD = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = max(1, len(words) - WIDTH + 1) if words else 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        some = words[at : at + PIECE + WIDTH - 1]
        h = [xxhash.xxh64_intdigest(b" ".join(some[k : k + WIDTH]), SEED) for k in range(min(PIECE, n - at))]
        counts += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id and f, the fingerprint as a signed number; a row a document, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], ["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, f bigint")


def linear(f: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exclusive or of the columns at the set bits of each number."""
    out = np.zeros(len(f), np.uint64)
    for bit, c in enumerate(columns.astype(np.uint64)):
        out ^= np.where(f >> np.uint64(bit) & np.uint64(1), c, np.uint64(0))
    return out


def ball(radius: int) -> np.ndarray:
    """All masks of up to ``radius`` bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | 1 << b for m in masks for b in range(64)}
    return np.array(sorted(masks), np.uint64)


_NUMBER = np.arange(64, dtype=np.uint64)


@functools.lru_cache(maxsize=4)
def ball_of(bits: int) -> "Ball":
    return Ball(bits)


class Ball:
    """Masks within half the radius by first syndrome (6 bits) and second (``bits`` bits)."""

    def __init__(self, bits: int):
        self.bits = bits
        self.columns = _SPREAD & np.uint64((1 << bits) - 1)
        masks = ball(RADIUS // 2)
        first, second = linear(masks, _NUMBER).astype(int), linear(masks, self.columns).astype(int)
        self.masks: dict[tuple[int, int], np.ndarray] = {}
        for key in set(zip(first.tolist(), second.tolist())):
            self.masks[key] = masks[(first == key[0]) & (second == key[1])]

    def variants(self, f: np.ndarray, first: np.ndarray, second: np.ndarray, part: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """All variants with first syndrome ``part`` and second syndrome ``step``, and the index of each one's fingerprint."""
        kinds = (first.astype(np.int64) ^ part) << self.bits | second.astype(np.int64) ^ step
        order = np.argsort(kinds, kind="stable")
        found, start = np.unique(kinds[order], return_index=True)
        made, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, s, e in zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(f)]):
            masks = self.masks.get((k >> self.bits, k & (1 << self.bits) - 1))
            if masks is not None:
                at = order[s:e]
                made.append((f[at][:, None] ^ masks).ravel())
                owner.append(np.repeat(at, len(masks)))
        return np.concatenate(made), np.concatenate(owner)


def roots_of(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The forest ``parent`` (each node's root, the smallest node of its tree) with the links (a, b) added."""
    while True:
        low = np.minimum(parent[a], parent[b])
        after = parent.copy()
        np.minimum.at(after, parent[a], low)
        np.minimum.at(after, parent[b], low)
        after = after[after]
        if (after == parent).all():
            return parent
        parent = after


def class_links(f: np.ndarray, part: int, held: int = 0, of: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices a, b) of a spanning forest of the fingerprints that meet at a variant of class ``part`` and, if
    ``of`` bits of the second syndrome tell tasks apart, whose lowest bits are ``held``. f: distinct."""
    bits = of
    while len(f) * 34 >> bits - of > AT_ONCE and bits < of + 16:
        bits += 1
    with_bits = ball_of(bits)
    first, second, parent = linear(f, _NUMBER), linear(f, with_bits.columns), np.arange(len(f))
    for step in range(held, 1 << bits, 1 << of):
        made, owner = with_bits.variants(f, first, second, part, step)
        order = np.argsort(made, kind="stable")
        made, owner = made[order], owner[order]
        same = np.flatnonzero(made[1:] == made[:-1])
        a, b = owner[same], owner[same + 1]
        if len(a):
            near = np.bitwise_count(f[a] ^ f[b]) <= RADIUS
            parent = roots_of(a[near], b[near], parent)
    at = np.flatnonzero(parent != np.arange(len(f)))
    return parent[at], at


def links(distinct: DataFrame, rows: int) -> DataFrame:
    """distinct: f, without repeats, ``rows`` of them. Links (a, b) that join what is within the radius, at most one row for
    each fingerprint and task."""
    of = 0
    while rows * min(1.0, 34 / (1 << of)) > PER_TASK and of < 16:
        of += 1
    with_bits = Ball(of)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every task (class, and bits of the second syndrome) that one of the fingerprint's variants belongs to."""
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                f = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                first, second = linear(f, _NUMBER).astype(np.int64), linear(f, with_bits.columns).astype(np.int64)
                keys = np.array(list(with_bits.masks), np.int64)
                part = (first[:, None] ^ keys[:, 0]) << of | second[:, None] ^ keys[:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel().astype(np.int32)), pa.array(np.repeat(f.view(np.int64), len(keys)))], ["part", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def found() -> pa.RecordBatch:
            f = np.sort(np.concatenate(held).view(np.uint64))
            a, b = class_links(f, last >> of, last & (1 << of) - 1, of)
            f = f.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if part[s] != last and held:
                    yield found()
                    held = []
                last = int(part[s])
                held.append(f[s:e].copy())
        if held:
            yield found()

    dealt = distinct.select("f").mapInArrow(places, "part int, f bigint").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs: doc_id, text. doc_id, f (the fingerprint as a signed number) and component_id for every row."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    known = scratch.keep(fingerprints(docs), "fingerprints")
    distinct = scratch.keep(known.groupBy("f").agg(F.min("doc_id").alias("first")), "distinct")
    found = scratch.keep(links(distinct, distinct.count()), "links")
    roots = connected_components(found, scratch)
    # a component is named by its smallest id: a minimum, so a large component is a row a task
    of_root = distinct.join(roots, F.col("f") == F.col("node"), "left").select("f", "first", F.coalesce("root", "f").alias("root"))
    of_root = scratch.keep(of_root, "roots")
    smallest = scratch.keep(of_root.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = scratch.keep(of_root.select("f", "root").join(smallest, "root").select("f", "component_id"), "named")
    for t in (distinct, found, roots, of_root, smallest):
        scratch.drop(t)
    return known.join(named, "f").select("doc_id", "f", "component_id")
