"""Parts of one table, by each of which rows of another pass in order: what a task holds is its own part and a block of the other table.

A cogroup holds both sides of a group in memory; here the side that passes may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of what passes by, queries of a product, candidates measured at once.
BLOCK, STRIP, AT_ONCE = 4096, 512, 65536


def stream(left: DataFrame, right: DataFrame, order: list[str]) -> DataFrame:
    """part, side, l, r: of each part the rows of left (side 0), then those of right (side 1) in their order."""
    own, other = (F.struct(*(c for c in df.columns if c != "part")) for df in (left, right))
    kinds = [df.select(x.alias("x")).schema["x"].dataType for df, x in ((left, own), (right, other))]
    none = [F.lit(None).cast(k) for k in kinds]
    rows = left.select("part", F.lit(0).alias("side"), own.alias("l"), none[1].alias("r")).unionAll(right.select("part", F.lit(1).alias("side"), none[0].alias("l"), other.alias("r")))
    return rows.repartition("part").sortWithinPartitions("part", "side", *(f"r.{c}" for c in order))


def by_part(batches: Iterator[pa.RecordBatch], block: int | None = None) -> Iterator[tuple[int, Iterator[pa.RecordBatch], Iterator[pa.Table]]]:
    """For each part its number, the rows of left, and those of right in blocks; both are to be read in this order."""
    rest: list[pa.RecordBatch] = []  # a batch that begins with the next part or side
    source = (b for b in batches if b.num_rows)

    def pull() -> pa.RecordBatch | None:
        return rest.pop() if rest else next(source, None)

    def side_of(part: int, side: int) -> Iterator[pa.RecordBatch]:
        while (b := pull()) is not None:
            same = (b.column(0).to_numpy() == part) & (b.column(1).to_numpy() == side)
            n = len(same) if same.all() else int(np.argmin(same))  # rows are sorted
            if n < len(same):
                rest.append(b.slice(n))
            if n:
                yield pa.RecordBatch.from_struct_array(b.column(2 + side).slice(0, n))
            if n < len(same):
                return

    def blocks(part: int) -> Iterator[pa.Table]:
        held, n = [], 0
        for b in side_of(part, 1):
            held.append(b)
            n += len(b)
            if n >= (block or BLOCK):
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    while (b := pull()) is not None:
        rest.append(b)
        part = b.column(0)[0].as_py()
        passing = blocks(part)
        yield part, _some(side_of(part, 0), b.schema.field(2).type), passing
        for _ in passing:  # what was not read
            pass


def _some(found: Iterator[pa.RecordBatch], kind: pa.StructType) -> Iterator[pa.RecordBatch]:
    """The batches, an empty one if there are none."""
    first = next(found, None)
    yield pa.RecordBatch.from_pylist([], pa.schema(list(kind))) if first is None else first
    yield from found


class Best:
    """The k largest products of each query with the vectors that pass by: rounded, of equal ones the earlier.

    Products in single precision, with a margin for their error, say which are measured in double precision."""

    def __init__(self, q: np.ndarray, least: np.ndarray, k: int, digits: int):
        self.q, self.least, self.k, self.digits, self.seen = q, least, k, digits, 0
        self.norm = np.sqrt((q**2).sum(1))
        self.score, self.number = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        self.single = np.float32 if _moderate(q) else np.float64
        self.narrow = q.astype(self.single)

    def add(self, m: np.ndarray, own: np.ndarray | None = None) -> None:
        """own: for each query the row that is left out, -1 for none."""
        if not len(m):
            return
        kind = self.single if _moderate(m) else np.float64
        narrow, longest = m.astype(kind), float(np.sqrt((m**2).sum(1)).max())
        unit = 4 * (m.shape[1] + 8) * float(np.finfo(kind).eps)
        for at in range(0, len(self.q), STRIP):
            to = min(at + STRIP, len(self.q))
            product = (self.narrow[at:to] if kind is self.single else self.q[at:to]) @ narrow.T
            if own is not None:
                mine = np.flatnonzero(own[at:to] >= 0)
                product[mine, own[at:to][mine]] = -np.inf
            margin = unit * self.norm[at:to] * longest + 0.6 * 10.0**-self.digits
            floor = np.maximum(self.score[at:to, -1], self.least[at:to])
            short = np.flatnonzero(self.score[at:to, -1] == -np.inf)
            if len(short) and product.shape[1] > self.k:  # of queries without k products only what may be among the block's k
                floor[short] = np.maximum(floor[short], np.partition(product[short], -self.k, axis=1)[:, -self.k] - margin[short])
            r, c = np.nonzero((product >= (floor - margin)[:, None].astype(kind)) & (product > -np.inf))
            for cut in range(0, len(r), AT_ONCE):
                self._merge(at + r[cut : cut + AT_ONCE], c[cut : cut + AT_ONCE], m)
        self.seen += len(m)

    def _merge(self, r: np.ndarray, c: np.ndarray, m: np.ndarray) -> None:
        s = np.round(np.einsum("ij,ij->i", self.q[r], m[c]), self.digits) + 0.0
        good = (s >= self.least[r]) & (s > self.score[r, -1])  # a later one of the same score is not among the best
        r, c, s = r[good], c[good], s[good]
        if not len(r):
            return
        rows = np.flatnonzero(np.bincount(r, minlength=len(self.q)))
        place = np.zeros(len(self.q), np.int64)
        place[rows] = np.arange(len(rows))
        row = np.concatenate((np.repeat(np.arange(len(rows)), self.k), place[r]))
        score, number = np.concatenate((self.score[rows].ravel(), s)), np.concatenate((self.number[rows].ravel(), self.seen + c))
        order = np.lexsort((number, -score, row))
        row = row[order]
        first = np.searchsorted(row, np.arange(len(rows)))
        kept = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[rows], self.number[rows] = score[kept].reshape(-1, self.k), number[kept].reshape(-1, self.k)

    def rows(self, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, number of the vector and score, best first."""
        step = max(1, at_once // self.k)
        for at in range(0, len(self.q), step):
            score, number = self.score[at : at + step], self.number[at : at + step]
            r, c = np.nonzero(number >= 0)
            yield r + at, number[r, c], score[r, c]


def _moderate(x: np.ndarray) -> bool:
    """Whether single precision can hold products of such numbers."""
    most = np.abs(x).max(initial=0.0)
    return bool(np.isfinite(most) and most < 1e15)
