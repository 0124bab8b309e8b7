"""Periodic runs of words: stretches that repeat a block of words again and again.

A run is a stretch of consecutive words whose smallest period q fits at least
MIN_TIMES times and that no neighbouring word extends keeping the period. All runs
of a sequence are found after Kolpakov and Kucherov, in time linear in its length:

1. LZ factorisation from the suffix automaton: each factor is the longest prefix of
   the rest that begins earlier too (the two may overlap), or a new word.
2. Main's algorithm finds the runs that touch or cross a factor's border, from the
   lengths to which words agree forwards and backwards of the border at a distance
   of q, for all q at once.
3. All other runs lie inside a factor, away from its borders, so the same run stands
   in the factor's earlier occurrence, from where it is copied.

Most words stand in no run. Every window of three words in a run occurs at least three
times in it if the run has four periods and six words, so stretches without such
windows are left out first; each other stretch is taken on its own, whole.

Defined results: null and empty texts have no words and no runs; repeated rows give
repeated results; a null id is an id like others; texts of any length are taken whole, a text's automaton
is held in memory; other columns are ignored, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many periods and so many words.
MIN_TIMES, MIN_WORDS = 4, 6

Run = tuple[int, int, int]  # start, length, period


def factors(w: Sequence[int]) -> list[tuple[int, int, int]]:
    """LZ factorisation: start, end and start of an earlier occurrence (-1: a new word) of each factor.

    The suffix automaton knows for each of its states where the words of the state end first."""
    n = len(w)
    go: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for at, c in enumerate(w):
        new = len(go)
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(at)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                clone = len(go)
                go.append(go[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    out, start = [], 0
    while start < n:
        state, end = 0, start
        while end < n:
            following = go[state][w[end]]
            if first[following] >= end:
                break
            state, end = following, end + 1
        if end == start:
            out.append((start, start + 1, -1))
            start += 1
        else:
            out.append((start, end, first[state] - (end - start) + 1))
            start = end
    return out


def agreement(w: Sequence[int], most: int) -> list[int]:
    """For each place up to ``most``, the length to which the sequence agrees with itself from there on (Z function)."""
    n = len(w)
    z = [0] * (min(most, n - 1) + 1 if n else 0)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(w: Sequence[int], before: int, border: int, after: int, times: int) -> list[Run]:
    """Maximal repetitions with at least ``times`` periods that touch the border, end at or before ``after`` and begin where
    those of the two factors [before, border) and [border, after) can: since a factor is the longest that
    occurs earlier, they begin within one period of ``before``. Periods needn't be the smallest."""
    most = (after - before) // (times - 1)
    low = max(0, before - most)
    left, right = w[low:border], w[border:after]
    back, n = left[::-1], len(left)
    forward_right = agreement(right, min(most, len(right)))  # right against itself, q on
    backward_left = agreement(back, min(most, n))  # left against itself, q back
    # right against what begins q before the border, and left against what ends q behind it
    joined = [*right, -1, *left, *right]
    forward_left = agreement(joined, len(joined) - 1)
    joined = [*back, -1, *right[::-1], *back]
    backward_right = agreement(joined, len(joined) - 1)
    out, m = [], len(right)
    for q in range(1, most + 1):
        found = []
        if q <= n:  # a period before the border
            found.append((border - q - (backward_left[q] if q < len(backward_left) else 0), border + min(forward_left[m + 1 + n - q], m)))
        if q <= m:  # a period behind it
            found.append((border - min(backward_right[n + 1 + m - q], n), border + q + (forward_right[q] if q < len(forward_right) else 0)))
        for start, end in found:
            if end - start < times * q or start == low and low > 0 or end == after and after < len(w) and w[after] == w[after - q]:
                continue
            out.append((start, end - start, q))
    return out


def maximal_runs(w: Sequence[int], times: int = MIN_TIMES, shortest: int = MIN_WORDS) -> list[Run]:
    """All runs with at least ``times`` >= 2 periods and ``shortest`` words, by start, then period."""
    w = list(w)
    found: dict[tuple[int, int], int] = {}
    starts: list[tuple[int, int]] = []  # (start, end), sorted

    def add(start: int, end: int, q: int) -> None:
        if (start, end) not in found:
            found[start, end] = q
            insort(starts, (start, end))
        elif q < found[start, end]:
            found[start, end] = q

    before = 0
    for border, after, source in [*factors(w), (len(w), len(w), -1)]:
        for start, length, q in crossing(w, before, border, after, times):
            add(start, start + length, q)
        if source >= 0:
            # runs of the earlier occurrence that lie inside it; copies are met again if the two overlap
            at, end = bisect_right(starts, (source, len(w))), source + after - border
            while at < len(starts) and starts[at][0] < end:
                s, e = starts[at]
                if e < end:
                    add(s + border - source, e + border - source, found[s, e])
                at += 1
        before = border
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= shortest)


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of MIN_WORDS words or more in which every window of three words occurs three times in
    the text; all runs with four periods and six words lie in one of them, with the words beside them or at its end."""
    if len(ids) < MIN_WORDS:
        return []
    u = ids.astype(np.uint64)
    window = (u[:-2] * np.uint64(0x9E3779B97F4A7C15) + u[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + u[2:]
    order = np.argsort(window, kind="stable")
    by = window[order]
    edge = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1], [True])))
    often = np.zeros(len(window) + 2, bool)
    often[order + 1] = np.repeat(np.diff(edge) >= 3, np.diff(edge))
    edge = np.flatnonzero(often[1:] != often[:-1])
    return [(s, e + 2) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()) if e + 2 - s >= MIN_WORDS]


def runs_of_words(words: list[bytes]) -> list[Run]:
    """All runs of a list of words."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return [(s + start, length, q) for start, end in stretches(ids) for s, length, q in maximal_runs(ids[start:end].tolist())]


def highest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; ties: the smallest start, then the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def periodic_runs(docs: DataFrame, runs: bool = True, text: bool = True, digests: bool = False) -> DataFrame:
    """docs: doc_id, text. doc_id, n_runs, the highest run (start, length, period, exponent_milli; null without runs), and as
    asked for: runs (start, length, period), the collapsed text, and digests of both. One row a document, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint"
    schema += ", runs array<struct<start:bigint,length:bigint,period:bigint>>" * runs + ", collapsed string" * text + ", runs_sha256 string, collapsed_sha256 string" * digests
    names = ["start", "length", "period"]
    a_run = pa.struct([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in schema.replace("bigint,length:bigint,period:", "").split(", ")][1:]
            for t in batch.column(1):
                words = (t.as_py() or "").encode("utf-8").split()
                found = runs_of_words(words)
                top = highest(found)
                row: list = [len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None]
                if runs:
                    row.append([dict(zip(names, r)) for r in found])
                left = b" ".join(collapsed(words, found))
                if text:
                    row.append(left.decode("utf-8"))
                if digests:
                    shown = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                    row += [hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = [pa.int64()] * 5 + [pa.list_(a_run)] * runs + [pa.string()] * (text + 2 * digests)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [x.split()[0] for x in schema.replace("bigint,length:bigint,period:", "").split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. The texts with a periodic tail for a tenth of the ids: with h the crc32 of the decimal id, g = h // 10 and n
    words, if h % 10 = 0 every word from number a = g % n on is word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    DataFrame functions only. A null id keeps its text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")

    def tail(s: Column) -> Column:
        words, n, g = s["w"], F.size(s["w"]).cast("long"), s["g"]
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        repeated = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), repeated), " ")).otherwise("")

    # a list of one lets the words be split once and be named
    planted = F.transform(F.array(F.struct(w.alias("w"), F.floor(h / 10).cast("long").alias("g"))), tail)[0]
    return docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
