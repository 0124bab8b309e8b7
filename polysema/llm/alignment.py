"""Alignment of two tokenizations of the same text.

Two tokenizers cut the bytes of " " + text into tokens. The tokens of both are the
nodes of a bipartite graph whose edges join tokens that share a byte. Its connected
components, found by union-find, are the minimal groups: the shortest stretches
that both cut alike. Each component's members expand to its links, the pairs of
overlapping tokens; Spark counts the links of all documents by pair of ids, and
every document is judged by these counts.

Texts are cut before single spaces first, where no token of either tokenizer can
reach across (checked on the vocabulary), so that a piece of text that occurs again
and again is encoded and grouped once a worker. A text with a piece that its tokens
do not spell is done again as a whole.

Defined results: null and empty texts, and texts that the tokens of either side do
not spell byte by byte, have no tokens, no groups and no links (all numbers 0, groups
''); repeated rows count each; a null id is an id like others; texts of any length
are taken whole (one text's tokens are held in memory); other columns are ignored,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysema.llm.bpe import byte_symbols
from polysema.llm.memory import begins, remembers
from polysema.tables import Scratch, fits

#: Pieces of text that a worker remembers before it forgets those it has not met since the last time, and
#: characters beyond which a piece is not remembered.
PIECES_KEPT, LONG_PIECE = 200_000, 48
#: Texts whose new pieces are encoded together.
TEXTS_AT_ONCE = 128
#: A pair of ids is one number: A's id times 2^BITS plus B's id.
BITS = 24

#: How byte-level tokenizers split text into words (a fixed value of their format).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class may differ between libraries' Unicode tables.
_EXOTIC = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
_SPACED = re.compile(r" \s|▁")
_CUT = re.compile(r"(?<=[^ ▁]) (?=\S)")


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of two token lists over the same bytes. Edges (i, j) of overlapping tokens in order of place, and the
    component of each edge, numbered from 0 in order of place.

    Two tokens overlap where the later one begins, so every byte that begins a token of either side is one edge.
    Union-find: the parent's parent is lowered to the smallest parent across each edge, then every node takes its
    parent's parent, until nothing changes."""
    a_first, b_first = np.zeros(int(a_end[-1]) + 1, bool), np.zeros(int(a_end[-1]) + 1, bool)
    a_first[0] = b_first[0] = True
    a_first[a_end], b_first[b_end] = True, True
    at = np.flatnonzero((a_first | b_first)[:-1])
    i, j = np.cumsum(a_first[at]) - 1, np.cumsum(b_first[at]) - 1
    parent, b = np.arange(len(a_end) + len(b_end)), j + len(a_end)
    while True:
        low = np.minimum(parent[i], parent[b])
        after = parent.copy()
        np.minimum.at(after, parent[i], low)
        np.minimum.at(after, parent[b], low)
        after = after[after]
        if (after == parent).all():
            break
        parent = after
    root = parent[i]
    return i, j, np.cumsum(np.concatenate(([0], root[1:] != root[:-1])))


class Pieces:
    """Both tokenizers and the pieces that a worker has met."""

    def __init__(self, a_spec: str, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = {c: i for i, c in enumerate(byte_symbols())}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        shown = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(shown)]
        self.a_length = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_length[list(self.a_bytes)] = [len(t) for t in self.a_bytes.values()]
        self.b_length = np.array([len(t) for t in self.b_bytes])
        #: A must split words before their space, and no token of B may hold a space behind another character; else nothing is cut
        splits = (json.loads(a_spec).get("pre_tokenizer") or {}).get("use_regex", False)
        self.whole = not splits or any(" " in t.replace("▁", " ").lstrip(" ") for t in shown)
        self.a_shown = [np.array([f"{t}{end}" for t in range(len(self.a_length))], object) for end in ",|"]
        self.b_shown = [np.array([f"{t}{end}" for t in range(len(shown))], object) for end in ",;"]
        self.known: dict[str, tuple[int, str, bytes] | None] = {}
        self.before: dict[str, tuple[int, str, bytes] | None] = {}
        self.quick = self._quick(a_spec)

    def cut(self, text: str) -> list[str]:
        """Pieces that give " " + text if a space is put before each."""
        if self.whole:
            return [text]
        if text[0] != " " and text[-1] != " " and not _SPACED.search(text):
            return text.split(" ")
        return _CUT.split(text)

    def _quick(self, a_spec: str):
        """A faster encoder for texts without exotic characters, if A's ids are in the order of its merges."""
        import tiktoken

        spec = json.loads(a_spec)
        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
        if spec.get("normalizer") or self.whole or made != list(range(256, 256 + len(made))) or len(vocab) > 256 + len(made) + len(special):
            return None
        return tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks={self.a_bytes[i]: i for i in range(256 + len(made))}, special_tokens={}).encode_ordinary

    def encoded(self, text: str, exotic: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None if the tokens spell another text."""
        if exotic or not self.quick:
            a = getattr(self.a, "encode_batch_fast", self.a.encode_batch)([" " + text], add_special_tokens=False)[0].ids
        else:
            a = self.quick(" " + text)
        b = self.b.encode(text)
        want = (" " + text).encode("utf-8")
        if b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want:
            return np.array(a, np.int64), np.array(b, np.int64)
        return None

    def align(self, pieces: list[str], exotic: bool = True) -> list[tuple[int, str, bytes] | None]:
        """Of each piece: tokens of A, groups (each ended by a semicolon), and the id pairs of its links; None if the
        tokens spell another text. The pieces are encoded as one text: no token reaches across a cut."""
        if not pieces:
            return []
        both = self.encoded(" ".join(pieces), exotic)
        if both is None:
            return [None] if len(pieces) == 1 else [x for p in pieces for x in self.align([p], exotic)]
        a, b = both
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        i, j, group = components(a_end, b_end)
        links = a[i] << BITS | b[j]
        a_of, b_of = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_of[i], b_of[j] = group, group
        a_last, b_last = np.concatenate((a_of[1:] != a_of[:-1], [True])), np.concatenate((b_of[1:] != b_of[:-1], [True]))
        tokens = np.concatenate((np.where(a_last, self.a_shown[1][a], self.a_shown[0][a]), np.where(b_last, self.b_shown[1][b], self.b_shown[0][b])))
        order = np.argsort(np.concatenate((2 * a_of, 2 * b_of + 1)), kind="stable")
        tokens = tokens[order].tolist()
        ends = np.cumsum([1 + len(p.encode("utf-8")) for p in pieces])  # every piece ends a token of either side
        in_a, in_b = np.searchsorted(a_end, ends) + 1, np.searchsorted(b_end, ends) + 1
        of_link = [0, *np.searchsorted(i, in_a).tolist()]
        in_all, in_a = [0, *(in_a + in_b).tolist()], [0, *in_a.tolist()]
        raw = links.tobytes()
        return [
            (y - x, "".join(tokens[s:e]), raw[8 * u : 8 * v])
            for x, y, s, e, u, v in zip(in_a, in_a[1:], in_all, in_all[1:], of_link, of_link[1:])
        ]

    def align_texts(self, texts: list[str | None]) -> list[tuple[int, str, bytes]]:
        """Of each text: tokens of A, groups, id pairs of its links."""
        if len(self.known) > PIECES_KEPT:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        cut = [self.cut(t) if t else [] for t in texts]
        new = {p for pieces in cut for p in pieces if p not in known}
        again = [p for p in new if p in before]
        known.update((p, before[p]) for p in again)
        kinds: tuple[list[str], list[str], list[str]] = [], [], []
        for p in new.difference(again):
            kinds[2 if p[-1] in " ▁" or p[0].isspace() else bool(_EXOTIC.search(p))].append(p)
        for exotic, pieces in enumerate(kinds[:2]):
            known.update(zip(pieces, self.align(pieces, bool(exotic))))
        for p in kinds[2]:  # what could run into its neighbours
            known[p] = self.align([p])[0]
        out = []
        for text, pieces in zip(texts, cut):
            got = [known[p] for p in pieces]
            if None in got:
                got = self.align([text]) if len(pieces) > 1 else []
            if not got or got[0] is None:
                out.append((0, "", b""))
            else:
                a, groups, links = zip(*got)
                out.append((sum(a), "".join(groups)[:-1], b"".join(links)))
        for p in new:
            if len(p) > LONG_PIECE:
                del known[p]
        return out


@functools.lru_cache(maxsize=2)
def loaded(a_spec: str, b_model: bytes) -> Pieces:
    return Pieces(a_spec, b_model)


remembers("alignment", loaded.cache_clear)


def align(docs: DataFrame, a_spec: str, b_model: bytes, groups: bool = True, digests: bool = False) -> DataFrame:
    """docs: doc_id, text. doc_id, n_a, n_b, n_groups, n_links, the distinct id pairs of the links (A's id times
    2^BITS plus B's) with the number of each, and as asked for groups, groups_sha256. One row a document, no shuffle.

    a_spec, b_model: contents of the two tokenizer files, so that executors need not hold them."""
    shared = docs.sparkSession.sparkContext.broadcast((a_spec, b_model))  # two files of under 2 MB
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, pairs array<bigint>, times array<int>" + ", groups string" * groups + ", groups_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("alignment")
        pieces = loaded(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                found = pieces.align_texts(part.column(1).to_pylist())
                counted = [np.unique(np.frombuffer(x[2], np.int64), return_counts=True) for x in found]
                ends = pa.array(np.cumsum([0, *(len(p) for p, _ in counted)]), pa.int32())
                out = {"doc_id": part.column(0)}
                n_a, n_links = np.array([f[0] for f in found], np.int64), np.array([len(f[2]) // 8 for f in found], np.int64)
                n_groups = np.array([f[1].count(";") + (f[1] != "") for f in found], np.int64)
                n_b = n_links + n_groups - n_a  # a group of a and b tokens has a + b - 1 links
                out |= {"n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links)}
                out["pairs"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p for p, _ in counted])))
                out["times"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([n for _, n in counted]).astype(np.int32)))
                if groups:
                    out["groups"] = pa.array([f[1] for f in found], pa.string())
                if digests:
                    out["groups_sha256"] = pa.array([hashlib.sha256(f[1].encode()).hexdigest() if f[1] else "" for f in found], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, count (links of all documents with these ids), best (whether no other A id has more links with this B id).

    Every document brings a pair once, with its number, and every task one row a pair; there are at most
    as many rows as pairs of ids, and at most as many rows of a B id as A has ids."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    ids = each.select("pair", F.shiftright("pair", BITS).alias("a"), F.col("pair").bitwiseAND((1 << BITS) - 1).alias("b"), "count")
    most = ids.groupBy("b").agg(F.max("count").alias("most"))
    return ids.join(most, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scores(aligned: DataFrame, counts: DataFrame, broadcast: bool) -> DataFrame:
    """Every column of ``aligned`` but pairs and times, with n_best and count_sum. counts: pair, count, best. One row a document
    comes from each task that holds links of it; if the counts are broadcast, that is one task."""
    numbered = aligned.withColumn("row_", F.monotonically_increasing_id())
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]
    each = numbered.select("row_", *rest, F.explode_outer(F.arrays_zip("pairs", "times")).alias("x")).select("row_", *rest, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    few = counts.select("pair", "count", "best")
    joined = each.join(F.broadcast(few) if broadcast else few, "pair", "left")
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.coalesce(F.sum(F.col("times") * F.col("count")), F.lit(0)).cast("long").alias("count_sum"))
    if broadcast:
        return joined.groupBy("row_", *rest).agg(*sums).drop("row_")
    return joined.select("row_", "times", "count", "best").groupBy("row_").agg(*sums).join(numbered.select("row_", *rest), "row_").drop("row_")


def aligned_documents(docs: DataFrame, a_spec: str, b_model: bytes, groups: bool = False, digests: bool = True, broadcast: bool | None = None, scratch: Scratch | None = None) -> DataFrame:
    """docs: doc_id, text. doc_id, n_a, n_b, n_groups, n_links, as asked for groups and groups_sha256, n_best, count_sum.

    Counts are broadcast where their size is within the library's bound, else joined by shuffle; broadcast forces either way."""
    scratch = scratch or Scratch(docs.sparkSession, "alignment")
    aligned = scratch.keep(align(docs, a_spec, b_model, groups, digests), "aligned")
    counts = scratch.keep(pair_counts(aligned), "counts")
    return scores(aligned, counts, fits(counts) if broadcast is None else broadcast)
