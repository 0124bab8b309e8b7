"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix is fixed by its last token and the encoding of what
stands before that token. So the distinct words are put into a trie, which is
walked depth first with a stack of last tokens, one for each symbol on the path:
a prefix that many words share is encoded once. A token is the last one of a
prefix if it forms a stable pair with the last token before it, that is if the
merges applied to the two tokens' symbols give these two tokens again. A text's
ids are read off the words' encodings.

The trie is held as the sorted list of words: neighbours share their longest
common prefix, and going down the list is the depth-first walk.

Defined results: null text encodes as the empty text (no ids, empty decoding);
repeated rows give repeated results; an empty table gives an empty table; other
columns are carried by ``encode_texts`` only if asked for by name.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from polysema.llm.memory import begins, remembers

#: Words whose encodings, and pairs of tokens whose stability, a Python worker remembers before it starts anew.
WORDS_KEPT, PAIRS_KEPT = 300_000, 100_000
#: Texts that are encoded together: their new words make one trie.
TEXTS_AT_ONCE = 256

# Text of these characters only is split by a plain class; the rest by Unicode properties.
_LETTER = "a-zà-öø-ÿßœ"
_EXOTIC = re.compile("[^\x00-\x1b\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xc0-\xffœ–—‘’“”•…€]")
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s0-9{_LETTER}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class TrieEncoder:
    """Encoder of words over a merge list. A symbol is a byte's character, the last
    one of a word with the end marker; a token is a string of symbols."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.split: dict[str, tuple[str, str]] = {}
        for pair in merges:
            if "".join(pair) in self.split:
                raise ValueError(f"two merges make {pair}")
            self.split["".join(pair)] = tuple(pair)
        base = [t for t in vocab if t not in self.split]
        #: symbols first, then the merged tokens in the order of their merges
        self.order = {t: i for i, t in enumerate([*base, *self.split])}
        self.rank = {pair: self.order[t] for t, pair in self.split.items()}
        self.longest = max((len(t.removesuffix(end)) for t in vocab), default=1)
        self.pairs: dict[tuple[str | None, str], bool] = {}

    def stable(self, before: str | None, token: str) -> bool:
        """Whether the merges leave the two tokens side by side as they are (alone: whole).

        The tokens' merges are undone from the latest on; at each step the pieces
        that meet at the border must not have a merge that comes before the merge
        just undone, since it would have crossed the border."""
        if before is None:
            return token in self.order
        order, pairs, split = self.order, self.rank, self.split
        limit, left, right = len(order) + 1, before, token
        while True:
            if pairs.get((left, right), limit) < limit:
                return False
            a, b = order[left], order[right]
            if a > b:
                if (parts := split.get(left)) is not None:
                    left, limit = parts[1], a
                elif (parts := split.get(right)) is not None:
                    right, limit = parts[0], b + 1
                else:
                    return True
            elif (parts := split.get(right)) is not None:
                right, limit = parts[0], b + 1
            elif (parts := split.get(left)) is not None:
                left, limit = parts[1], a
            else:
                return True

    def last(self, text: str, n: int, path: list[str | None], mark: str) -> str:
        """The last token of the first n symbols; path[i]: of the first i symbols."""
        vocab, pairs = self.vocab, self.pairs
        # the last token often goes on by a symbol, so that start is tried first
        grown = n - 1 - len(path[n - 1] or "")
        for start in (grown, *range(max(0, n - self.longest), n)):
            token = text[start:n] + mark
            if token in vocab:
                pair = path[start], token
                if (ok := pairs.get(pair)) is None:
                    ok = pairs[pair] = self.stable(*pair)
                if ok:
                    return token
        raise ValueError(f"no token ends {text[:n]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word (in byte characters, not empty)."""
        out: dict[str, list[int]] = {}
        path: list[str | None] = [None]  # of the prefixes of the word at hand
        last, previous, vocab, mark = self.last, "", self.vocab, self.end
        for word in sorted(set(words)):
            inner = len(word) - 1
            shared, most = 0, min(inner, len(path) - 1, len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del path[shared + 1 :]
            for n in range(shared + 1, inner + 1):
                path.append(last(word, n, path, ""))
            token = last(word, inner + 1, path, mark)
            ids, at = [vocab[token]], inner + 1 - len(token) + len(mark)
            while at > 0:
                token = path[at]
                ids.append(vocab[token])
                at -= len(token)
            ids.reverse()
            out[word], previous = ids, word
        return out


class WordBpe:
    """The tokenizer of a word-end BPE file: NFC, lower case, split, byte characters."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        model = d["model"]
        self.trie = TrieEncoder(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.token = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.bytes = byte_symbols()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        split = next(p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_by_property = regex.compile(split).findall
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without regard to context
        text = text.lower()
        return self.words_by_property(text) if _EXOTIC.search(text) else _PLAIN.findall(text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, split = self.known, []
        if len(known) > WORDS_KEPT:
            known.clear()
        if len(self.trie.pairs) > PAIRS_KEPT:
            self.trie.pairs.clear()
        for text in texts:
            parts: list[str | int] = []
            for piece in self.split_special(text or ""):
                if piece in self.special:
                    parts.append(self.special[piece])
                elif piece:
                    parts += self.words(piece)
            split.append(parts)
        new = {w for parts in split for w in parts if w not in known and isinstance(w, str)}
        if new:
            table = self.bytes
            shown = {w: w if w.isascii() else "".join([table[b] for b in w.encode("utf-8")]) for w in new}
            shown |= {w: "".join([table[b] for b in w.encode("utf-8")]) for w in new if w.isascii() and not w.isprintable()}
            ids = self.trie.encode_words(shown.values())
            known |= {w: np.array(ids[s], "<u4").tobytes() for w, s in shown.items()}
        if self.special:
            known |= {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    def decode(self, ids: bytes | Iterable[int]) -> str:
        """Tokens joined by a space, special ones too: the file names no decoder."""
        listed = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        return " ".join(map(self.token.__getitem__, listed))


@functools.lru_cache(maxsize=4)
def loaded(spec: str) -> WordBpe:
    """One tokenizer a Python worker, with the words that it has met."""
    return WordBpe(spec)


remembers("bpe", loaded.cache_clear)


def encode_texts(docs: DataFrame, spec: str, id_col: str = "doc_id", text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """id_col, n_tokens and, as asked for: ids array<int>; ids_sha256, decoded_sha256. No shuffle.

    spec: the tokenizer file's content, so that executors need not hold the file.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # a file of under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("bpe")
        bpe = loaded(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                coded = bpe.encode_batch(part.column(1).to_pylist())
                out = {id_col: part.column(0), "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64())}
                if ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                if digests:
                    out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in coded]
                    out["decoded_sha256"] = [hashlib.sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in coded]
                yield pa.RecordBatch.from_pydict(out)

    return docs.select(id_col, text).mapInArrow(run, schema)


def decode_ids(coded: DataFrame, spec: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id_col and decoded string; null ids decode as none."""
    shared = coded.sparkSession.sparkContext.broadcast(spec)
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("bpe")
        bpe = loaded(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "decoded": [bpe.decode(x or []) for x in part.column(1).to_pylist()]})

    return coded.select(id_col, ids).mapInArrow(run, f"`{id_col}` {kind}, decoded string")
